"""BPE encoding by tree concatenation, and decoding.

A pre-token of up to LEAF symbols is encoded by the library's BPE model at once. A longer one, however long, is
halved until the parts are short; all leaves are encoded together (the library does so in parallel). Two
neighbouring encodings are then joined: the last token of the left and the first of the right are re-encoded
together, and the window grows on the side that disagrees until the seams on both sides agree. A seam agrees if
the two tokens that meet there encode to themselves: a token sequence is the BPE encoding of its text exactly
when every adjacent pair is, so the joined sequence equals the encoding of the whole, with work that depends on the
windows and not on the length.

Edge cases. A null or empty text has no tokens and decodes to the empty text; strings of added tokens become those
tokens; a text of one unbroken word of any length is joined as above; repeated rows and ids give one row each;
extra columns are ignored by the query, and kept by encode_documents.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_map, chunks, fresh, on_leave, table
from .tokens import Encoder

LEAF = 128


class TreeEncoder:
    """Encodes byte-level words with merges that may span the leaves."""

    _loaded: dict[str, TreeEncoder] = {}

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.leaf = leaf
        self.encoder = Encoder(path, self.word_ids)
        spec = json.loads(self.encoder.tokenizer.to_str())
        spec |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.last = Tokenizer.from_str(json.dumps(spec))
        spec["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(spec))
        self.tokens = [self.encoder.tokenizer.id_to_token(i) or "" for i in range(self.encoder.tokenizer.get_vocab_size())]
        self.agreed: dict[tuple[int, int], bool] = {}

    @classmethod
    def of(cls, path: str) -> TreeEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def symbols(self, token: int) -> tuple[str, bool]:
        """The token's text and whether it ends a word."""
        s = self.tokens[token]
        return (s[: -len(self.suffix)], True) if self.suffix and s.endswith(self.suffix) else (s, False)

    def encode(self, text: str, ends: bool) -> list[int]:
        return [t.id for t in (self.last if ends else self.inner).model.tokenize(text)]

    def again(self, tokens: list[int]) -> list[int]:
        parts = [self.symbols(t) for t in tokens]
        return self.encode("".join(p for p, _ in parts), parts[-1][1])

    def agrees(self, a: int, b: int) -> bool:
        got = self.agreed.get((a, b))
        if got is None:
            if len(self.agreed) > 200_000:
                self.agreed.clear()
            got = self.agreed[a, b] = self.again([a, b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both texts as one."""
        i, j = 1, 1
        while True:
            window = self.again(left[-i:] + right[:j])
            more_left = i < len(left) and not self.agrees(left[-i - 1], window[0])
            more_right = j < len(right) and not self.agrees(window[-1], right[j])
            if not more_left and not more_right:
                return left[: len(left) - i] + window + right[j:]
            i = min(len(left), 2 * i) if more_left else i
            j = min(len(right), 2 * j) if more_right else j

    def word_ids(self, word: str) -> list[int]:
        if len(word) <= self.leaf:
            return [t.id for t in self.last.model.tokenize(word)]
        n = 1 << (-(-len(word) // self.leaf) - 1).bit_length()
        cuts = [len(word) * k // n for k in range(n + 1)]
        leaves = [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        level = [e.ids for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)] + [self.encode(leaves[-1], True)]
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        return level[0]

    def whole(self, text: str) -> list[int]:
        """A text that the vectorized cut doesn't cover: the library's normalizer and splitter, then the tree."""
        tokenizer, out, at = self.encoder.tokenizer, [], 0
        while at <= len(text):
            found = min(((p, a) for a in self.encoder.added if (p := text.find(a, at)) >= 0), key=lambda x: (x[0], -len(x[1])),
                default=(len(text), ""))
            part = text[at : found[0]]
            if part:
                part = tokenizer.normalizer.normalize_str(part) if tokenizer.normalizer else part
                for word, _ in tokenizer.pre_tokenizer.pre_tokenize_str(part):
                    out += self.word_ids(word)
            if not found[1]:
                break
            out.append(tokenizer.token_to_id(found[1]))
            at = found[0] + len(found[1])
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) of a tokenizer without a decoder: tokens with blanks between."""
        return " ".join([self.tokens[i] for i in ids])


on_leave(__name__, TreeEncoder._loaded.clear)


def _tree(path: str) -> TreeEncoder:
    tree = TreeEncoder.of(path)
    tree.encoder.whole = tree.whole
    return tree


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append input_ids (array<int>) and decoded (string) to every row; a name that is taken gets an underscore."""
    names = fresh(docs, "input_ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1],
        T.StringType())])

    def run(batches):
        tree = _tree(path)
        for batch in batches:
            for part in chunks(batch, text):
                ids, bounds = tree.encoder.batch(part.column(text))
                decoded = [tree.decode(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype("int32")))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.string())], [*part.schema.names, *names])

    return arrow_map(docs, run, schema)


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded text."""

    def run(batches):
        tree = _tree(path)
        for batch in batches:
            for part in chunks(batch, text):
                ids, bounds = tree.encoder.batch(part.column(text))
                ids = ids.astype("<u4")
                spans = list(zip(bounds, bounds[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([int(b - a) for a, b in spans], pa.int64()),
                        pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in spans], pa.string()),
                        pa.array([hashlib.sha256(tree.decode(ids[a:b].tolist()).encode("utf-8", "surrogatepass")).hexdigest() for a,
                            b in spans], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return arrow_map(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), default_path())
