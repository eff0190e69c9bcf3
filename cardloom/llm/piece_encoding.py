"""SentencePiece encoding through a table of distinct chunks, and decoding.

The model writes a blank as the marker U+2581 and puts one in front of a text. When none of its pieces has a marker after another
character, no merge ever joins the end of a word to the marker behind it: the text falls into chunks (a run of markers, then the
characters up to the next run), and its ids are the ids of its chunks in order. The chunks of a block of texts are cut from the
raw bytes at once; each distinct one is segmented once, by the library, and its ids, their decimal form and its decoded text are
rows of a table that lives on in the worker (bounded, it starts anew when full); all chunks then take their rows by position.

The library puts its own marker in front of what it encodes, so a chunk is handed over without its first marker; a lone marker,
which only ends a text, is a row of its own. Decoding drops the first marker of a text, so decoded chunks are joined by blanks.
A model whose pieces do cross markers, or whose normalizer changes more than blanks, takes whole texts instead: same ids, slower.

Edge cases. A null or empty text has no ids and decodes to the empty text; characters without a piece become bytes; a marker
that stands in a text counts as a blank, as in the library; a text of one unbroken word of any length is one chunk; repeated rows
and ids give one row each; an empty table gives none; extra columns are ignored by the query and kept by encode_documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_map, chunks, fresh, on_leave, span_hashes, table, text_bytes

MARKER = "▁"
TABLE_CHUNKS = 150_000  # rows of the worker's table
LONG_CHUNK = 256  # bytes; a longer chunk isn't remembered
LONE = None  # key of the lone marker


class ChunkTable:
    """Rows (ids, decimal ids joined by commas, decoded text) of distinct chunks."""

    _loaded: dict[str, ChunkTable] = {}

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.model = SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        rule = spec.normalizer_spec
        plain = rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces and not rule.precompiled_charsmap
        apart = not spec.trainer_spec.treat_whitespace_as_suffix and not any(MARKER in p.piece.lstrip(MARKER) for p in spec.pieces)
        self.cuts = plain and apart and spec.trainer_spec.model_type == spec.trainer_spec.BPE
        every = range(self.model.get_piece_size())
        self.pieces = [self.model.id_to_piece(i).replace(MARKER, " ") for i in every]
        self.special = {i for i in every if self.model.is_byte(i) or self.model.is_unknown(i) or self.model.is_control(i)}
        self.decimal = [str(i) for i in every]
        self.rows: dict[bytes | None, tuple[list[int], str, str]] = {}

    @classmethod
    def of(cls, path: str) -> ChunkTable:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids)."""
        if not self.special.isdisjoint(ids):  # bytes, unknown
            return self.model.decode(ids)
        return "".join([self.pieces[i] for i in ids])[1:]

    def found(self, keys: list[bytes | None]) -> list[tuple[list[int], str, str]]:
        """The rows of distinct chunks; those that the table lacks are segmented together."""
        out = [self.rows.get(k) for k in keys]
        new = [i for i, row in enumerate(out) if row is None]
        ids = self.model.encode([keys[i].decode() if keys[i] is not LONE else "" for i in new], num_threads=1)
        if len(self.rows) + len(new) > TABLE_CHUNKS:
            self.rows.clear()
        decimal = self.decimal
        for i, mine in zip(new, ids, strict=True):
            mine = mine if keys[i] is not LONE else [self.model.piece_to_id(MARKER)]
            out[i] = row = mine, ",".join([decimal[x] for x in mine]), self.decode(mine)
            if keys[i] is LONE or len(keys[i]) <= LONG_CHUNK:
                self.rows[keys[i]] = row
        return out

    def look_up(self, col: pa.Array) -> tuple[list[tuple[list[int], str, str]], np.ndarray, np.ndarray]:
        """Rows of the distinct chunks of these texts, the row of every chunk in order, and the first chunk of each text (n+1 bounds)."""
        col = pc.fill_null(col, "")
        if pc.any(pc.match_substring(col, MARKER)).as_py():
            col = pc.replace_substring(col, MARKER, " ")
        data, offsets = text_bytes(col)
        first = np.unique(offsets[:-1][np.diff(offsets) > 0])  # of each text that has a chunk
        start = first
        if self.cuts and len(data):
            blank = data == 0x20
            begins = blank.copy()
            begins[1:] &= ~blank[:-1]
            begins[first] = True
            start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data)) if len(start) else start
        inner = start + 1  # what the library gets
        inner[np.searchsorted(start, first)] -= 1
        key = span_hashes(data, inner, end)
        _, where, place = np.unique(key, return_index=True, return_inverse=True)
        raw = data.tobytes()
        spans = zip(inner[where].tolist(), end[where].tolist(), strict=True)
        return self.found([raw[a:b] if b > a else LONE for a, b in spans]), place, np.searchsorted(start, offsets)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n+1 bounds."""
        rows, place, bounds = self.look_up(col)
        size = np.fromiter((len(r[0]) for r in rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r[0]), np.int32, int(size.sum()))
        each = size[place]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat((np.cumsum(size) - size)[place] - total[:-1], each) + np.arange(int(total[-1]))]
        return ids, total[bounds]

    def texts(self, col: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Of each text: the number of ids, the decimal ids joined by commas, and the decoded text."""
        rows, place, bounds = self.look_up(col)
        size, decimal, decoded = (np.array([f(r) for r in rows], t) for f, t in ((lambda r: len(r[0]), np.int64), (lambda r: r[1],
            object), (lambda r: r[2], object)))
        total = np.concatenate([[0], np.cumsum(size[place])]).astype(np.int64)
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        join = lambda what, by: [by.join(what[place[a:b]].tolist()) for a, b in spans]
        return np.diff(total[bounds]), join(decimal, ","), join(decoded, " ")


on_leave(__name__, ChunkTable._loaded.clear)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append input_ids (array<int>) and decoded (string) to every row; a name that is taken gets an underscore."""
    names = fresh(docs, "input_ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1],
        T.StringType())])

    def run(batches):
        known = ChunkTable.of(path)
        for batch in batches:
            for part in chunks(batch, text):
                ids, bounds = known.encode(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(known.texts(part.column(text))[2], pa.string())],
                    [*part.schema.names, *names])

    return arrow_map(docs, run, schema)


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by commas, and of the decoded text."""
    digest = lambda found: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in found], pa.string())

    def run(batches):
        known = ChunkTable.of(path)
        for batch in batches:
            for part in chunks(batch):
                count, decimal, decoded = known.texts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), digest(decimal), digest(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return arrow_map(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), default_path())
