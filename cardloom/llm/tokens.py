"""Vectorized pre-tokenization in front of a `tokenizers` BPE model with word ends.

The library encodes each pre-token by itself, so a text's ids are the ids of its pre-tokens in order. Texts of a
batch are cut into pre-tokens with numpy over code points; each distinct pre-token is encoded once by the
library's own BPE model and kept in a bounded cache. A text goes to the whole library pipeline instead when it
holds an added token's string, or any character outside a range for which lower-casing, NFC and character classes
are known to be one code point in, one out. Both ways give the library's ids; only the speed differs.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import on_leave, span_hashes

#: The split pattern of the word-end BPE tokenizers that the fast way covers, and its contractions.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
CACHE_WORDS = 200_000  # pre-tokens that a worker remembers; it starts anew when they are full
LONG_WORD = 256  # a longer pre-token isn't remembered
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)


def _known() -> list[range]:
    return [range(0x20, 0x7F), range(0xA0, 0x250), range(0x384, 0x400), range(0x400, 0x483), range(0x48A, 0x500), range(0x2010, 0x2028),
        range(0x2030, 0x205F), range(0x20A0, 0x20C0), range(0x3041, 0x3097), range(0x30A0, 0x3100), range(0x4E00, 0xA000), range(0xAC00,
        0xD7A4)]


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case by code point below U+10000."""
    kind, low = np.full(0x10000, UNSURE, np.uint8), np.arange(0x10000, dtype=np.uint32)
    kind[9:14] = SPACE
    for span in _known():
        for c in span:
            s = chr(c)
            lower = s.lower()
            cat = unicodedata.category(s)
            if len(lower) != 1 or unicodedata.normalize("NFC", s) != s or cat in ("Cn", "Mn", "Mc") or s in "Σẞ":
                continue
            kind[c] = SPACE if s.isspace() else LETTER if cat[0] == "L" else NUMBER if cat[0] == "N" else OTHER
            low[c] = ord(lower)
    return kind, low


def byte_letters() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Encoder:
    """Ids of whole texts as Tokenizer.encode(text, add_special_tokens=False) gives them, for batches of texts.

    word_ids(byte_level_word) encodes one pre-token; the default is the library's BPE model.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str, word_ids: Callable[[str], list[int]] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.spec = spec
        self.added = [a["content"] for a in spec["added_tokens"]]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.fast = steps == ["NFC", "Replace",
            "Lowercase"] and bool(pre) and pre[0].get("pattern") == {"Regex": SPLIT} and spec["model"]["type"] == "BPE"
        self.model = self.tokenizer.model
        self.word_ids = word_ids or self.library_ids
        self.cache: dict[str, list[int]] = {}
        self.kind, self.low = tables() if self.fast else (None, None)
        self.letters = byte_letters()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def library_ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word)]

    def byte_level(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])

    def one_word(self, word: str) -> list[int]:
        got = self.cache.get(word)
        if got is None:
            got = self.word_ids(self.byte_level(word))
            if len(word) <= LONG_WORD:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = got
        return got

    def whole(self, text: str) -> list[int]:
        """One text by the library's pipeline."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def batch(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n+1 bounds. A null text is empty."""
        texts = [x or "" for x in col.to_pylist()]
        own: dict[int, list[int]] = {}
        if not self.fast:
            own = {i: self.whole(x) for i, x in enumerate(texts)}
            texts = [""] * len(texts)
        for i, x in enumerate(texts):
            if any(a in x for a in self.added):
                own[i], texts[i] = self.whole(x), ""
        ids, bounds, unsure = self._pieces(texts)
        for i in unsure:
            own[i] = self.whole(texts[i])
        if not own:
            return ids, bounds
        parts = [np.asarray(own[i], np.uint32) if i in own else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        n = len(texts)
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1)])
        if self.kind is None or not n:
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64), []
        kind = self.kind[np.minimum(code, 0xFFFF)]
        unsure = np.flatnonzero(np.maximum.reduceat(kind, first[:-1]) == UNSURE)
        for i in unsure:
            kind[first[i] : first[i + 1]] = SPACE
        code = self.low[np.minimum(code, 0xFFFF)]
        begins = np.empty(len(kind), bool)
        begins[0] = kind[0] != SPACE
        begins[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)) & (kind[1:] != SPACE)
        quote = np.flatnonzero((code == 0x27) & begins)
        pad = np.concatenate([code, np.zeros(3, np.uint32)])
        cut = np.zeros(len(kind) + 3, np.int8)  # length of the contraction that starts here
        for tail in CONTRACTIONS:
            hit = quote[(pad[quote + 1] == ord(tail[0])) & ((pad[quote + 2] == ord(tail[1])) if len(tail) > 1 else True) & (kind[quote] == OTHER)]
            cut[hit] = len(tail) + 1
        at = np.flatnonzero(cut)
        for p in at:
            to = p + int(cut[p])
            begins[p + 1 : to] = False
            if to < len(kind) and kind[to] != SPACE:
                begins[to] = True
        start = np.flatnonzero(begins)
        gone = np.concatenate([kind != SPACE, [False]])
        stop = np.flatnonzero(gone[:-1] & ~gone[1:]) + 1  # ends of runs without blanks
        end = np.minimum(np.concatenate([start[1:], [len(kind)]]), stop[np.searchsorted(stop, start, "right")] if len(stop) else 0)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64), unsure.tolist()
        key = span_hashes(code, start, end)
        _, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        lowered = code.tobytes().decode("utf-32-le")
        a, b = start[where].tolist(), end[where].tolist()
        found = [self.one_word(lowered[i:j]) for i, j in zip(a, b, strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for f in found for x in f), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size
        each = size[inverse]
        total = np.cumsum(each)
        ids = flat[np.repeat(begin[inverse] - (total - each), each) + np.arange(int(total[-1]))]
        bounds = np.concatenate([[0], total])[np.searchsorted(start, first)]
        return ids, bounds, unsure.tolist()


on_leave(__name__, Encoder._loaded.clear)
