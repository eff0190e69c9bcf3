"""Line-first quality rules: judge each line, drop failing lines, reject documents that lose too much of their text.

A line (split at \\n) with a word fails if
- symbols: it has more than `max_symbols` characters of #*$%&|<> a word;
- repetition: it has 20 words or more, over `max_run` of which repeat the word before them;
- navigation: it has 3 or more of the separators | » › • · with at most 4 words between two on average, or it is
  1 to 3 words of nothing but a link, a menu word or a page number;
- punctuation: it has 12 words or more, and neither an end mark . ! ? … : ; 。 ！ ？ nor a comma (， 、), bracket or quote; an
  apostrophe inside a word is no quote;
- boilerplate: at most 25 words, a fifth of which or more are phrases of BOILERPLATE.
Licence lines are boilerplate: they go, their documents stay. A document is rejected if the base rules fail it
(under 50 words, or over half of them in repeated 3-word windows), or if failing lines hold over `max_lost` of its
words.

Edge cases. A null or empty text has no words, fails the base and is rejected; ids may repeat or be null, one row out
per row in; a text without \\n is one line; extra columns are kept by clean_documents and ignored by quality_digests.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, chunks, mix, space_words, span_hashes, table

MIN_WORDS, MAX_REPEATED = 50, 50
MAX_SYMBOLS, MAX_RUN, MAX_LOST = 0.3, 0.3, 0.5
#: Symbols, and phrases of boilerplate lines, lower case.
SYMBOLS = b"#*$%&|<>"
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "accept cookies", "we use cookies",
        "licensed under",
    "this work is licensed", "skip to content", "enable javascript", "click here", "sign up for", "subscribe to our", "log in to",
        "share this", "back to top",
    "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados",
)
MENU = frozenset("home about contact menu login search next previous prev help faq sitemap share print".split())
_SEPARATOR = re.compile(r"[|»›•·]")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_LINK = re.compile(r"(?:https?://|www\.)\S+|\d+|[<>«»‹›]+")
_MARK = re.compile(r"[.!?…:;,()\[\]\"“”«»。！？，、：；「」『』（）【】]|(?<!\w)'|'(?!\w)")
_SPACE = re.compile(r"[ \t-\r]+")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def line_fails(line: str, max_symbols: float = MAX_SYMBOLS, max_run: float = MAX_RUN) -> str | None:
    """The rule that the line fails, or None."""
    words = [w for w in _SPACE.split(line) if w]
    n = len(words)
    if not n:
        return None
    if sum(map(line.count, "#*$%&|<>")) > max_symbols * n:
        return "symbols"
    if n >= 20 and sum(a == b for a, b in zip(words, words[1:], strict=False)) > max_run * n:
        return "repetition"
    if n <= 3 and all(_LINK.fullmatch(w) or w.lower() in MENU for w in words):
        return "navigation"
    cuts = len(_SEPARATOR.findall(line))
    if cuts >= 3 and n <= 4 * (cuts + 1) + cuts:
        return "navigation"
    if n >= 12 and not _MARK.search(line):
        return "punctuation"
    phrases = _BOILERPLATE.findall(line.lower()) if n <= 25 else ()
    if phrases and 5 * sum(p.count(" ") + 1 for p in phrases) >= n:
        return "boilerplate"
    return None


def clean_lines(text: str) -> tuple[str, int]:
    """The text of lines that pass, and how many words the others had."""
    kept, lost = [], 0
    for line in text.split("\n"):
        if line_fails(line):
            lost += sum(1 for w in _SPACE.split(line) if w)
        else:
            kept.append(line)
    return "\n".join(kept), lost


def base_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols and n_repeat_words of every text of a batch."""
    data, start, end, first = space_words(col)
    n = np.diff(first)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    chars = np.concatenate([[0], np.cumsum(lead[end] - lead[start])])
    marks = np.concatenate([[0], np.cumsum(symbols[end] - symbols[start])])
    h = span_hashes(data, start, end)
    row = np.repeat(np.arange(len(n)), n)
    hit = np.zeros(len(h) + 2, bool)
    if len(h) > 2:
        with np.errstate(over="ignore"):
            w = mix(mix(mix(h[:-2]) * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:]) ^ mix(row[:-2].astype(np.uint64))
        inside = row[:-2] == row[2:]
        order = np.argsort(w, kind="stable")
        order = order[inside[order]]
        same = w[order[1:]] == w[order[:-1]]
        found = np.concatenate([order[1:][same], order[:-1][same]])
        for k in range(3):
            hit[found + k] = True
    repeated = np.concatenate([[0], np.cumsum(hit[: len(h)])])
    at = lambda total: np.diff(total[first])
    return {"n_words": n, "word_chars": at(chars), "n_symbols": at(marks), "n_repeat_words": at(repeated)}


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line and not line.isspace() or _SPACE.sub("", line):
            again += line in seen
            seen.add(line)
    return again


def verdicts(col: pa.Array, max_lost: float = MAX_LOST) -> tuple[dict[str, np.ndarray], list[str]]:
    """The base counts, base_failed and kept of every text, and the cleaned texts."""
    out = base_counts(col)
    texts = [x or "" for x in col.to_pylist()]
    cleaned, lost = zip(*map(clean_lines, texts), strict=True) if texts else ((), ())
    out["n_dup_lines"] = np.array([duplicate_lines(x) for x in texts], np.int64)
    out["n_lost_words"] = np.array(lost, np.int64)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["n_lost_words"] <= max_lost * out["n_words"])
    return out, list(cleaned)


def quality_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The base counts and the verdict of every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words"]

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                found, _ = verdicts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(found[k], pa.int64()) for k in names], pa.array(found["base_failed"]),
                        pa.array(found["kept"])],
                    ["doc_id", *names, "base_failed", "kept"],
                )

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return arrow_map(rows, run, "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean")


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows that are kept, with failing lines removed from the text (and n_chars, if there is such a column, counted anew)."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                found, cleaned = verdicts(part.column(text))
                columns = list(part.columns)
                columns[part.schema.get_field_index(text)] = pa.array(cleaned, part.schema.field(text).type)
                at = part.schema.get_field_index("n_chars")
                if at >= 0:
                    columns[at] = pa.array([len(x) for x in cleaned]).cast(part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(found["kept"]))

    return arrow_map(docs, run, docs.schema)


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digests(table(spark, sf_dir, "documents"))
