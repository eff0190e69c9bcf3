"""What the ten training-data operators share: durable intermediate tables, byte-level words and 64-bit hashes.

Words: A-Z lower-cased, then maximal runs of characters outside the ASCII punctuation, space and control
ranges (digits, a-z and everything from U+0080 up). Every character from U+0080 up has only bytes >= 0x80 in
UTF-8, so words can be cut from the raw bytes of a whole Arrow batch at once, with no per-row Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, written

CHUNK_BYTES = 512 << 10  # bytes of text that a Python worker handles at once
PIECE_BYTES = 256 << 10  # bytes that are hashed at once, also of a longer text or word
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_leave: dict[str, Callable[[], None]] = {}
_last = ""


def on_leave(module: str, clear: Callable[[], None]) -> None:
    """What frees a module's caches when a reused worker turns to another operator."""
    _leave[module] = clear


def _enter(module: str) -> None:
    global _last
    if module == _last:
        return
    _last = module
    for name, clear in _leave.items():
        if name != module:
            clear()
    _trim()


def _trim() -> None:
    """Give freed memory back to the system: a reused worker keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def arrow_map(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with this package importable in the workers, which hold one operator's caches at a time."""
    ship(df.sparkSession)
    module = run.__module__

    def tidy(batches):
        _enter(module)
        yield from run(batches)
        _trim()

    return df.mapInArrow(tidy, schema)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder, so a lost executor costs no recomputation.

    Not DataFrame.checkpoint(): its plan keeps the constraints of all it came from, and they grow exponentially over
    the turns of a loop of joins.
    """
    return written(df, "step")


def drop(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


BROADCAST_ROWS = 200_000  # narrow rows: some 10 MB


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows are counted to be few; else the join is shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


HEAVY = 1000  # rows of a key that make it a key of its own in lookup


def lookup(rows: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """rows left-joined with entries, which has one row for each key. Keys of over HEAVY rows are joined by broadcast of their
    entries (if those are few), so no key's rows meet in one task. rows are read three times: pass a written table."""
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select(key)
    heavy = durable(entries.join(many, key, "left_semi"))
    if heavy.isEmpty():
        return rows.join(entries, key, "left")
    return rows.join(small(heavy), key).unionByName(rows.join(small(heavy.select(key)), key, "left_anti").join(entries, key, "left"))


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among keys (one row each): by broadcast if the keys are few; else keys of over HEAVY rows are decided by
    broadcast, and only the other rows are shuffled."""
    few = small(keys)
    if few is not keys:
        return rows.join(few, key, "left_anti")
    many = durable(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select(key))
    heavy, many = small(durable(keys.join(many, key, "left_semi"))), small(many)
    often = rows.join(many, key, "left_semi").join(heavy, key, "left_anti")
    return often.unionByName(rows.join(many, key, "left_anti").join(keys, key, "left_anti"))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


class Powers:
    """p^0..p^n and inverse powers modulo 2^64, for n up to PIECE_BYTES."""

    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def to(cls, n: int) -> None:
        while len(cls.up) < n:
            k = len(cls.up)
            with np.errstate(over="ignore"):
                step, back = _U(pow(int(_P), k, 1 << 64)), _U(pow(int(_P), -k, 1 << 64))
                cls.up = np.concatenate([cls.up, cls.up * step])
                cls.down = np.concatenate([cls.down, cls.down * back])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (public domain)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the n+1 offsets; a null text has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(col) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(col) else np.zeros(1, np.int64)


def chunks(batch: pa.RecordBatch, text: str = "text"):
    """Slices of a batch with about CHUNK_BYTES of text each; a longer text is a slice of its own."""
    col = batch.column(batch.schema.get_field_index(text))
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64))
    at = 0
    while at < len(size):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + CHUNK_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[0x09:0x0E] = _NOT_SPACE[0x20] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes that `inside` holds true; a run ends where its row ends."""
    flag = np.zeros(len(data) + 1, bool)
    flag[:-1] = inside[data]
    begins = flag.copy()
    begins[1:] &= ~flag[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begins[edge] |= flag[edge]
    start = np.flatnonzero(begins)
    closes = flag[:-1] & (~flag[1:] | begins[1:])
    end = np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of values (bytes or code points), spans in ascending order and apart: a polynomial modulo 2^64.

    Spans are taken in runs of PIECE_BYTES values, and a longer span in pieces, so memory doesn't grow with the text."""
    Powers.to(PIECE_BYTES + 1)
    out = np.empty(len(start), _U)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            base = int(start[at])
            to = int(np.searchsorted(end, base + PIECE_BYTES, "right"))
            if to <= at:
                total = _U(0)
                for a in range(base, int(end[at]), PIECE_BYTES):
                    part = data[a : min(a + PIECE_BYTES, int(end[at]))].astype(_U) + _U(1)
                    total = total + (part * Powers.up[: len(part)]).sum() * _U(pow(int(_P), a - base, 1 << 64))
                out[at] = total
                at += 1
                continue
            stop = int(end[to - 1])
            run = np.zeros(stop - base + 1, _U)
            np.cumsum((data[base:stop].astype(_U) + _U(1)) * Powers.up[: stop - base], out=run[1:])
            s, e = start[at:to] - base, end[at:to] - base
            out[at:to] = (run[e] - run[s]) * Powers.down[s]
            at = to
        return mix(out + (end - start).astype(_U))


def hashed_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the first word of each text (n+1 bounds)."""
    data, offsets = text_bytes(col)
    data = _LOWER[data]
    start, end, row = word_spans(data, offsets, _WORD_BYTE)
    return span_hashes(data, start, end), np.searchsorted(row, np.arange(len(offsets)))


def space_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words between blanks: bytes, starts, ends, and the first word of each text (n+1 bounds)."""
    data, offsets = text_bytes(col)
    start, end, row = word_spans(data, offsets, _NOT_SPACE)
    return data, start, end, np.searchsorted(row, np.arange(len(offsets)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) with the least node as root, for nodes that have an edge.

    By contraction: every node hooks to its least neighbour, hooks are followed to their end by doubling, and edges are
    rewritten between the ends; edges inside a tree are gone, so tables shrink from turn to turn, at least by half in nodes.
    """
    edges = durable(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    turns: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:
            top = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            new = durable(up.join(top, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            drop(up)
            up = new.select("node", "root")
            if new.where("moved").isEmpty():
                break
        turns.append(up)
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("node").alias("b"),
            F.col("root").alias("rb")), "b")
        left = durable(ends.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        drop(edges)
        edges = left
    if not turns:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = turns[0]
    for up in turns[1:]:
        found = found.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node",
            F.coalesce("top", "root").alias("root"))
    return found
