"""Token files: concatenated ids with Elias-Fano document boundaries, written by Spark and read back.

Format. A data set of Parquet parts whose rows are pieces, each a run of documents in ascending doc_id order of
about PIECE_IDS ids (a longer document is a piece of its own): shard (the range partition), piece (its place in
the shard), n_ids, docs (the doc_ids), bounds and ids. `ids` is the plain array, 2 bytes an id while every id is
below 65,536 and 4 otherwise, little-endian. `bounds` is the Elias-Fano code of the documents' ends:

    "EF01" | bytes an id (u8) | low bits L (u8) | documents n (u64) | samples s (u32)
    | s select samples (u64) | n * L low bits, packed | upper bits: the i-th end e sets bit (e >> L) + i

with L = floor(log2(ids / documents)), so a boundary takes about L + 2 bits. The samples hold the place of every
SAMPLE-th set bit; EliasFano.end(i) goes to the nearest sample and counts on from there, without a table of 64-bit
offsets. Spark's committer makes the parts appear at once or not at all, so a lost executor's piece is redone whole.

Documents reach their range by one shuffle of the texts on (doc_id, hash of the text, place), in as many ranges as RANGE_BYTES
of text ask for, so neither an id nor a text that repeats fills a range; ids never move. Starts over the whole corpus are
prefix sums of the pieces' sizes, first within a shard and then over the shards' totals.

Edge cases. A null or empty text is the end id alone; null doc_ids come first; equal doc_ids are ordered by a
hash of their texts and keep one row each; an empty table gives an empty data set; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path
from .common import arrow_map, chunks, table, written
from .tokens import Encoder

END_ID = 1
PIECE_IDS = 1 << 20
RANGE_BYTES = 16 << 20
SAMPLE = 256
_HEAD = "<4sBBQI"


def ef_encode(ends: np.ndarray, width: int) -> bytes:
    """Non-decreasing ends (at least 1) to the bytes of the bounds column."""
    n, universe = len(ends), int(ends[-1]) if len(ends) else 0
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    high = (ends >> low_bits) + np.arange(n)
    upper = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    upper[high] = 1
    low = ((ends[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
    samples = high[::SAMPLE].astype("<u8")
    head = struct.pack(_HEAD, b"EF01", width, low_bits, n, len(samples))
    return head + samples.tobytes() + np.packbits(low, bitorder="little").tobytes() + np.packbits(upper, bitorder="little").tobytes()


class EliasFano:
    """Reads a bounds column; end(i) selects one boundary, ends() all."""

    def __init__(self, data: bytes):
        magic, self.width, self.low_bits, self.n, s = struct.unpack_from(_HEAD, data)
        if magic != b"EF01":
            raise ValueError("not an Elias-Fano boundary block")
        at = struct.calcsize(_HEAD)
        self.samples = np.frombuffer(data, "<u8", s, at)
        at += 8 * s
        size = -(-self.n * self.low_bits // 8)
        self.low = np.frombuffer(data, np.uint8, size, at)
        self.upper = np.frombuffer(data, np.uint8, offset=at + size)

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        b = a + self.low_bits
        whole = int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "little")
        return (whole >> (a % 8)) & ((1 << self.low_bits) - 1)

    def end(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        bits = int(self.upper[byte]) >> (place % 8) << (place % 8)
        while bits.bit_count() <= left:
            left -= bits.bit_count()
            byte += 1
            bits = int(self.upper[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def ends(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high << self.low_bits) | (bits << np.arange(self.low_bits)).sum(1)


PIECES = "shard int, piece int, n_ids long, docs array<long>, bounds binary, ids binary"


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode, write the data set into the shared folder, and return it as read back."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))

    def run(batches):
        encoder, shard, piece = Encoder.of(path), TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        total = 0

        def pack():
            ids = np.concatenate(held)
            width = 2 if int(ids.max()) < 1 << 16 else 4
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([piece], pa.int32()), pa.array([total], pa.int64()), pa.array([keys],
                    pa.list_(pa.int64())), pa.array([ef_encode(np.cumsum(sizes), width)], pa.binary()),
                    pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary())],
                ["shard", "piece", "n_ids", "docs", "bounds", "ids"],
            )

        for batch in batches:
            for part in chunks(batch):
                ids, bounds = encoder.batch(part.column("text"))
                for i, k in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype(np.uint32)
                    if total and total + len(own) > PIECE_IDS:
                        yield pack()
                        keys, held, sizes, total, piece = [], [], [], 0, piece + 1
                    keys.append(k)
                    held.append(own)
                    sizes.append(len(own))
                    total += len(own)
        if keys:
            yield pack()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.withColumns({"text_hash": F.xxhash64("text"), "place": F.xxhash64(F.monotonically_increasing_id())})
    keys = [F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc(), F.col("place").asc()]
    ranged = ranged.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return written(arrow_map(ranged, run, PIECES), "token-files")


def read_tokens(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 and (if wanted) the ids' bytes as unsigned 32-bit, from the written data set; each
    document's boundaries are selected from the code."""
    sizes = files.select("shard", "piece", "n_ids")
    in_shard = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    bases = whole.select("shard", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    starts = (
        sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(in_shard), F.lit(0)))
        .join(bases, "shard")
        .select("shard", "piece", (F.col("base") + F.col("before")).alias("start"))
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                code = EliasFano(row["bounds"])
                ends = np.fromiter((code.end(i) for i in range(code.n)), np.int64, code.n)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                ids = np.frombuffer(row["ids"], f"<u{code.width}").astype("<u4")
                spans = list(zip(begins, ends, strict=True))
                columns = [pa.array(row["docs"], pa.int64()), pa.array(begins + row["start"], pa.int64()), pa.array(ends - begins,
                    pa.int64()), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    located = files.join(starts, ["shard", "piece"]).select("docs", "bounds", "ids", "start")
    return arrow_map(located, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), default_path()), with_ids=False)
