"""Rendezvous (highest-random-weight) sharding of stable keys over weighted shards. Native: SQL functions only.

Each shard s draws u(key, s) in (0, 1) from the first 52 bits of md5("key:s"); the key goes to the shard with the
largest weight / -ln(u). Draws of other shards never change, so a new shard only takes rows and a removed one only
gives its own. With n equal shards one more takes about 1/(n+1) of the rows.

Slots: within a shard rows are ordered by (block, key, checksum, size), where block is a hash of the whole row, so
that no window spans a shard: row numbers run within (shard, block) and a prefix sum over the shards' blocks, a
small table, is added. Rows that are equal in every column used are counted first and expanded again by pieces, so
neither one repeated row nor one key can fill a task.

Edge cases. A null key is the text "null"; a null text has size 1 and checksum 0; an empty table gives no rows; extra
columns are ignored. One row out per row in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

SHARDS = 8
BLOCKS = 4096  # of slots in each shard; rows of a shard / BLOCKS are ordered at once
PIECE = 100_000  # equal rows that are expanded in one go


def draw(key: Column, shard: Column | int) -> Column:
    """A number in (0, 1), stable for key and shard."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.lit(shard).cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def choose(draws: list[Column], weights: list[float]) -> Column:
    """The shard of largest weighted draw; ties go to the lower number."""
    scores = [F.struct((F.lit(float(w)) / -F.log(u)).alias("score"), F.lit(-i).alias("n")) for i, (u, w) in enumerate(zip(draws, weights,
        strict=True))]
    return (-F.greatest(*scores)["n"] if len(scores) > 1 else F.lit(0)).cast("int")


def assign(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """Add the shard of each row's key."""
    draws = [draw(F.col(key), i) for i in range(len(weights))]
    return df.withColumn(out, choose(draws, weights))


def shard_documents(docs: DataFrame, weights: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, gapless slot within it, and the shard after one more (of mean weight) is added, for every row."""
    weights = weights or [1.0] * SHARDS
    grown = [*weights, sum(weights) / len(weights)]
    sized = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    distinct = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    draws = F.array(*[draw(F.col("doc_id"), i) for i in range(len(grown))])
    drawn = distinct.withColumn("u", draws)
    placed = drawn.select(
        "doc_id", "size", "text_crc32", "copies",
        choose([F.col("u")[i] for i in range(len(weights))], weights).alias("shard"),
        choose([F.col("u")[i] for i in range(len(grown))], grown).alias("grown_shard"),
        F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size",
            "text_crc32").cast("binary")), 1, 8), 16, 10).cast("long").alias("spread"),
    ).withColumn("block", F.pmod("spread", F.lit(BLOCKS)).cast("int")).drop("spread")
    placed = durable(placed)
    per_block = placed.groupBy("shard", "block").agg(F.sum("copies").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_block.select("shard", "block", before.alias("base"))
    inner = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    slots = placed.withColumn("first", F.coalesce(F.sum("copies").over(inner), F.lit(0))).join(starts, ["shard", "block"])
    pieces = slots.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / PIECE))))
    return pieces.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("base") + F.col("first") + F.col("piece") * PIECE,
            F.col("base") + F.col("first") + F.least(F.col("copies"), (F.col("piece") + 1) * PIECE) - 1)).alias("slot"),
        "grown_shard",
    )


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))

