"""Multi-party perspective rotation of dialogues. Native: SQL functions only.

For every participant of a dialogue (a role other than system) the whole dialogue is rendered once: that speaker's
messages as "assistant", with loss mask 1 over their content and end mark, all others' as "user" with their name and
mask 0, system messages as "system" with mask 0. The result has a row for each message of each rendering: its place,
its rendered segment, and the code point offsets of the segment and of the masked span in the rendering, which is the
segments in order of place; the name is empty and the masked span -1 where there is none. A dialogue is never gathered into one value or one task: places and offsets are sums
within blocks of BLOCK turns plus a prefix sum over the blocks.

    <|system|>\\ntext<|end|>\\n      <|user name=NAME|>\\ntext<|end|>\\n      <|assistant|>\\ntext<|end|>\\n

A text can't forge a mark: in it `<|` becomes `<\\|` (more backslashes between get one more), and in a name in a header `|` and
line ends become blanks.

Edge cases. Messages are ordered by turn (null last), role, text; equal messages keep a row each. A null text is
empty; a null or blank role is the speaker "unknown". A dialogue of system messages only has no participant and no
rows; a null conv_id is a dialogue of its own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

BLOCK = 64
SYSTEM, UNKNOWN = "system", "unknown"
LAST_TURN = (1 << 62) - 1


def rotate(messages: DataFrame) -> DataFrame:
    """conv_id, perspective, place, turn, role, name, segment, start, stop, mask, mask_start, mask_stop."""
    speaker = F.when(F.trim(F.coalesce("role", F.lit(""))) == "", F.lit(UNKNOWN)).otherwise(F.trim("role"))
    own = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), F.regexp_replace(F.coalesce("text", F.lit("")), r"<(\\*)\|", r"<\\$1|").alias("text"))
    own = own.groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("copies"))
    own = own.withColumn("block", F.floor(F.coalesce("turn", F.lit(LAST_TURN)) / BLOCK))
    people = own.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    # speakers meet a dialogue's blocks first, and each block's messages then: no dialogue's messages meet in one task
    dealt = own.select(F.col("conv_id").alias("c0"), F.col("block").alias("b0")).distinct().join(people, F.col("c0").eqNullSafe(F.col("conv"))).drop("conv")
    seen = own.join(dealt, F.col("conv_id").eqNullSafe(F.col("c0")) & (F.col("block") == F.col("b0"))).drop("c0", "b0")
    is_own, is_system = F.col("speaker") == F.col("perspective"), F.col("speaker") == SYSTEM
    header = F.when(is_system, F.lit("<|system|>\n")).when(is_own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.translate("speaker", "|\n\r", "   "), F.lit("|>\n")))
    seen = seen.select("*", F.char_length(header).cast("long").alias("head"), F.concat(header, F.col("text"), F.lit("<|end|>\n")).alias("segment"), is_own.alias("mask"))
    seen = seen.withColumn("size", F.char_length("segment").cast("long"))
    seen = durable(seen)
    sums = seen.groupBy("conv_id", "perspective", "block").agg(F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("chars"))
    over = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = sums.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(over), zero).alias("n0"), F.coalesce(F.sum("chars").over(over), zero).alias("chars0"),
    )
    inner = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumns({"n1": F.coalesce(F.sum("copies").over(inner), zero), "chars1": F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inner), zero)})
    placed = placed.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    each = placed.withColumn("i", F.explode(F.sequence(zero, F.col("copies") - 1)))
    start = F.col("chars0") + F.col("chars1") + F.col("i") * F.col("size")
    each = each.withColumn("start", start)
    role = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(F.col("mask"), F.lit("assistant")).otherwise(F.lit("user"))
    return each.select(
        "conv_id", "perspective", (F.col("n0") + F.col("n1") + F.col("i")).alias("place"), "turn", role.alias("role"),
        F.when((F.col("speaker") != SYSTEM) & ~F.col("mask"), F.col("speaker")).otherwise("").alias("name"), "segment",
        "start", (F.col("start") + F.col("size")).alias("stop"), F.col("mask").cast("int").alias("mask"),
        F.when(F.col("mask"), F.col("start") + F.col("head")).otherwise(-1).alias("mask_start"), F.when(F.col("mask"), F.col("start") + F.col("size") - 1).otherwise(-1).alias("mask_stop"),
    )


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH m AS (SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM m WHERE speaker <> 'system'),
s AS (SELECT conv_id, perspective, turn, speaker, text,
  CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || translate(speaker, '|' || chr(10) || chr(13), '   ') || '|>' || chr(10) END AS header
  FROM m JOIN p ON conv_id IS NOT DISTINCT FROM c),
g AS (SELECT *, header || text || '<|end|>' || chr(10) AS segment FROM s),
w AS (SELECT *, length(segment) AS size, row_number() OVER o - 1 AS place, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM g WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
SELECT conv_id, perspective, CAST(place AS BIGINT) AS place, CAST(turn AS BIGINT) AS turn,
  CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker ELSE '' END AS name, segment,
  CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop, CAST(speaker = perspective AS INTEGER) AS mask,
  CASE WHEN speaker = perspective THEN CAST(start + length(header) AS BIGINT) ELSE -1 END AS mask_start,
  CASE WHEN speaker = perspective THEN CAST(start + size - 1 AS BIGINT) ELSE -1 END AS mask_stop
FROM w
"""
