"""The place of every row in one global order, without a window in a single task.

Rows are range-partitioned and sorted on the order's keys and written with their partition and their place in it; the sizes of the
partitions, one small row each, are summed up and joined back, so a row's place is its partition's offset plus its own.

Edge cases. Rows equal in all keys get different places in no stated order: end the keys with something unique. An empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .selection import SORTS, Selection


def numbered(rows: DataFrame, keys: list[Column], name: str = "place") -> DataFrame:
    """Adds `name`: 0 for the first row by the keys, and so on."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = written(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def record_order(selections: tuple[Selection, ...]) -> list[Column]:
    """Records follow each other by selection, then by the selection's own sort, then by repository."""
    nth, number, down = F.lit(len(selections)), F.lit(None).cast("long"), F.lit(None).cast("string")
    for i, s in enumerate(selections):
        mine = F.col("selection") == s.name
        nth = F.when(mine, i).otherwise(nth)
        if s.sort_by == "repo_id":
            down = F.when(mine, F.col("repo_id")).otherwise(down) if s.sort_direction == "desc" else down
            continue
        column = F.col(SORTS[s.sort_by])
        value = F.coalesce(F.unix_micros(column.cast("timestamp")) if s.sort_by == "created_at" else column.cast("long"), F.lit(0))
        number = F.when(mine, value if s.sort_direction == "asc" else -value).otherwise(number)
    return [nth.asc(), number.asc(), down.desc(), F.col("repo_id").asc(), F.col("ordinal").asc()]
