"""Landed snapshots: checkpoints of a scan, card shards, texts of single repositories, caches and baselines.

A checkpoint is a Parquet table of models beside a one-row Parquet table of what was scanned. It is read only if complete and
made for the same endpoint, window and weight rule; otherwise it counts as absent.

Edge cases. A missing, unreadable or partial checkpoint gives None; a baseline that can't be read gives None; a repository
without a text has an empty one; the last row of a repeated id wins by file and place.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hub import CARD_COLUMNS

SCAN = "endpoint string, earliest string, latest string, require_weights boolean, complete boolean, pages long, scanned long"


@dataclass(frozen=True)
class Scan:
    endpoint: str
    earliest: str
    latest: str
    require_weights: bool = True
    complete: bool = True
    pages: int = 0
    scanned: int = 0

    def same(self, other: Scan) -> bool:
        return self.complete and (self.endpoint, self.earliest, self.latest, self.require_weights) == (other.endpoint, other.earliest,
            other.latest, other.require_weights)


def save_checkpoint(models: DataFrame, path: str, scan: Scan) -> bool:
    """Only a complete scan is kept: the models first, then the row that makes them count."""
    if not path or not scan.complete:
        return False
    models.write.mode("overwrite").parquet(f"{path}/models")
    models.sparkSession.createDataFrame([tuple(asdict(scan).values())], SCAN).coalesce(1).write.mode("overwrite").parquet(f"{path}/scan")
    return True


def load_checkpoint(spark: SparkSession, path: str, wanted: Scan) -> DataFrame | None:
    if not path:
        return None
    try:
        row = spark.read.schema(SCAN).parquet(f"{path}/scan").first()
        if row is None or not Scan(**row.asDict()).same(wanted):
            return None
        return spark.read.parquet(f"{path}/models")
    except AnalysisException:
        return None


def shard_paths(base: str, count: int) -> list[str]:
    """One file as it is named; several with a number of four digits before the extension."""
    stem, dot, extension = base.rpartition(".")
    return [base] if count <= 1 else [f"{stem}-{i:04d}{dot}{extension}" for i in range(count)]


def placed_cards(spark: SparkSession, *paths: str) -> DataFrame:
    """Card shards with their place: by file, then by row in it, independent of how files are split."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return spark.read.parquet(*paths).select(*CARD_COLUMNS, place.alias("place"))


def latest_cards(spark: SparkSession, *paths: str) -> DataFrame:
    """Card shards with one row for each id: the last by file and row."""
    rows = placed_cards(spark, *paths)
    return rows.groupBy("modelId").agg(F.max_by(F.struct("createdAt", "card"), "place").alias("c")).select("modelId", "c.createdAt",
        "c.card")


def with_readmes(models: DataFrame, readmes: DataFrame) -> DataFrame:
    """Adds readme: the repository's own text, empty where none was found."""
    return models.join(readmes.select("repo_id", "readme"), "repo_id", "left").withColumn("readme", F.coalesce("readme", F.lit("")))


def baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """selection, confirmed, derivatives of a summary.json, or None if it can't be read."""
    try:
        text = spark.read.text(path, wholetext=True)
        item = "struct<total_training_cost_usd:double,training_cost_by_kind:map<string,double>>"
        rows = text.select(F.from_json("value",
            f"struct<selections:map<string,{item}>>").alias("s")).where("s.selections IS NOT NULL").select(F.explode("s.selections").alias("selection", "v"))
        if rows.isEmpty():
            return None
    except AnalysisException:
        return None
    kind = lambda k: F.coalesce(F.try_element_at("v.training_cost_by_kind", F.lit(k)), F.lit(0.0))
    return rows.select("selection", F.coalesce("v.total_training_cost_usd", F.lit(0.0)).alias("confirmed"),
        (kind("finetune") + kind("adapter")).alias("derivatives"))
