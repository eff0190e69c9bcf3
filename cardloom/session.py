"""Make this package importable in the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="cardloom-")) / "cardloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    context.addPyFile(str(to))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder. Where
    neither is set, one is made on a single machine only; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cardloom-shared-")
        spark.sparkContext.setCheckpointDir(f"file://{path}")
        path = spark.sparkContext.getCheckpointDir()
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder (compressed columns, atomic commit) and read it back: it cuts the lineage, so a
    lost executor costs no recomputation, and plans stay small."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FEW_ROWS = 200_000  # narrow rows: some 10 MB


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows are counted to be few; else its join is shuffled."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df
