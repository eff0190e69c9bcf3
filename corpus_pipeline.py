"""From raw documents to token ids: quality rules, toxicity, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again. All stages but the last return the columns of documents.

Edge cases, for every stage. An empty table gives an empty one; ids may be null or repeat, and extra columns pass through;
texts are read whole. A null or empty text has no words, so the quality rules reject it; were it handed to a later stage,
toxicity would keep it, near-dedup would keep one of all texts without words, decontamination would keep it, and BPE would
give it no tokens. Without labels of both classes no document is predicted toxic unless most labels are. ORACLE_SQL is None: SQL expresses neither the trained
classifier nor the sketches; the stages are tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import bpe, decontamination, near_dedup, quality_rules, toxicity
from cardloom.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; rejected documents (null and empty ones too) go."""
    return quality_rules.clean_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is trained on the labelled rows of its own input; predicted documents go. A null or empty text stays."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the least by id, then text; a null id comes last."""
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; without benchmark items none does."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, one row for each row."""
    return bpe.encode_digests(docs, bpe.default_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
