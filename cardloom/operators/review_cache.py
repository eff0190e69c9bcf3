"""Reviews by content: what was asked once is never asked again, and equal questions are asked once.

A question's key is a hash of all that its answer may depend on: the version of the prompt, the scope, the card without its
spacing, and the metadata that goes with it. `answered` takes the answers known from the cache, asks for the missing keys, one
representative each, appends the new answers, and gives every repository its answer. The cache is an append-only Parquet table
whose later entries win; `compacted` leaves one entry for each key.

Edge cases. Blank cards are never asked about: they are unknown / low; a question without an answer (null) isn't stored and will be
asked again; a cache that doesn't exist is empty; two appends of one key leave the later; an empty table asks nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import reviews as R

PROMPT_VERSION = "review-1"
ENTRY = f"key string, review {R.REVIEW}, stored_at timestamp"


def keyed(questions: DataFrame, scope: str = "text_llm", version: str = PROMPT_VERSION) -> DataFrame:
    """Adds card_hash and key (null for a blank card). Questions bear repo_id, card, pipeline_tag, library_name, tags, relation,
    base_models and params."""
    text = F.trim(F.regexp_replace(F.coalesce("card", F.lit("")),
        r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "))
    of = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    rows = questions.withColumn("card_hash", F.when(text != "", F.sha2(text, 256)))
    parts = [
        F.lit(version), F.lit(scope), F.col("card_hash"), of("pipeline_tag"), of("library_name"), joined(F.sort_array(F.coalesce("tags",
            F.array().cast("array<string>")))), of("relation"), joined("base_models"),
        F.coalesce("params", F.lit(0)).cast("string"),
    ]
    separated = [x for p in parts for x in (F.unhex(F.lit("00")), p.cast("binary"))][1:]
    return rows.withColumn("key", F.when(F.col("card_hash").isNotNull(), F.sha2(F.concat(*separated), 256)))


def load(spark: SparkSession, path: str) -> DataFrame:
    """key and review, the last stored of each key."""
    try:
        rows = spark.read.schema(ENTRY).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"key string, review {R.REVIEW}")
    later = F.struct("stored_at", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    return rows.where("key <> ''").groupBy("key").agg(F.max_by("review", later).alias("review"))


def append(answers: DataFrame, path: str) -> None:
    """Store key and review; the commit makes all rows appear at once."""
    answers.where("review IS NOT NULL AND key <> ''").select("key", "review",
        F.current_timestamp().alias("stored_at")).write.mode("append").parquet(path)


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """One entry for each key, in a new table."""
    load(spark, path).withColumn("stored_at", F.current_timestamp()).write.mode("overwrite").parquet(to)


def planned(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds how each question is met: blank, cached, asked (the one that is put for its key) or shared."""
    rows = questions.join(cache.select("key", F.lit(True).alias("_known")), "key", "left")
    first = rows.where("key IS NOT NULL AND _known IS NULL").groupBy("key").agg(F.min("repo_id").alias("_first"))
    how = F.when(F.col("key").isNull(), "blank").when(F.col("_known"), "cached").when(F.col("repo_id") == F.col("_first"),
        "asked").otherwise("shared")
    return rows.join(first, "key", "left").withColumn("how", how).drop("_known", "_first")


def answered(questions: DataFrame, path: str, ask: Callable[[DataFrame], DataFrame], **key) -> DataFrame:
    """repo_id and review of every question. `ask` gets the questions that must be put (with key) and returns key and review."""
    spark = questions.sparkSession
    rows = written(planned(keyed(questions, **key), load(spark, path)), "questions")
    new = written(ask(rows.where("how = 'asked'").dropDuplicates(["key"])).select("key", "review"), "answers")
    append(new, path)
    known = load(spark, path).join(rows.select("key").distinct(), "key", "left_semi")
    found = rows.join(known, "key", "left")
    return found.select("repo_id", F.when(F.col("how") == "blank",
        R.without_card("model card is empty")).otherwise(F.col("review")).alias("review"))
