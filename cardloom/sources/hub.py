"""Hub-shaped tables: schemas, readers, and views over the driver's tables with the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import KIND_OVERRIDES
from ..operators.card_signals import CLAIM, COMPUTE
from ..operators.reviews import KINDS, REVIEW

CARD_COLUMNS = ["modelId", "createdAt", "card"]
SUFFIXES = ("", "-lora", "-sft", "-GGUF", "-merged", "-step-100", "-Base", "-chat", "-hf", "-abliterated", "_fp16", "-20240115")
PIPELINES = ("text-generation", "fill-mask", "text-to-image", "image-segmentation", "")
LIBRARIES = ("transformers", "peft", "diffusers", "MLX", "transformers", "")
TAGS = ("llm", "GGUF", "LoRA", "merge", "sft", "base_model:adapter:x/y", "base_model:x/y", "4-bit", "stable-diffusion", "speech", "bert",
    "en", "fr")
SIZES = (0, 1_999_999_999, 2_000_000_000, 7_000_000_000, 13_000_000_000, 34_000_000_000, 70_000_000_000, 120_000_000_000, 500_000_000_000)
RELATIONS = ("quantized", "merge", "adapter", "finetune", "", "", "", "", "", "", "")
FILES = ("model.safetensors", "tokenizer.bin", "training_args.bin", "adapter_model.bin", "sub/model.gguf", "config.json",
    "weights.data-00001-of-00002")
CARD_DATA = (
    "", '{"base_model": "x/y"}', '{"base_model": ""}', '{"base_models": []}', '{"baseModel": false}', '{"tags": ["LoRA", "en"]}',
        '{"tags": "GGUF"}', '{"base_model": {}}', '{"license": "mit"}', "not json",
    '{"base_model": ["a/b", "c/d"]}', '{"base_model": null}', "", "", "", "", "", "", "", "", "", "", "", "", "", "", "", "", "", "", "",
)
CLAIMS = (
    "", "This model was trained from scratch on 2.5 trillion tokens.", "Trained for 36 hours on 8 A100 GPUs.",
        "Training cost: $1,250.50 in total.",
    "We used 5000 GPU hours.", "Pretrained on 300 billion tokens in 2025.", "It uses 3B active parameters.",
        "Training dates: 2024-11 to 2025-03.",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(values: tuple, key: str):
    return F.array(*[F.lit(v) for v in values])[F.pmod(F.col(key), F.lit(len(values))).cast("int")]


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    owner = F.concat(F.lit("org"), F.col("o_custkey").cast("string"))
    repo = F.concat(owner, F.lit("/m-"), F.col("o_orderkey").cast("string"), _of(SUFFIXES, "o_orderkey"))
    repo = F.when(F.col("o_orderkey").between(1, len(KIND_OVERRIDES)), _of(tuple(KIND_OVERRIDES),
        "o_orderkey")).when(F.col("o_orderkey").between(18, 24), F.concat(F.lit("solo"),
        F.col("o_orderkey").cast("string"))).otherwise(repo)
    return o.select(
        F.col("o_orderkey").alias("ordinal"), repo.alias("repo_id"),
        F.when(F.col("o_orderkey") % 3 == 0, owner).otherwise(F.lit("")).alias("author"), F.col("o_orderdate").alias("created_at"),
        F.floor("o_totalprice").alias("downloads"), (F.col("o_custkey") % 97).alias("likes"), _of(PIPELINES,
            "o_orderkey").alias("pipeline_tag"),
        _of(LIBRARIES, "o_orderkey").alias("library_name"), F.array(_of(TAGS, "o_orderkey"), F.when(F.col("o_orderkey") % 103 != 0,
            _of(TAGS, "o_custkey"))).alias("tags"),
        F.when(F.col("o_orderkey") % 101 != 0, _of(SIZES, "o_orderkey").cast("long")).alias("params"), _of(RELATIONS,
            "o_orderkey").alias("relation"),
        F.array(_of(FILES, "o_orderkey"), _of(FILES, "o_custkey")).alias("files"), F.when(F.col("o_orderkey") % 13 == 0,
            F.concat(F.lit("base/p-"), (F.col("o_orderkey") % 200 + 1).cast("string"))).alias("base_model"),
        _of(CARD_DATA, "o_orderkey").alias("card_data"),
    )


RUNS = ("Org Model 7B", "alpha/beta run", "x", "unknown")
EVIDENCE_TYPES = ("explicit_scratch", "pretraining_evidence", "declared_base_model")
CONFIDENCE = ("high", "medium", "low")


def _made(fields: dict[str, str], kind: str):
    """A struct of SQL expressions, in the order and with the types of a schema; fields without one are null."""
    names = [f.split(":")[0] for f in kind[7:-1].split(",")]
    return F.expr("named_struct(" + ", ".join(f"'{n}', {fields.get(n, 'NULL')}" for n in names) + ")").cast(kind)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up signals of the models, by ordinal."""
    m = models(spark, sf_dir)
    pick = lambda values, key: "array(" + ", ".join(f"'{v}'" for v in values) + f")[cast({key} as int)]"
    compute = _made({
        "hours": "ordinal % 40 + 1.0D", "gpu_count": "8", "gpu_hours": "(ordinal % 40 + 1) * 8.0D",
            "cost_usd": "(ordinal % 50) * 100 + 10.0D",
            "cost_method": "if(ordinal % 2 = 0, 'gpu_hours_x_hourly_rate', 'reported_total_cost')",
        "run_hash": "if(ordinal % 7 = 0, '', concat('run', ordinal % 211))", "evidence_hash": "concat('ev', ordinal % 401)",
            "training_years": "if(ordinal % 5 = 0, array(1990 + ordinal % 3 * 5), array())",
        "evidence": "if(ordinal % 12 = 0, 'a LoRA adapter', if(ordinal % 12 = 6, 'SFT fine-tuning run', 'a run'))",
            "earliest": "if(ordinal % 11 = 0, '1990-01-01T00:00:00Z', NULL)",
    }, COMPUTE)
    claim = _made({
        "evidence_type": pick(EVIDENCE_TYPES, "ordinal % 3"),
            "claimed_trainer": "if(ordinal % 13 = 0, 'Somebody Else', if(ordinal % 17 = 0, 'Org', ''))",
            "training_years": "if(ordinal % 19 = 0, array(1990), array())",
        "active_parameters_b": "if(ordinal % 8 = 0, 3.0D, 0.0D)", "training_tokens_t": "if(ordinal % 6 = 0, 2.5D, 0.0D)",
            "card_hash": "concat('card', ordinal % 300)", "run_hash": "if(ordinal % 5 = 0, '', concat('claim', ordinal % 307))",
            "evidence": "'told'", "source": "'card'", "earliest": "if(ordinal % 23 = 0, '1990-01-01T00:00:00Z', NULL)",
    }, CLAIM)
    return m.select(
        F.col("repo_id").alias("modelId"), F.when(F.col("ordinal") % 3 == 0, compute).alias("compute"), F.when(F.col("ordinal") % 4 != 1,
            claim).alias("claim")
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up reviews of some models, by ordinal."""
    pick = lambda values, key: "array(" + ", ".join(f"'{v}'" for v in values) + f")[cast({key} as int)]"
    kind = pick(KINDS, "floor(ordinal / 9) % 9")
    review = _made({"kind": kind, "confidence": pick(CONFIDENCE, "ordinal % 3"),
        "independently_pretrained": f"{kind} = 'independent_base'", "parameter_count_b": "if(ordinal % 5 = 0, 1.5D, 0.0D)",
        "canonical_training_run": pick(RUNS, "ordinal % 4"), "training_years": "array()", "evidence": "'Trained here.'"}, REVIEW)
    return models(spark, sf_dir).where("ordinal % 9 < 4").select("repo_id", review.alias("review"))


def base_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("base/p-"), F.col("p_partkey").cast("string")).alias("base_id"),
        (F.col("p_size").cast("long") * 1_000_000_000).alias("base_params"))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner profiles: organizations first, users otherwise."""
    c = _table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "organization").when(F.col("c_mktsegment") == "HOUSEHOLD", "user")
    return c.select(F.concat(F.lit("org"), F.col("c_custkey").cast("string")).alias("owner"), kind.alias("owner_type"),
        F.col("c_name").alias("full_name")).where("owner_type IS NOT NULL")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("card_no"), F.concat(F.lit("card/"), F.col("doc_id").cast("string")).alias("modelId"),
            F.concat(F.lit("2025-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-01T00:00:00Z")).alias("createdAt"),
        F.concat_ws(" ", _of(CLAIMS, "doc_id"), F.col("text")).alias("card"),
    )


README = "Training took 10 hours on 4 H100 GPUs."
METADATA = {7: '{"train_runtime": 7200}', 13: '{"training_hours": 12.5, "about": "It was trained from scratch."}'}  # by ordinal % 20
CARD_YEARS = (1996, 1996, 1993, 1996, 1997, 1994, 1999, 1996)
OLD_CARD = "Training cost: $9,999.00 in total."


def with_run_metadata(models: DataFrame) -> DataFrame:
    """Some models state their training time in their metadata."""
    told = F.col("card_data")
    for rest, text in METADATA.items():
        told = F.when(F.col("ordinal") % 20 == rest, text).otherwise(told)
    return models.withColumn("card_data", told)


def model_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of models, one for each document of the same number; some have an older row before it."""
    names = models(spark, sf_dir).select(F.col("ordinal").alias("card_no"), "repo_id")
    first = F.concat(_of(CARD_YEARS, "card_no").cast("string"), F.lit("-01-01T00:00:00Z"))
    told = F.replace("card", F.lit("2024-11 to 2025-03"), F.lit("1990-01 to 1990-03"))
    rows = cards(spark, sf_dir).drop("modelId").join(names, "card_no").select(F.col("repo_id").alias("modelId"), first.alias("createdAt"),
        told.alias("card"), F.col("card_no").alias("place"))
    old = rows.where("place % 16 = 2").select("modelId", F.lit("2020-01-01T00:00:00Z").alias("createdAt"), F.lit(OLD_CARD).alias("card"),
        (-F.col("place")).alias("place"))
    return rows.union(old)


def readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir).where("ordinal % 6 = 1").select("repo_id", F.lit(README).alias("readme"))


def _sql_of(values: tuple, key: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[CAST({key} % {len(values)} AS INTEGER) + 1]"


VIEWS = f"""
models AS (SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey BETWEEN 1
    AND {len(KIND_OVERRIDES)} THEN {_sql_of(tuple(KIND_OVERRIDES), "o_orderkey")} WHEN o_orderkey BETWEEN 18 AND 24
    THEN 'solo' || o_orderkey
    ELSE 'org' || o_custkey || '/m-' || o_orderkey || {_sql_of(SUFFIXES, "o_orderkey")} END AS repo_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'org' || o_custkey ELSE '' END AS author, o_orderdate AS created_at,
      CAST(floor(o_totalprice) AS BIGINT) AS downloads,
  o_custkey % 97 AS likes, {_sql_of(PIPELINES, "o_orderkey")} AS pipeline_tag, {_sql_of(LIBRARIES, "o_orderkey")} AS library_name,
  [{_sql_of(TAGS, "o_orderkey")}, CASE WHEN o_orderkey % 103 <> 0 THEN {_sql_of(TAGS, "o_custkey")} END] AS tags, CASE
      WHEN o_orderkey % 101 <> 0 THEN CAST({_sql_of(SIZES, "o_orderkey")} AS BIGINT) END AS params,
      {_sql_of(RELATIONS, "o_orderkey")} AS relation,
  [{_sql_of(FILES, "o_orderkey")}, {_sql_of(FILES, "o_custkey")}] AS files, CASE WHEN o_orderkey % 13 = 0
      THEN 'base/p-' || (o_orderkey % 200 + 1) END AS base_model, {_sql_of(CARD_DATA, "o_orderkey")} AS card_data FROM orders),
base_params AS (SELECT 'base/p-' || p_partkey AS base_id, CAST(p_size AS BIGINT) * 1000000000 AS base_params FROM part),
owners AS (SELECT * FROM (SELECT 'org' || c_custkey AS owner, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'organization'
    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'user' END AS owner_type, c_name AS full_name FROM customer) WHERE owner_type IS NOT NULL),
cards AS (SELECT doc_id AS card_no, 'card/' || doc_id AS modelId, '2025-0' || (doc_id % 9 + 1) || '-01T00:00:00Z' AS createdAt,
    {_sql_of(CLAIMS, "doc_id")} || ' ' || text AS card FROM documents),
signals AS (SELECT ordinal, ordinal % 3 = 0 AS told, ordinal % 40 + 1.0 AS r_hours, (ordinal % 50) * 100 + 10.0 AS r_cost, CASE
    WHEN ordinal % 2 = 0 THEN 'gpu_hours_x_hourly_rate' ELSE 'reported_total_cost' END AS r_method,
  CASE WHEN ordinal % 3 <> 0 OR ordinal % 7 = 0 THEN '' ELSE 'run' || (ordinal % 211) END AS run_hash, CASE WHEN ordinal % 3 = 0
      THEN 'ev' || (ordinal % 401) ELSE '' END AS evidence_hash,
  CASE WHEN ordinal % 5 = 0 THEN [1990 + ordinal % 3 * 5] ELSE [] END AS r_years, CASE WHEN ordinal % 12 = 0 THEN 'a LoRA adapter'
      WHEN ordinal % 12 = 6 THEN 'SFT fine-tuning run' ELSE 'a run' END AS r_evidence, ordinal % 11 = 0 AS r_old,
  CASE WHEN ordinal % 4 <> 1 THEN {_sql_of(EVIDENCE_TYPES, "ordinal")} END AS c_type, CASE WHEN ordinal % 13 = 0 THEN 'somebodyelse'
      WHEN ordinal % 17 = 0 THEN 'org' ELSE '' END AS c_trainer, ordinal % 19 = 0 AS c_1990, ordinal % 23 = 0 AS c_old,
  CASE WHEN ordinal % 8 = 0 THEN 3.0 ELSE 0.0 END AS c_active, CASE WHEN ordinal % 6 = 0 THEN 2.5 ELSE 0.0 END AS c_tokens,
      'card' || (ordinal % 300) AS c_card, CASE WHEN ordinal % 5 = 0 THEN '' ELSE 'claim' || (ordinal % 307) END AS c_run,
  CASE WHEN ordinal % 9 < 4 THEN {_sql_of(KINDS, "(ordinal // 9)")} END AS v_kind, CASE WHEN ordinal % 9 < 4
      THEN {_sql_of(CONFIDENCE, "ordinal")} END AS v_conf, {_sql_of(RUNS, "ordinal")} AS v_run, CASE WHEN ordinal % 9 < 4
      AND ordinal % 5 = 0 THEN 1.5 ELSE 0.0 END AS v_size FROM models)
"""
