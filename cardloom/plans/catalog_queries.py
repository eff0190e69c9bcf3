"""Catalog queries over hub-shaped views, each with independent SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import costing as C
from ..operators import records as R
from ..operators import selection as S
from ..operators import summary as U
from ..operators import taxonomy as X
from ..sources import hub

QUERIES: dict = {}
ORACLES: dict = {}

PROFILE = C.Profile()
PICTURE_PROFILE = C.Profile("pictures", diffusion_image_budget=3.0, latent_sequence_length=1024.0)
TEXT = S.Selection("text", created_from="1995-06-01", created_to="2000-12-31", target_llm_only=True, min_downloads=1000,
    compute_profiles=("h100",), formula_requires_explicit_scratch=True, count_reported_derivative_costs=True)
PICTURES = S.Selection("pictures", target_diffusion_only=True, compute_profiles=("pictures", "h100"), count_reported_derivative_costs=True)
SMALL = S.Selection("small", model_kinds=("base", "fork"), max_parameters_b=34.0, include_unknown_parameters=True, exclude_tags=("speech",
    ), sort_by="likes", limit=200, compute_profiles=("h100",))
SELECTIONS = (TEXT, PICTURES, SMALL)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {_CTE}\n{sql}"
        return f

    return add


def _like(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def _tags(wanted) -> str:
    return f"list_has_any(lt, [{', '.join(repr(w) for w in wanted)}])"


def _any(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{n}')" for n in needles) + ")"


_OVERRIDES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.KIND_OVERRIDES.items())


def _told(key: str) -> str:
    """A metadata value that says something."""
    path = f"'$.{key}'"
    return f"""coalesce(CASE json_type(cd, {path}) WHEN 'NULL' THEN false WHEN 'VARCHAR' THEN trim(json_extract_string(cd, {path})) <> ''
        WHEN 'ARRAY' THEN json_array_length(cd, {path}) > 0
  WHEN 'OBJECT' THEN len(json_keys(cd, {path})) > 0 ELSE json_type(cd, {path}) IS NOT NULL END, false)"""


_DECLARES = "(" + " OR ".join(map(_told, X.CARD_BASE_KEYS)) + ")"
_BUCKET = "CASE WHEN params IS NULL OR params <= 0 THEN 'unknown' " + " ".join(f"WHEN params < {t}000000000 THEN '{n}'" for t,
    n in X.BUCKETS) + " ELSE '>=500B' END"
_JOINED = "lower(repo_id || ' ' || array_to_string(tags, ' '))"
_CTE = f"""{hub.VIEWS},
m0 AS (SELECT *, list_transform(tags, lambda t: lower(t)) AS lt, lower(library_name) AS ll, lower(pipeline_tag) AS pl, CASE
    WHEN json_valid(card_data) THEN CAST(card_data AS JSON) END AS cd FROM models),
k AS (SELECT *, CASE WHEN repo_id IN ({', '.join(repr(x) for x in P.KIND_OVERRIDES)}) THEN CASE repo_id {_OVERRIDES} END
    WHEN relation IN ('quantized', 'merge') THEN relation
  WHEN {_tags(P.QUANT_TAGS)} OR ll IN ('mlx', 'onnx', 'openvino')
      OR {' OR '.join(_like('repo_id', p) for p in (P.QUANT_NAME, P.CONVERT_NAME, P.EMBEDDED_SOURCE_NAME, P.HF_CONVERSION_NAME))} THEN 'quantized'
  WHEN {_tags(('model-merge', 'merge'))} OR {_like('repo_id', P.MERGE_NAME)} THEN 'merge'
  WHEN relation IN ('adapter', 'finetune') THEN relation
  WHEN {_tags(P.TRAINER_TAGS)} THEN 'finetune'
  WHEN {_tags(('peft', 'lora', 'qlora'))} OR len(list_filter(lt, lambda t: starts_with(t, 'base_model:adapter:'))) > 0
      OR {_like('repo_id', P.ADAPTER_NAME)} THEN 'adapter'
  WHEN len(list_filter(lt, lambda t: starts_with(t, 'base_model:'))) > 0 OR base_model IS NOT NULL OR {_DECLARES} THEN 'finetune'
  WHEN {' OR '.join(_like('repo_id', p) for p in (P.FORK_NAME, P.CHECKPOINT_NAME, P.UUID_NAME, P.AFFINE_NAME))} THEN 'fork'
  WHEN {_like('repo_id', P.FINETUNE_NAME)} THEN 'finetune' ELSE 'base' END AS kind, {_BUCKET} AS bucket,
  CASE WHEN author <> '' THEN author WHEN strpos(repo_id, '/') > 1 THEN left(repo_id, strpos(repo_id, '/') - 1) ELSE '' END AS owner,
  NOT {_like('pl', P.NON_TEXT_PIPELINE)} AND NOT {_like(_JOINED, P.NON_TEXT)} AND (pl IN ('text-generation', 'text2text-generation',
      'conversational', 'fill-mask') OR {_like(_JOINED, P.LLM_SIGNAL)}) AS is_text,
  CASE WHEN pl IN ('text-to-image', 'image-to-image', 'unconditional-image-generation') THEN true WHEN pl IN ('text-to-video',
      'image-to-video', 'video-generation', 'audio-to-audio', 'text-to-speech') THEN false
    ELSE NOT {_like(_JOINED, P.DIFFUSION_EXCLUDED)} AND {_like(_JOINED, P.DIFFUSION_TARGET)} END AS is_picture,
  len(list_filter(files, lambda f: {_like('f', P.WEIGHT_FILE)} AND NOT {_like('f', P.NON_WEIGHT_FILE)})) > 0 AS weights FROM m0),
sel AS (SELECT 'text' AS selection, * FROM k WHERE created_at >= TIMESTAMP '1995-06-01' AND created_at < TIMESTAMP '2001-01-01'
    AND is_text AND downloads >= 1000
  UNION ALL SELECT 'pictures', * FROM k WHERE is_picture
  UNION ALL SELECT * FROM (SELECT 'small', * FROM k WHERE kind IN ('base', 'fork') AND NOT list_has_any(lt, ['speech'])
      AND (coalesce(params, 0) <= 0 OR params / 1e9 <= 34) ORDER BY likes DESC, repo_id LIMIT 200))"""


def kinded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub.models(spark, sf_dir).withColumns({"kind": X.kind(), "bucket": X.size_bucket(), "owner": X.owner()})


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select(kinded(spark, sf_dir), *SELECTIONS)


def _count(name: str = "rows"):
    return F.count(F.lit(1)).alias(name)


@query("SELECT year(created_at) AS year, count(*) AS rows FROM models WHERE year(created_at) IN (1996, 1997, 1999) GROUP BY 1")
def f1_year_filter(spark, sf):
    return hub.models(spark, sf).withColumn("year", F.year("created_at").cast("long")).where(F.col("year").isin(1996, 1997,
        1999)).groupBy("year").agg(_count())


@query("SELECT repo_id, created_at FROM models WHERE repo_id <> '' AND created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1997-03-02'")
def f2_window_filter(spark, sf):
    s = S.Selection("w", created_from="1997-01-01", created_to="1997-03-01")
    return hub.models(spark, sf).where((F.col("repo_id") != "") & S.condition(s)).select("repo_id", "created_at")


@query("SELECT repo_id, weights OR coalesce(params, 0) > 0 AS weights FROM k")
def f3_weight_gate(spark, sf):
    return hub.models(spark, sf).select("repo_id", X.retained().alias("weights"))


@query("SELECT selection, repo_id, kind, bucket, downloads FROM sel")
def f5_matches_selection(spark, sf):
    return selected(spark, sf).select("selection", "repo_id", "kind", "bucket", "downloads")


@query("""SELECT repo_id, list_has_any(lt, ['gguf', 'en']) AS any_of, len(list_filter(['llm', 'en'], lambda x: NOT list_contains(lt,
    x))) = 0 AS all_of,
  NOT list_has_any(lt, ['speech']) AS none_of, len(list_filter(lt, lambda t: starts_with(t, 'base_model:'))) > 0 AS prefixed FROM k""")
def f6_tag_algebra(spark, sf):
    t = X.lowered()
    return hub.models(spark, sf).select(
        "repo_id", X.has_any(t, ("gguf", "en")).alias("any_of"), (F.size(F.array_except(F.array(F.lit("llm"), F.lit("en")),
            t)) == 0).alias("all_of"),
        (~X.has_any(t, ("speech",))).alias("none_of"), F.exists(t, lambda x: F.coalesce(x.startswith("base_model:"),
            F.lit(False))).alias("prefixed"),
    )


@query("SELECT repo_id, is_text FROM k")
def f7_text_target(spark, sf):
    return hub.models(spark, sf).select("repo_id", X.is_text_model().alias("is_text"))


@query("SELECT repo_id, is_picture FROM k")
def f8_diffusion_target(spark, sf):
    return hub.models(spark, sf).select("repo_id", X.is_diffusion_model().alias("is_picture"))


@query(f"SELECT card_no, {_any('card', P.COMPUTE_NEEDLES)} OR (contains(lower(card), 'training') AND contains(card, '$')) AS may_compute, {_any('card', P.SCRATCH_NEEDLES)} AS may_scratch FROM cards")
def f9_text_prefilters(spark, sf):
    return hub.cards(spark, sf).select("card_no", X.may_report_compute().alias("may_compute"), X.may_claim_scratch().alias("may_scratch"))


@query("""SELECT c.card_no, CASE WHEN len(y) > 0 THEN list_contains(y, 2025) ELSE NOT e < '2025-03-02' END AS inside
  FROM (SELECT card_no, list_transform(list_distinct(regexp_extract_all(card, '\\b20[0-9][0-9]\\b')), lambda v: CAST(v AS INTEGER)) AS y,
      createdAt AS e FROM cards) c""")
def f10_claim_in_window(spark, sf):
    s = S.Selection("w", created_from="2025-03-02", created_to="2025-12-31")
    years = F.transform(F.regexp_extract_all("card", F.lit(P.java(r"\b20[0-9][0-9]\b")), F.lit(0)), lambda v: v.cast("int"))
    return hub.cards(spark, sf).select("card_no", R.in_window(years, F.col("createdAt"), s).alias("inside"))


@query("""SELECT repo_id, CASE WHEN octet_length(encode(a)) < 3 OR octet_length(encode(b)) < 2 THEN true ELSE contains(a, b)
    OR contains(b, a) END AS trainer_matches
  FROM (SELECT repo_id, regexp_replace(lower(owner), '[^\\p{L}\\p{N}]', '', 'g') AS b, regexp_replace(lower(split_part(repo_id, '/', 2)),
      '[^\\p{L}\\p{N}]', '', 'g') AS a FROM k)""")
def f11_trainer_matches_owner(spark, sf):
    trainer = F.get(F.split("repo_id", "/"), F.lit(1))
    return kinded(spark, sf).select("repo_id", R.owner_matches(trainer, F.col("owner")).alias("trainer_matches"))


_TOLD_FILES = f"list_filter(files, lambda f: {_like('f', P.ADAPTER_FILE)} OR {_like('f', P.CONVERSION_FILE)})"
_CARD_TAGS = "CASE json_type(cd, '$.tags') WHEN 'ARRAY' THEN list_transform(CAST(json_extract_string(cd, '$.tags[*]') AS VARCHAR[]), lambda t: lower(t)) WHEN 'VARCHAR' THEN [lower(json_extract_string(cd, '$.tags'))] ELSE [] END"
_HIT_TAGS = f"list_sort(list_distinct(list_filter(list_concat(lt, {_CARD_TAGS}), lambda t: list_contains([{', '.join(map(repr, P.DERIVATIVE_TAGS))}], t))))"
_STATED = " ".join(f"WHEN {_told(k)} THEN json_extract_string(cd, '$.{k}')" for k in X.CARD_BASE_KEYS)


METADATA_SQL = f"""SELECT repo_id, created_at, reason, CASE reason WHEN 'declares_base_model' THEN CASE {_STATED} ELSE base_model END
    WHEN 'derivative_tag' THEN array_to_string({_HIT_TAGS}, ', ') WHEN 'derivative_name' THEN repo_id ELSE '' END AS evidence
  FROM (SELECT *, CASE WHEN NOT weights THEN 'no_recognized_full_weight_file' WHEN {_DECLARES} OR base_model IS NOT NULL
      THEN 'declares_base_model' WHEN len({_HIT_TAGS}) > 0 THEN 'derivative_tag'
  WHEN {_like("split_part(repo_id, '/', -1)", P.DERIVATIVE_NAME)} THEN 'derivative_name' WHEN len({_TOLD_FILES}) > 0 THEN CASE
      WHEN {_like(_TOLD_FILES + '[1]', P.ADAPTER_FILE)} THEN 'adapter_files' ELSE 'conversion_files' END ELSE 'pending' END AS reason
      FROM k)"""


@query(f"SELECT repo_id, reason, evidence FROM ({METADATA_SQL})")
def m1_metadata_filter(spark, sf):
    rows = hub.models(spark, sf).withColumn("why", X.metadata_reason())
    return rows.select("repo_id", F.coalesce("why", F.lit("pending")).alias("reason"), X.metadata_evidence(F.col("why")).alias("evidence"))


@query("SELECT repo_id, kind FROM k")
def m3_model_kind(spark, sf):
    return hub.models(spark, sf).select("repo_id", X.kind().alias("kind"))


@query("SELECT selection, kind, bucket, count(*) AS rows, CAST(sum(downloads) AS BIGINT) AS downloads, count(DISTINCT owner) AS owners FROM sel GROUP BY ALL")
def m5_selection_summary(spark, sf):
    return selected(spark, sf).groupBy("selection", "kind", "bucket").agg(_count(), F.sum("downloads").alias("downloads"),
        F.count_distinct("owner").alias("owners"))


@query("""SELECT repo_id, round(6.0 * n * t / (989.0 * 1e12 * 3600 * 0.4), 3) AS hours,
    round(6.0 * n * t / (989.0 * 1e12 * 3600 * 0.4) / 8 / 24, 4) AS days,
  CASE WHEN told AND sparse THEN 'reported_pretraining_tokens_active_parameters' WHEN told
      THEN 'reported_pretraining_tokens_total_parameters' WHEN sparse THEN 'formula_txt_moe_active_parameter_scaling'
      ELSE 'formula_txt_parameter_scaling' END AS method
  FROM (SELECT repo_id, sparse, told, CASE WHEN sparse THEN 3e9 ELSE params END AS n, CASE WHEN told THEN 2.5e12 ELSE 20.0 * params END AS t
    FROM (SELECT *, ordinal % 4 = 0 AND 3e9 < params AS sparse, ordinal % 3 = 0 AS told FROM models WHERE params > 0))""")
def m8_evidence_formula(spark, sf):
    rows = hub.models(spark, sf).where("params > 0")
    flops, method = C.evidence(F.col("params"), F.when(F.col("ordinal") % 4 == 0, 3.0), F.when(F.col("ordinal") % 3 == 0, 2.5), PROFILE)
    hours = C.gpu_hours(flops, PROFILE)
    return rows.select("repo_id", F.round(hours, 3).alias("hours"), F.round(C.wall_days(hours, PROFILE), 4).alias("days"),
        method.alias("method"))


@query("""SELECT repo_id, base_model, CASE WHEN kind = 'adapter' THEN coalesce(base_params, 0) ELSE coalesce(params,
    0) END AS effective_params,
  CASE WHEN kind <> 'adapter' THEN NULL WHEN base_model IS NULL THEN 'adapter has no declared base model' WHEN coalesce(base_params,
      0) <= 0 THEN 'base model parameter count was not resolved' END AS parameter_error FROM k LEFT
      JOIN base_params ON base_id = base_model""")
def j2_adapter_base_parameters(spark, sf):
    rows = R.effective_parameters(kinded(spark, sf), hub.base_params(spark, sf))
    return rows.select("repo_id", "base_model", F.col("params").alias("effective_params"), "parameter_error")


@query("SELECT repo_id, k.owner, coalesce(owner_type, 'unknown') AS owner_type FROM k LEFT JOIN owners ON k.owner = owners.owner")
def j6_owner_profile(spark, sf):
    return kinded(spark, sf).join(hub.owners(spark, sf), "owner", "left").select("repo_id", "owner", F.coalesce("owner_type",
        F.lit("unknown")).alias("owner_type"))


@query("SELECT card_no, createdAt FROM cards WHERE card_no IN (SELECT ordinal FROM models WHERE likes < 30)")
def j7_wanted_cards(spark, sf):
    wanted = hub.models(spark, sf).where("likes < 30").select(F.col("ordinal").alias("card_no"))
    return hub.cards(spark, sf).join(wanted, "card_no", "left_semi").select("card_no", "createdAt")


@query("""SELECT card_no, sha256(trim(regexp_replace(card, '[ \\t\\n\\f\\r]+', ' ', 'g'))) AS card_hash,
    min(createdAt) OVER (PARTITION BY sha256(trim(regexp_replace(card, '[ \\t\\n\\f\\r]+', ' ', 'g')))) AS earliest FROM cards""")
def a7_j8_earliest_by_fingerprint(spark, sf):
    h = F.sha2(F.trim(F.regexp_replace("card", r"[ \t\n\f\r]+", " ")).cast("binary"), 256)
    rows = hub.cards(spark, sf).select("card_no", "createdAt", h.alias("card_hash"))
    first = rows.groupBy("card_hash").agg(F.min("createdAt").alias("earliest"))  # one row for each hash, however many copies
    return rows.join(first, "card_hash").select("card_no", "card_hash", "earliest")


@query("SELECT repo_id, l.doc_id IS NOT NULL AS covered FROM models LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON ordinal = l.doc_id")
def j13_coverage_flag(spark, sf):
    seen = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("ordinal"), F.lit(True).alias("seen")).distinct()
    return hub.models(spark, sf).join(seen, "ordinal", "left").select("repo_id", F.col("seen").isNotNull().alias("covered"))


@query("SELECT selection, count(DISTINCT owner) AS owners, count(*) AS rows, count(*) FILTER (WHERE coalesce(params, 0) <= 0) AS unknown_params, CAST(sum(likes) AS BIGINT) AS likes FROM sel GROUP BY 1")
def a3_a4_selection_rollup(spark, sf):
    return selected(spark, sf).groupBy("selection").agg(F.count_distinct("owner").alias("owners"), _count(),
        F.count(F.when(F.coalesce("params", F.lit(0)) <= 0, 1)).alias("unknown_params"), F.sum("likes").alias("likes"))


@query("""SELECT selection, CAST(sum(n) AS BIGINT) AS repositories, coalesce(CAST(sum(n) FILTER (WHERE kind = 'base') AS BIGINT),
    0) AS bases, coalesce(CAST(sum(known) FILTER (WHERE kind = 'base') AS BIGINT), 0) AS with_parameters,
  coalesce(CAST(sum(n - known) FILTER (WHERE kind = 'base') AS BIGINT), 0) AS without_parameters, string_agg(kind || '=' || n, ','
      ORDER BY kind) AS kinds
  FROM (SELECT selection, kind, count(*) AS n, count(*) FILTER (WHERE params > 0) AS known FROM sel GROUP BY 1, 2) GROUP BY 1""")
def a8_pre_review_funnel(spark, sf):
    rows = U.funnel(selected(spark, sf))
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.withColumn("kinds", kinds)


@query("""SELECT selection, repo_id, downloads FROM (SELECT *, row_number() OVER (PARTITION BY selection ORDER BY downloads DESC,
    repo_id) AS n FROM sel) WHERE n <= 25""")
def w10_top_per_selection(spark, sf):
    w = Window.partitionBy("selection").orderBy(F.desc("downloads"), "repo_id")
    return selected(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 25").select("selection", "repo_id", "downloads")


_FAMILY = f"trim(replace(replace(regexp_replace(lower(split_part(repo_id, '/', -1)), '{P.BASE_SUFFIX}', ''), '_', '-'), '.', '-'), '-')"
_STEM = f"regexp_replace(lower(repo_id), '{P.DATE_SUFFIX}', '')"


@query(f"SELECT repo_id, {_FAMILY} AS family, {_STEM} AS stem, regexp_replace(lower(repo_id), '{P.CHECKPOINT_NAME}', '') AS checkpoint_family, left(repo_id, 10) AS short FROM models")
def scalar_name_functions(spark, sf):
    stem = F.regexp_replace(F.lower("repo_id"), P.java(P.DATE_SUFFIX), "")
    return hub.models(spark, sf).select("repo_id", X.family().alias("family"), stem.alias("stem"),
        X.checkpoint_family().alias("checkpoint_family"), F.substring("repo_id", 1, 10).alias("short"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def scalar_json_number(spark, sf):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", k.alias("k")).where("k IS NOT NULL")


@query("SELECT owner, full_name, repos, CAST(downloads AS BIGINT) AS downloads FROM (SELECT k.owner, any_value(full_name) AS full_name, count(*) AS repos, sum(downloads) AS downloads FROM k JOIN owners ON k.owner = owners.owner GROUP BY 1) ORDER BY downloads DESC, owner LIMIT 100")
def k4_top_owners(spark, sf):
    rows = kinded(spark, sf).groupBy("owner").agg(_count("repos"), F.sum("downloads").alias("downloads")).join(hub.owners(spark, sf),
        "owner")
    return rows.orderBy(F.desc("downloads"), "owner").limit(100).select("owner", "full_name", "repos", "downloads")


@query("SELECT selection, repo_id FROM sel UNION ALL SELECT 'all-large', repo_id FROM models WHERE params >= 70000000000")
def u_union_all(spark, sf):
    large = hub.models(spark, sf).where("params >= 70000000000").select(F.lit("all-large").alias("selection"), "repo_id")
    return reduce(DataFrame.unionByName, [selected(spark, sf).select("selection", "repo_id"), large])
