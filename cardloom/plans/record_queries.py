"""Queries over costed records, their de-duplication, summaries and samples, each with independent SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import card_patterns as C
from ..functions import patterns as P
from ..operators import card_signals as G
from ..operators import dedup as D
from ..operators import records as R
from ..operators import reviews as V
from ..operators import sampling as SA
from ..operators import selection as S
from ..operators import summary as U
from ..operators import taxonomy as X
from ..operators import training_signals as T
from ..operators import review_cache as VC
from ..operators import windows as W
from ..operators import year_counts as Y
from ..operators.ordinal import numbered
from ..session import written
from ..sources import hub
from ..sources import pages as PG
from . import catalog_queries as Q

QUERIES: dict = {}
ORACLES: dict = {}

TEXT, PICTURES = Q.TEXT, Q.PICTURES
ALL_TIME = {"created_from": "1900-01-01"}
CLOCK = {"now": "2002-01-01"}
PICTURES = dataclasses.replace(PICTURES, **ALL_TIME)
SMALL = S.Selection("small", **ALL_TIME, model_kinds=("base", "fork", "finetune"), max_parameters_b=34.0, include_unknown_parameters=True,
    exclude_tags=("speech",), sort_by="likes", limit=400, compute_profiles=("h100",), count_reported_derivative_costs=True)
ORGS = S.Selection("orgs", **ALL_TIME, owner_types=("organization", "unknown"), sort_by="repo_id", sort_direction="asc", limit=300,
    require_reported_compute=True, require_explicit_scratch_for_base=True, compute_profiles=("h100",), count_reported_derivative_costs=True)
CATALOG = S.Catalog(scan=CLOCK, compute_profiles=(Q.PROFILE, Q.PICTURE_PROFILE), selections=(TEXT, PICTURES, SMALL, ORGS),
    local_llm={"enabled": True, "scope": "text_llm"})
PICTURE_CATALOG = S.Catalog(scan=CLOCK, compute_profiles=(Q.PROFILE, Q.PICTURE_PROFILE), selections=(PICTURES,))
SAMPLING = S.Sampling(sample_per_stratum=20)

_RATE = "/ (989.0 * 1e12 * 3600 * 0.4) * 1.85"
_SIGNAL = "s.told, s.r_hours, s.r_cost, s.r_method, s.run_hash, s.evidence_hash, s.r_years, s.r_evidence, s.r_old, s.c_type, s.c_trainer, s.c_1990, s.c_old, s.c_active, s.c_tokens, s.c_card, s.c_run, s.v_kind, s.v_conf, s.v_run, s.v_size"
_EFFECTIVE = "CASE WHEN kind = 'adapter' THEN coalesce(base_params, 0) ELSE coalesce(params, 0) END"
_TEXT_SQL = "created_at >= TIMESTAMP '1995-06-01' AND created_at < TIMESTAMP '2001-01-01' AND is_text AND downloads >= 1000"
_INDEPENDENT = "coalesce(v_kind = 'independent_base' AND v_conf IN ('high', 'medium'), false)"
_SURE = "CASE WHEN v_conf = 'high' THEN CASE v_kind WHEN 'independent_base' THEN 'base' WHEN 'continued_pretraining' THEN 'finetune' WHEN 'fork_or_mirror' THEN 'fork' WHEN 'unknown' THEN NULL ELSE v_kind END END"
_TRAINED_BY = "(c_trainer = '' OR octet_length(encode(o)) < 2 OR contains(o, c_trainer) OR contains(c_trainer, o))"


def _kind_sql(claim: str) -> str:
    tuned = f"prelim = 'base' AND {claim} IS NULL AND told"
    return f"""coalesce({_SURE}, CASE WHEN {tuned} AND {Q._like('r_evidence', C.ADAPTER_EVIDENCE)} THEN 'adapter'
        WHEN {tuned} AND {Q._like('r_evidence', C.DERIVATIVE_EVIDENCE)} THEN 'finetune' ELSE prelim END)"""


def _records_sql(reviews: bool) -> str:
    """rec0: records before limits."""
    names = ["text", "small", "orgs"] if reviews else ["pictures"]
    rules = {
        "text": f"{_TEXT_SQL} AND NOT is_picture", "pictures": "is_picture", "orgs": "true",
        "small": "prelim IN ('base', 'fork', 'finetune') AND NOT list_has_any(lt, ['speech']) AND (params <= 0 OR params / 1e9 <= 34)",
    }
    rows = " UNION ALL ".join(f"SELECT '{n}' AS selection, {i} AS nth, * FROM e WHERE {rules[n]}" for i, n in enumerate(names))
    weak = "(c_type = 'declared_base_model')" if reviews else "false"
    by_name = "d_type = 'declared_base_model' AND v_kind IS NULL"
    if reviews:
        settled = f"""CASE WHEN coalesce({_SURE} <> 'base', false) THEN NULL WHEN c_type IS NOT NULL AND NOT {weak} THEN c_type
            WHEN {_INDEPENDENT} THEN 'local_llm_' || v_conf END"""
        from_review = f"(c_type IS NULL OR {weak})"
    else:
        settled, from_review = "c_type", "false"
    return f"""e AS (SELECT k.* EXCLUDE (params, kind), k.kind AS prelim, {_EFFECTIVE} AS params, coalesce(params, 0) AS own_params,
        {_SIGNAL if reviews else _SIGNAL.replace('s.v_kind, s.v_conf', 'NULL::VARCHAR AS v_kind, NULL::VARCHAR AS v_conf')},
  CASE WHEN kind = 'adapter' AND base_model IS NULL THEN 'adapter has no declared base model' WHEN kind = 'adapter'
      AND coalesce(base_params, 0) <= 0 THEN 'base model parameter count was not resolved' END AS perr
  FROM k JOIN signals s USING (ordinal) LEFT JOIN base_params ON base_id = base_model),
m AS ({rows}),
t0 AS (SELECT *, {settled} AS d0, {from_review} AS renewed, c_type IS NOT NULL AND NOT coalesce({weak}, false) AS det,
    regexp_replace(lower(owner), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS o FROM m),
t1 AS (SELECT *, CASE WHEN renewed THEN d0 IS NOT NULL AND (c_type IS NULL OR NOT c_1990 OR selection <> 'text')
    ELSE {_TRAINED_BY} AND (CASE WHEN c_1990 THEN selection <> 'text' ELSE NOT (c_old AND selection = 'text') END) END AS usable FROM t0),
t2 AS (SELECT *, CASE WHEN usable THEN d0 END AS d_type,
  CASE WHEN renewed THEN CASE WHEN c_type IS NOT NULL THEN c_active ELSE 0 END ELSE c_active END AS active, CASE WHEN renewed THEN CASE
      WHEN c_type IS NOT NULL THEN c_tokens ELSE 0 END ELSE c_tokens END AS tokens,
  CASE WHEN renewed THEN sha256(v_run) ELSE c_run END AS d_run, CASE WHEN renewed THEN '' ELSE c_card END AS d_card FROM t1),
t3 AS (SELECT *, {_kind_sql('d_type')} AS kind, CASE WHEN NOT told THEN true WHEN len(r_years) > 0 THEN selection <> 'text'
    OR r_years[1] BETWEEN 1995 AND 2000 ELSE NOT (r_old AND selection = 'text') END AS timely FROM t2),
t4 AS (SELECT * FROM t3 WHERE kind <> 'non_text' AND (selection <> 'orgs' OR (told AND timely AND (kind <> 'base' OR d_type IS NOT NULL)))
    AND (kind NOT IN ('finetune', 'adapter') OR timely)),
t5 AS (SELECT *, kind = 'base' AND params > 0 AND NOT coalesce({by_name}, false) AND (selection NOT IN ('text', 'orgs')
    OR d_type IS NOT NULL) AS priced, told AND kind IN ('finetune', 'adapter') AS derived,
  coalesce(active > 0 AND active * 1e9 < params, false) AND d_type IS NOT NULL AS sparse, d_type IS NOT NULL AND tokens > 0 AS knows,
      6.0 * params * (20.0 * params) {_RATE} AS literal FROM t4),
t6 AS (SELECT *, CASE WHEN selection = 'pictures' THEN 6.0 * (CASE WHEN sparse THEN active * 1e9
    ELSE params END) * (params * 3072.0) {_RATE} WHEN selection = 'small' THEN literal
    ELSE 6.0 * (CASE WHEN sparse THEN active * 1e9 ELSE params END) * (CASE WHEN knows THEN tokens * 1e12
        ELSE 20.0 * params END) {_RATE} END AS price,
  CASE WHEN selection = 'pictures' THEN 'formula_txt_diffusion_image_budget_' || CASE WHEN sparse THEN 'active'
      ELSE 'total' END || '_parameters' WHEN selection = 'small' THEN 'formula_txt_literal_total_parameters'
    WHEN knows AND sparse THEN 'reported_pretraining_tokens_active_parameters' WHEN knows
        THEN 'reported_pretraining_tokens_total_parameters' WHEN sparse THEN 'formula_txt_moe_active_parameter_scaling'
        ELSE 'formula_txt_parameter_scaling' END AS formula FROM t5),
t7 AS (SELECT *, d_type = 'local_llm_medium' AND NOT det AS med, d_type = 'local_llm_high' AND NOT det AS hi FROM t6),
rec0 AS (SELECT *, CASE WHEN derived THEN r_cost WHEN priced THEN price END AS upper, CASE WHEN derived THEN r_cost WHEN priced
    AND NOT coalesce(med, false) THEN price END AS cost,
  CASE WHEN derived THEN r_cost WHEN priced AND NOT coalesce(med, false) AND NOT coalesce(hi, false) THEN price END AS lower, CASE
      WHEN derived THEN r_method WHEN priced THEN formula END AS method,
  CASE WHEN derived THEN 'reported' WHEN priced THEN CASE WHEN med THEN 'llm_medium_upper_only' WHEN hi THEN 'llm_high'
      ELSE 'deterministic' END END AS tier,
  CASE WHEN priced AND (formula <> 'formula_txt_literal_total_parameters' OR abs(price - literal) > 0.005) THEN literal WHEN priced
      THEN price ELSE 0 END AS lit,
  list_filter([perr, CASE WHEN kind = 'base' AND coalesce({by_name}, false) THEN '{R.NOT_PROVEN}' END], lambda x: x IS NOT NULL) AS errs
      FROM t7)"""


# place: selections in turn, then by downloads, or likes (small), or repository (orgs), then by repository
_LIMITED = """,
rec AS (SELECT *, row_number() OVER (ORDER BY nth, CASE WHEN selection = 'small' THEN likes WHEN selection <> 'orgs'
    THEN downloads END DESC, repo_id) AS place FROM
  (SELECT * FROM rec0 WHERE selection <> 'small' UNION ALL SELECT * FROM (SELECT * FROM rec0 WHERE selection = 'small'
      ORDER BY likes DESC, repo_id LIMIT 400)))"""
_RECORDS = f"WITH {Q._CTE},\n{_records_sql(True)}{_LIMITED}"
_PICTURES = f"WITH {Q._CTE},\n{_records_sql(False)}"
_NAME = "lower(substr(repo_id, strpos(repo_id, '/') + 1))"
_AGE, _FAME = "created_at, likes DESC, downloads DESC, place", "likes DESC, downloads DESC, created_at, place"
_BASE = "(method LIKE 'formula\\_txt\\_%' ESCAPE '\\' OR method LIKE 'reported\\_pretraining\\_tokens\\_%' ESCAPE '\\') AND cost IS NOT NULL"
_RUN = "trim(regexp_replace(lower(trim(v_run)), '[^a-z0-9/]+', '-', 'g'), '-/')"
_PASSES = (
    ("duplicate_reported_training_run", "cost counted once under canonical repository ",
        "told AND cost IS NOT NULL AND method IN ('gpu_hours_x_hourly_rate', 'reported_total_cost')",
        "CASE WHEN run_hash <> '' THEN run_hash ELSE evidence_hash END", _AGE, "true"),
    ("duplicate_reported_training_trajectory", "reported trajectory cost counted once under cumulative repository ",
        "told AND cost IS NOT NULL AND kind IN ('finetune', 'adapter') AND contains(repo_id, '/')",
        f"lower(owner), kind, coalesce(lower(base_model), ''), regexp_replace({_NAME}, '{P.DATE_SUFFIX}', ''), params",
        "cost DESC, created_at DESC, place", Q._like(_NAME, P.DATE_SUFFIX)),
    ("duplicate_scratch_training_run", "scratch cost counted once under canonical repository ",
        f"{_BASE} AND d_type IS NOT NULL AND d_run || d_card <> ''", "CASE WHEN d_run <> '' THEN d_run ELSE d_card END, params", _AGE,
        "true"),
    ("duplicate_scratch_training_trajectory", "scratch trajectory cost counted once under canonical repository ",
        f"{_BASE} AND contains(repo_id, '/') AND {Q._like(_NAME, P.CHECKPOINT_NAME)}",
        f"lower(owner), regexp_replace({_NAME}, '{P.CHECKPOINT_NAME}', ''), params", _AGE, "true"),
    ("duplicate_base_family_mirror", "base-family cost counted once under canonical repository ",
        f"{_BASE} AND octet_length(encode({Q._FAMILY})) >= 6 AND {Q._FAMILY} NOT IN ('model', 'base-model')", f"{Q._FAMILY}, params",
        _FAME, "true"),
    ("duplicate_local_llm_training_run", "local-LLM canonical run counted once under ",
        f"v_kind = 'independent_base' AND v_conf IN ('high', 'medium') AND upper IS NOT NULL AND octet_length(encode({_RUN})) >= 6 AND {_RUN} <> 'unknown'", f"{_RUN}, params", f"(v_conf <> 'high'), {_FAME}", "true"),
)


def _pass_sql(out: str, source: str, which: int) -> str:
    method, said, eligible, keys, order, some = _PASSES[which]
    part = f"PARTITION BY coalesce({eligible}, false), selection, {keys}"
    lost = f"coalesce({eligible}, false) AND first_ordinal <> ordinal AND has_some"
    gone = ", ".join(f"CASE WHEN {lost} THEN NULL ELSE {c} END AS {c}" for c in ("cost", "lower", "upper"))
    tier = f", CASE WHEN {lost} THEN 'duplicate' ELSE tier END AS tier" if which == 5 else ""
    return f"""{out} AS (SELECT * EXCLUDE (first_ordinal, first_repo, has_some) REPLACE ({gone}, CASE WHEN {lost} THEN '{method}'
        ELSE method END AS method, CASE WHEN {lost} THEN 0 ELSE lit END AS lit, CASE WHEN {lost} THEN list_append(errs,
        '{said}' || first_repo) ELSE errs END AS errs{tier}) FROM
  (SELECT *, first_value(ordinal) OVER ({part} ORDER BY {order}) AS first_ordinal,
      first_value(repo_id) OVER ({part} ORDER BY {order}) AS first_repo, bool_or({some}) OVER ({part}) AS has_some FROM {source}))"""


_J9 = """d0 AS (SELECT rec.* REPLACE (CASE WHEN base_repo IS NULL THEN cost END AS cost, CASE WHEN base_repo IS NULL
    THEN lower END AS lower, CASE WHEN base_repo IS NULL THEN upper END AS upper, CASE WHEN base_repo IS NULL THEN method
    ELSE 'duplicate_reported_base_training_run' END AS method,
  CASE WHEN base_repo IS NULL THEN errs ELSE list_append(errs,
      'reported compute belongs to canonical base repository ' || base_repo) END AS errs)
  FROM rec LEFT JOIN (SELECT selection AS bs, run_hash AS br, arg_max(repo_id, place) AS base_repo FROM rec WHERE kind = 'base'
      AND cost IS NOT NULL AND run_hash <> '' GROUP BY 1, 2) ON bs = selection AND br = run_hash AND kind IN ('finetune', 'adapter')
      AND cost IS NOT NULL)"""
_CHAIN = _RECORDS + ",\n" + _J9 + ",\n" + ",\n".join(_pass_sql(f"d{i + 1}", f"d{i}", i) for i in range(6))
_OWNED = (
    _CHAIN
    + """,
ow AS (SELECT owner AS ow_name, min(owner_type) AS ow_type FROM owners GROUP BY 1),
fin0 AS (SELECT d6.*, coalesce(ow_type, 'unknown') AS owner_type FROM d6 LEFT JOIN ow ON owner = ow_name),
fin AS (SELECT * FROM fin0 WHERE selection <> 'orgs' UNION ALL SELECT * FROM (SELECT * FROM fin0 WHERE selection = 'orgs'
    AND owner_type IN ('organization', 'unknown') ORDER BY repo_id LIMIT 300))"""
)


def query(cte: str | None, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{cte}\n{sql}"
        return f

    return add


def built(spark: SparkSession, sf_dir: str, catalog: S.Catalog = CATALOG) -> DataFrame:
    reviews = hub.reviews(spark, sf_dir)
    if not catalog.reviews:
        reviews = reviews.limit(0)
    return R.build(Q.kinded(spark, sf_dir), hub.signals(spark, sf_dir), reviews, hub.base_params(spark, sf_dir), catalog)


def ready(records: DataFrame) -> DataFrame:
    """With the columns that de-duplication reads."""
    of = {"run_hash": "reported.run_hash", "evidence_hash": "reported.evidence_hash", "claim_run": "claim.run_hash",
        "claim_card": "claim.card_hash"}
    return records.withColumns({n: F.coalesce(F.col(c), F.lit("")) for n, c in of.items()})


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplicated records with owner types and all limits."""
    records = D.chained(ready(built(spark, sf_dir)), CATALOG.selections)
    return written(U.of_allowed_owners(U.with_owner_types(records, hub.owners(spark, sf_dir)), CATALOG), "final")


def _usd(*names: str):
    return [F.round(n, 2).alias(f"{n}_usd") for n in names]


_SHOW = "SELECT selection, repo_id, kind, params, round(lower, 2) AS lower_usd, round(cost, 2) AS cost_usd, round(upper, 2) AS upper_usd, method, tier, array_to_string(errs, ' | ') AS errors FROM"


def _shown(records: DataFrame, *more: str) -> DataFrame:
    return records.select(*more, "selection", "repo_id", "kind", "params", *_usd("lower", "cost", "upper"), "method", "tier",
        F.array_join("errors", " | ").alias("errors"))


@query(_RECORDS, f"{_SHOW} rec")
def m8_records(spark, sf):
    return _shown(built(spark, sf))


@query(_PICTURES, f"{_SHOW} rec0")
def m8_diffusion_records(spark, sf):
    return _shown(built(spark, sf, PICTURE_CATALOG))


RECENT = (
    S.Selection("year", compute_profiles=("h100",), model_kinds=("base", "finetune")),
    S.Selection("quarter", lookback_days=90, target_llm_only=True, compute_profiles=("h100",), formula_requires_explicit_scratch=True,
        count_reported_derivative_costs=True),
    S.Selection("past", created_to="1996-12-31", lookback_days=31, compute_profiles=("h100",)),
)
RECENT_CATALOG = S.Catalog(scan={"now": "1997-10-03T12:00:00Z"}, compute_profiles=(Q.PROFILE,), selections=RECENT)


@query(f"WITH {Q._CTE}", f"""SELECT selection, repo_id, kind FROM (
  SELECT 'year' AS selection, k.*, TIMESTAMP '1996-10-03 12:00:00' AS low FROM k WHERE kind IN ('base', 'finetune')
      AND created_at BETWEEN TIMESTAMP '1996-10-03 12:00:00' AND TIMESTAMP '1997-10-03 12:00:00'
  UNION ALL SELECT 'quarter', k.*, TIMESTAMP '1997-07-05 12:00:00' FROM k WHERE is_text AND NOT is_picture
      AND created_at BETWEEN TIMESTAMP '1997-07-05 12:00:00' AND TIMESTAMP '1997-10-03 12:00:00'
  UNION ALL SELECT 'past', k.*, TIMESTAMP '1996-12-01' FROM k WHERE created_at >= TIMESTAMP '1996-12-01'
      AND created_at < TIMESTAMP '1997-01-01') JOIN signals s USING (ordinal)
  WHERE kind NOT IN ('finetune', 'adapter') OR NOT told OR (CASE WHEN len(r_years) > 0 THEN r_years[1] BETWEEN year(low)
      AND CASE selection WHEN 'past' THEN 1996 ELSE 1997 END ELSE NOT r_old END)""")
def f2_f12_lookback(spark, sf):
    """Selections without a start look back from their end, or from the run's clock; models of the future are left out. Kinds by
    metadata."""
    rows = R.build(Q.kinded(spark, sf), hub.signals(spark, sf).withColumn("claim", F.lit(None).cast(G.CLAIM)).withColumn("compute",
        F.col("compute").withField("evidence", F.lit("a run"))), hub.reviews(spark, sf).limit(0), hub.base_params(spark, sf),
        RECENT_CATALOG)
    return rows.select("selection", "repo_id", "kind")


@query(_RECORDS, "SELECT repo_id, selection, prelim AS prelim_kind, kind FROM rec0 WHERE selection = 'text'")
def m4_resolved_kind(spark, sf):
    only = S.Catalog(scan=CLOCK, compute_profiles=CATALOG.compute_profiles, selections=(TEXT,), local_llm=CATALOG.local_llm)
    return built(spark, sf, only).select("repo_id", "selection", "prelim_kind", "kind")


@query(_RECORDS, "SELECT repo_id, d_type AS evidence_type, d_run AS run_hash, active, tokens, det AS deterministic FROM rec0 WHERE selection = 'text' AND d_type IS NOT NULL")
def m11_j3_j4_j5_settled_claims(spark, sf):
    only = S.Catalog(scan=CLOCK, compute_profiles=CATALOG.compute_profiles, selections=(TEXT,), local_llm=CATALOG.local_llm)
    rows = built(spark, sf, only).where("claim IS NOT NULL")
    return rows.select("repo_id", "claim.evidence_type", "claim.run_hash", F.col("claim.active_parameters_b").alias("active"),
        F.col("claim.training_tokens_t").alias("tokens"), "deterministic")


@query(_CHAIN, f"{_SHOW} d6")
def m10_chained_dedup(spark, sf):
    return _shown(D.chained(ready(built(spark, sf)), CATALOG.selections))


@query(_RECORDS + ",\n" + _J9, f"{_SHOW} d0")
def j9_derivative_of_base(spark, sf):
    records = written(ready(built(spark, sf)), "records")
    return _shown(D._applied(records, D.derivative_of_base(D.ledger(records, CATALOG.selections))))


def _single(name: str, which: int, make) -> None:
    def run(spark, sf):
        return _shown(D.apply_pass(ready(built(spark, sf)), make, CATALOG.selections))

    run.__name__ = name
    query(_RECORDS + ",\n" + _pass_sql("one", "rec", which), f"{_SHOW} one")(run)


for _i, (_n, _make) in enumerate((("w1_reported_run", D.reported_run), ("w2_reported_trajectory", D.reported_trajectory),
    ("w3_scratch_run", D.scratch_run), ("w4_checkpoint_trajectory", D.checkpoint_trajectory), ("w5_family_mirror", D.family_mirror),
    ("w6_reviewed_run", D.reviewed_run))):
    _single(_n, _i, _make)


# The passes by name over records whose names collide.
_ENDS = ("", "-step-100", "-20240115", "_fp16", "-ckpt-2k.x")
_COLLIDING = f"""{_RECORDS.removesuffix(_LIMITED)},
col0 AS (SELECT *, row_number() OVER (ORDER BY downloads DESC, repo_id, ordinal) AS place
    FROM (SELECT * REPLACE ('Org' || ordinal % 5 || '/family-' || ordinal % 3 || {hub._sql_of(_ENDS, "(ordinal // 3)")} AS repo_id,
  'Org' || ordinal % 5 AS owner, ordinal % 2 AS params, ordinal % 4 AS downloads, ordinal % 3 AS likes, date_trunc('year',
      created_at) AS created_at) FROM rec0 WHERE selection = 'text'))"""


def _colliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.concat(F.lit("Org"), (F.col("ordinal") % 5).cast("string"))
    end = F.array(*map(F.lit, _ENDS))[(F.floor(F.col("ordinal") / 3) % len(_ENDS)).cast("int")]
    only = S.Catalog(scan=CLOCK, compute_profiles=CATALOG.compute_profiles, selections=(TEXT,), local_llm=CATALOG.local_llm)
    return ready(built(spark, sf_dir, only)).withColumns({"repo_id": F.concat(owner, F.lit("/family-"),
        (F.col("ordinal") % 3).cast("string"), end), "owner": owner, "params": F.col("ordinal") % 2, "downloads": F.col("ordinal") % 4,
        "likes": F.col("ordinal") % 3, "created_at": F.date_trunc("year", "created_at")})


def _collided(name: str, which: int, make) -> None:
    def run(spark, sf):
        return _shown(D.apply_pass(_colliding(spark, sf), make, CATALOG.selections)).drop("repo_id", "errors", "params")

    run.__name__ = name
    show = "SELECT selection, kind, round(lower, 2) AS lower_usd, round(cost, 2) AS cost_usd, round(upper, 2) AS upper_usd, method, tier FROM one"
    query(_COLLIDING + ",\n" + _pass_sql("one", "col0", which), show)(run)


for _i, _n, _make in ((1, "w2_colliding_names", D.reported_trajectory), (3, "w4_colliding_names", D.checkpoint_trajectory), (4,
    "w5_colliding_names", D.family_mirror)):
    _collided(_n, _i, _make)


@query(_OWNED, f"{_SHOW.replace('SELECT', 'SELECT owner_type,')} fin")
def f13_j14_final_records(spark, sf):
    return _shown(final(spark, sf), "owner_type")


_MAP_SQL = """
SELECT selection, 'owner_types' AS name, owner_type AS key, count(*) AS n, round(sum(cost), 2) AS usd FROM fin GROUP BY ALL
UNION ALL SELECT selection, 'model_kinds', kind, count(*), round(sum(cost), 2) FROM fin GROUP BY ALL
UNION ALL SELECT selection, 'costed_models_by_kind', kind, count(*), round(sum(cost), 2) FROM fin WHERE cost IS NOT NULL GROUP BY ALL
UNION ALL SELECT selection, 'training_cost_by_kind', kind, count(*), round(sum(cost), 2) FROM fin WHERE cost IS NOT NULL GROUP BY ALL
UNION ALL SELECT selection, 'costed_models_by_method', method, count(*), round(sum(cost), 2) FROM fin WHERE cost IS NOT NULL GROUP BY ALL
UNION ALL SELECT selection, 'training_cost_by_method', method, count(*), round(sum(cost), 2) FROM fin WHERE cost IS NOT NULL GROUP BY ALL
UNION ALL SELECT selection, 'base_models_by_size', bucket, count(*), round(sum(cost), 2) FROM fin WHERE kind = 'base' GROUP BY ALL
UNION ALL SELECT selection, 'costed_base_by_size', bucket, count(*), round(sum(cost), 2) FROM fin WHERE kind = 'base' AND cost IS NOT NULL GROUP BY ALL
UNION ALL SELECT selection, 'base_cost_by_size', bucket, count(*), round(sum(cost), 2) FROM fin WHERE kind = 'base' AND cost IS NOT NULL GROUP BY ALL
"""


@query(_OWNED.replace("fin AS (", "fin1 AS (") + f",\nfin AS (SELECT * REPLACE ({Q._BUCKET} AS bucket) FROM fin1)", _MAP_SQL)
def a3_keyed_maps(spark, sf):
    return U.keyed(final(spark, sf)).select("selection", "name", "key", "n", F.round("usd", 2).alias("usd"))


@query(_OWNED, """SELECT selection, count(*) AS models, count(DISTINCT owner) AS unique_owners,
    CAST(sum(downloads) AS BIGINT) AS total_downloads, count(*) FILTER (WHERE params > 0) AS known_parameters,
    count(lower) AS lower_costed_models, round(coalesce(sum(lower), 0), 2) AS lower_usd,
  count(cost) AS known_training_costs, round(coalesce(sum(cost), 0), 2) AS total_usd, count(upper) AS upper_costed_models,
      round(coalesce(sum(upper), 0), 2) AS upper_usd, count(v_kind) AS reviewed, count(*) FILTER (WHERE v_conf = 'high') AS reviewed_high,
      count(*) FILTER (WHERE v_conf = 'low') AS reviewed_low FROM fin GROUP BY 1
  UNION ALL SELECT 'pictures', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0""")  # fmt: skip
def a3_a4_a13_selection_summary(spark, sf):
    rows = U.selections(final(spark, sf), CATALOG)
    return rows.select(
        "selection", "models", "unique_owners", "total_downloads", "known_parameters", "lower_costed_models",
            F.round("lower_training_cost_usd", 2).alias("lower_usd"), "known_training_costs", F.round("total_training_cost_usd",
            2).alias("total_usd"),
        "upper_costed_models", F.round("upper_training_cost_usd", 2).alias("upper_usd"), "reviewed", "reviewed_high", "reviewed_low",
    )


@query(_CHAIN, """SELECT selection, round(sum(CASE WHEN cost IS NULL THEN 0 WHEN kind <> 'base' THEN cost WHEN d_type IS NOT NULL
    AND active > 0 AND active < params / 1e9 THEN lit * active / (params / 1e9) ELSE lit END), 2) AS hybrid_usd,
  round(sum(CASE WHEN cost IS NULL THEN 0 WHEN kind <> 'base' THEN cost ELSE lit END), 2) AS literal_usd FROM d6 GROUP BY 1""")
def m9_a5_sensitivity_sums(spark, sf):
    hybrid, literal = U.sensitivity(F.lit("text_llm"))
    return D.chained(ready(built(spark, sf)), CATALOG.selections).groupBy("selection").agg(F.round(F.sum(hybrid), 2).alias("hybrid_usd"),
        F.round(F.sum(literal), 2).alias("literal_usd"))


@query(_OWNED, """SELECT owner, count(*) AS selected_repos, CAST(sum(downloads) AS BIGINT) AS downloads,
    CAST(sum(likes) AS BIGINT) AS likes, count(cost) AS known_training_costs, round(coalesce(sum(cost), 0), 2) AS cost_usd,
    any_value(names) AS selections FROM
  (SELECT owner, repo_id, arg_min(downloads, nth) AS downloads, arg_min(likes, nth) AS likes, first(cost ORDER BY nth) AS cost FROM fin
      GROUP BY 1, 2) JOIN (SELECT owner AS o2, string_agg(DISTINCT selection, ',' ORDER BY selection) AS names FROM fin
      GROUP BY 1) ON owner = o2 GROUP BY 1""")
def a6_w11_owner_rollup(spark, sf):
    rows = U.owners(U.in_record_order(final(spark, sf), CATALOG))
    return rows.select("owner", "selected_repos", "downloads", "likes", "known_training_costs", F.round(F.coalesce("training_cost_usd",
        F.lit(0.0)), 2).alias("cost_usd"), F.array_join("selections", ",").alias("selections"))


# ---- samples

_CANDIDATES = f"""WITH {Q._CTE},
cand AS (SELECT 'text' AS selection, 'text_llm' AS scope, * FROM k WHERE kind = 'base' AND {_TEXT_SQL} AND NOT is_picture
    UNION ALL SELECT 'pictures', 'diffusion', * FROM k WHERE kind = 'base' AND is_picture),
st AS (SELECT *, ordinal % 5 = 0 AS covered, coalesce(params > 0 AND params / 1e9 >= 34, false) AS census FROM cand),
st2 AS (SELECT *, selection || '|' || CASE WHEN census THEN 'census>=threshold' ELSE bucket END || '|' || CASE WHEN covered THEN 'parquet'
    ELSE 'missing' END AS stratum FROM st),
ranked AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS population, row_number() OVER (PARTITION BY stratum
    ORDER BY sha256(encode('2025') || '\\x00'::BLOB || encode(repo_id)), repo_id) AS n FROM st2),
man AS (SELECT *, CASE WHEN census THEN population ELSE least(population, 20) END AS sample, CASE WHEN census THEN 1
    ELSE population / least(population, 20) END AS weight FROM ranked WHERE census OR n <= 20)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base repositories by metadata of the text and picture selections; text leaves pictures out."""
    rows = S.matched(Q.kinded(spark, sf_dir), TEXT, PICTURES).where("kind = 'base' AND NOT (selection = 'text' AND is_picture)")
    return rows.withColumns({"scope": F.when(F.col("selection") == "pictures", "diffusion").otherwise("text_llm"),
        "covered": F.col("ordinal") % 5 == 0})


@query(_CANDIDATES, "SELECT selection, stratum, repo_id, population, sample, round(weight, 6) AS weight, round(1 / weight, 6) AS inclusion, census, CASE WHEN covered THEN 'parquet' ELSE 'targeted_readme' END AS card_source FROM man")
def m14_w8_sampling_manifest(spark, sf):
    return SA.whole_manifest(candidates(spark, sf), SAMPLING).select("selection", "stratum", "repo_id", "population", "sample",
        F.round("weight", 6).alias("weight"), F.round("inclusion", 6).alias("inclusion"), "census", "card_source")


@query(_CANDIDATES + """,
cap AS (SELECT greatest(0, (SELECT count(*) FROM man WHERE census AND NOT covered) + 7) AS most),
cut AS (SELECT * FROM man WHERE covered OR census UNION ALL SELECT * FROM (SELECT * FROM man WHERE NOT covered AND NOT census
    ORDER BY sha256(encode('2026') || '\\x00'::BLOB || encode(repo_id)), selection, repo_id LIMIT 7))""",
"SELECT stratum, repo_id, count(*) OVER (PARTITION BY stratum) AS sample, round(CASE WHEN census THEN 1 ELSE population / count(*) OVER (PARTITION BY stratum) END, 6) AS weight FROM cut")
def w9_readme_capacity(spark, sf):
    rows = candidates(spark, sf)
    n = SA.stratified(rows, SAMPLING).where("census AND NOT covered").count()
    tight = S.Sampling(sample_per_stratum=20, max_targeted_readmes=n + 7)
    return SA.manifest(rows, tight).select("stratum", "repo_id", "sample", F.round("weight", 6).alias("weight"))


@query(_CANDIDATES, """SELECT selection, count(*) AS candidates, count(*) FILTER (WHERE covered) AS covered,
    any_value(m.manifest) AS manifest, any_value(m.census_rows) AS census, any_value(m.targeted) AS targeted FROM st2
  JOIN (SELECT selection AS s, count(*) AS manifest, count(*) FILTER (WHERE census) AS census_rows,
      count(*) FILTER (WHERE NOT covered) AS targeted FROM man GROUP BY 1) m ON selection = m.s GROUP BY 1""")
def a12_sampling_plan(spark, sf):
    rows = candidates(spark, sf)
    return SA.plan(rows, SA.whole_manifest(rows, SAMPLING), SAMPLING)


_RESULTS = f"""{_CANDIDATES},
q0 AS (SELECT man.* EXCLUDE (params, bucket), {_SIGNAL}, ordinal % 7 <> 0 AS here, CASE WHEN coalesce(params, 0) > 0 THEN params
    WHEN s.v_size > 0 THEN CAST(floor(s.v_size * 1e9) AS BIGINT) ELSE 0 END AS params, CASE WHEN coalesce(params, 0) > 0
    THEN 'hub_safetensors' WHEN s.v_size > 0 THEN 'local_llm_verbatim_model_card' ELSE 'unknown' END AS parameter_source,
  regexp_replace(lower(owner), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS o FROM man JOIN signals s USING (ordinal)),
q1 AS (SELECT *, CASE WHEN coalesce({_SURE} <> 'base', false) THEN NULL WHEN c_type IS NOT NULL AND c_type <> 'declared_base_model'
    THEN c_type WHEN {_INDEPENDENT} THEN 'local_llm_' || v_conf END AS d0, (c_type IS NULL OR c_type = 'declared_base_model') AS renewed,
    c_type IS NOT NULL AND c_type <> 'declared_base_model' AS det FROM q0),
q2 AS (SELECT *, d0 IS NOT NULL AND CASE WHEN renewed THEN (c_type IS NULL OR NOT c_1990 OR selection <> 'text')
    ELSE {_TRAINED_BY} AND (CASE WHEN c_1990 THEN selection <> 'text' ELSE NOT (c_old AND selection = 'text') END) END AS usable FROM q1),
q3 AS (SELECT *, here AND usable AND det AS lower, here AND usable AND coalesce(v_kind = 'independent_base' AND v_conf = 'high',
    false) AS hi, here AND usable AND coalesce(v_kind = 'independent_base' AND v_conf IN ('high', 'medium'), false) AS med,
  usable AND (NOT renewed OR c_type IS NOT NULL) AS tells FROM q2),
q4 AS (SELECT *, lower OR hi AS central, lower OR med AS upper, CASE WHEN tells AND c_active > 0 AND c_active * 1e9 < params
    THEN c_active * 1e9 ELSE params END AS used, CASE WHEN tells AND c_tokens > 0 THEN c_tokens * 1e12 ELSE 20.0 * params END AS seen
    FROM q3),
q5 AS (SELECT *, CASE WHEN here AND params > 0 THEN CASE WHEN selection = 'pictures'
    THEN 6.0 * used * (params * 3072.0) {_RATE} ELSE 6.0 * used * seen {_RATE} END END AS raw,
  CASE WHEN upper AND v_run <> '' AND v_kind IS NOT NULL AND params > 0 THEN {_RUN} END AS rn FROM q4),
q6 AS (SELECT *, rn IS NOT NULL AND row_number() OVER (PARTITION BY selection, rn, params ORDER BY (NOT census), weight,
    repo_id) > 1 AS dup, first_value(repo_id) OVER (PARTITION BY selection, rn, params ORDER BY (NOT census), weight,
    repo_id) AS first_repo FROM q5),
res AS (SELECT * REPLACE (lower AND NOT dup AS lower, central AND NOT dup AS central, upper AND NOT dup AS upper), CASE WHEN dup
    THEN first_repo END AS duplicate_of FROM q6)"""


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = SA.whole_manifest(candidates(spark, sf_dir), SAMPLING).withColumn("card_available", F.col("ordinal") % 7 != 0)
    of = hub.signals(spark, sf_dir).select(F.col("modelId").alias("repo_id"), F.col("compute").alias("reported"), "claim")
    rows = chosen.join(of, "repo_id", "left").join(V.claims_of_reviews(hub.reviews(spark, sf_dir)), "repo_id", "left")
    rows = V.settled(rows, True)
    by_window = F.lit(True)
    for s in (TEXT, PICTURES):
        by_window = F.when(F.col("selection") == s.name, R.in_window(F.col("claim.training_years"), F.col("claim.earliest"), s,
            CATALOG.clock())).otherwise(by_window)
    rows = rows.withColumn("claim", F.when(R.owner_matches(F.col("claim.claimed_trainer"), F.col("owner")) & by_window, F.col("claim")))
    return SA.without_duplicates(SA.results(rows, CATALOG))


@query(_RESULTS, "SELECT selection, repo_id, params, parameter_source, lower, central, upper, round(raw, 2) AS raw_cost_usd, duplicate_of FROM res")
def m15_w7_sampling_results(spark, sf):
    return sampled(spark, sf).select("selection", "repo_id", "params", "parameter_source", "lower", "central", "upper",
        F.round("raw_cost", 2).alias("raw_cost_usd"), "duplicate_of")


@query(_RESULTS, """SELECT selection, stratum, count(*) AS sample, count(*) FILTER (WHERE here) AS cards_available, round(sum(CASE
    WHEN lower THEN weight ELSE 0 END), 6) AS lower_weighted, round(sum(CASE WHEN central THEN weight * coalesce(raw, 0) ELSE 0 END),
    2) AS central_cost,
  round(sum(CASE WHEN upper THEN weight * coalesce(raw, 0) ELSE 0 END), 2) AS upper_cost FROM res GROUP BY 1, 2""")
def a9_a10_weighted_totals(spark, sf):
    return SA.strata(sampled(spark, sf)).select("selection", "stratum", "sample", "cards_available", F.round("lower_weighted",
        6).alias("lower_weighted"), F.round("central_cost", 2).alias("central_cost"), F.round("upper_cost", 2).alias("upper_cost"))


@query(_RESULTS, """SELECT selection, 5e9 AS market_lower, round(greatest(c + 10.5, 5e9), 2) AS market_central, round(greatest(u + 10.5,
    c + 10.5, 5e9), 2) AS market_upper FROM
  (SELECT selection, sum(CASE WHEN central THEN weight * coalesce(raw, 0) ELSE 0 END) AS c, sum(CASE WHEN upper
      THEN weight * coalesce(raw, 0) ELSE 0 END) AS u FROM res WHERE selection = 'text' GROUP BY 1)
  UNION ALL SELECT selection, 0.0, round(sum(CASE WHEN central THEN weight * coalesce(raw, 0) ELSE 0 END), 2), round(sum(CASE WHEN upper
      THEN weight * coalesce(raw, 0) ELSE 0 END), 2) FROM res WHERE selection = 'pictures' GROUP BY 1""")
def a11_j10_market(spark, sf):
    baseline = spark.createDataFrame([("text", 5e9, 10.5)], "selection string, confirmed double, derivatives double")
    return SA.market(sampled(spark, sf), baseline).select("selection", F.round("market_lower", 2).alias("market_lower"),
        F.round("market_central", 2).alias("market_central"), F.round("market_upper", 2).alias("market_upper"))



# ---- card texts

_TOKENS = " UNION ALL ".join(
    f"SELECT card_no, unnest(regexp_extract_all(card, '{p.replace(chr(39), chr(39) * 2)}', {g})) AS v, unnest(regexp_extract_all(card, '{p.replace(chr(39), chr(39) * 2)}', {g + 1})) AS u FROM cards" for p, g in ((C.TOKENS_TRAINED, 1), (C.TOKENS_TRAINED, 3), (C.TOKENS_TRAINED, 5), (C.TOKENS_TRAINED, 7), (C.TOKENS_PRETRAINED, 1))
)
_CARDS = f"""WITH {hub.VIEWS},
tok AS ({_TOKENS}),
best AS (SELECT card_no AS bn, max(CAST(v AS DOUBLE) / CASE WHEN lower(u) IN ('b', 'billion') THEN 1000 ELSE 1 END) AS tokens FROM tok
    WHERE v <> '' GROUP BY 1)"""


def card_signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.signals(hub.cards(spark, sf_dir))


@query(_CARDS, f"""SELECT card_no, round(coalesce(tokens, 0), 6) AS tokens_t, coalesce(nullif(regexp_extract(card,
    '{C.ACTIVE_PARAMETERS}', 1), ''), nullif(regexp_extract(card, '{C.ACTIVE_PARAMETERS}', 2), ''), '0')::DOUBLE AS active_b FROM cards
    LEFT JOIN best ON bn = card_no""")
def a15_card_tokens(spark, sf):
    """Tokens and active parameters of all cards, by the JVM's own expressions."""
    def most(pattern: str, groups: int):
        each = [F.zip_with(F.regexp_extract_all("card", F.lit(P.java(pattern)), F.lit(g)), F.regexp_extract_all("card",
            F.lit(P.java(pattern)), F.lit(g + 1)), lambda v, u: v.try_cast("double") / F.when(F.lower(u).isin("b", "billion"),
            1000.0).otherwise(1.0)) for g in range(1, groups + 1, 2)]
        return F.array_max(F.array_compact(F.concat(*each)))

    active = lambda g: F.nullif(F.regexp_extract("card", P.java(C.ACTIVE_PARAMETERS), g), F.lit(""))
    tokens = F.greatest(most(C.TOKENS_TRAINED, 8), most(C.TOKENS_PRETRAINED, 2))
    return hub.cards(spark, sf).select("card_no", F.round(F.coalesce(tokens, F.lit(0.0)), 6).alias("tokens_t"), F.coalesce(active(1),
        active(2), F.lit("0")).cast("double").alias("active_b"))


@query(None)
def card_signals(spark, sf):
    """Status, compute and claims of all cards that may matter; held against cases in the tests, as it needs offsets."""
    rows = G.with_earliest(card_signal_rows(spark, sf))
    return rows.select("modelId", "status", "reason", "compute.gpu_hours", "compute.cost_usd", "compute.cost_method",
        "claim.evidence_type", "claim.training_tokens_t", "claim.active_parameters_b", "claim.claimed_trainer",
        F.col("compute.earliest").alias("compute_earliest"), F.col("claim.earliest").alias("claim_earliest"))


# ---- from cards, metadata and readmes to costed records

_NAMED = Q._like("repo_id", C.BASE_NAME)
_CARD_SIGNALS = f"""src AS (SELECT k.ordinal, k.repo_id, k.kind = 'base' AS base, d.doc_id IS NOT NULL AS carded, k.ordinal % 8 AS says,
    {_NAMED} AS named, k.ordinal % 6 = 1 AS readable, k.ordinal % 20 AS m,
  json_type(cd) = 'OBJECT' AND len(json_keys(cd)) > 0 AS has_meta FROM k LEFT JOIN documents d ON d.doc_id = k.ordinal),
own AS (SELECT *, CASE m WHEN 7 THEN 3.7 WHEN 13 THEN 23.125 END AS m_cost, CASE WHEN NOT base THEN NULL WHEN m = 13
    THEN 'explicit_scratch' WHEN named AND (m = 7 OR has_meta) THEN 'declared_base_model' END AS m_type,
  CASE WHEN carded THEN CASE says WHEN 2 THEN 532.8 WHEN 3 THEN 1250.5 WHEN 4 THEN 9250.0 END END AS b_cost,
  CASE WHEN base AND carded THEN CASE WHEN says = 1 THEN 'explicit_scratch' WHEN says = 5 THEN 'pretraining_evidence' WHEN named
      THEN 'declared_base_model' END END AS b_type FROM src),
met AS (SELECT *, coalesce(b_cost, m_cost) AS cost0, CASE WHEN carded THEN b_type ELSE m_type END AS type0, m_cost IS NULL OR (base
    AND m_type IS NULL) AS open FROM own),
fin_sig AS (SELECT *, readable AND open AND (cost0 IS NULL OR (base AND type0 IS NULL)) AS reads FROM met),
signals AS (SELECT f.ordinal, reads OR cost0 IS NOT NULL AS told, 0.0 AS r_hours, CASE WHEN reads THEN 74.0 ELSE cost0 END AS r_cost, CASE
    WHEN NOT reads AND b_cost = 1250.5 THEN 'reported_total_cost' ELSE 'gpu_hours_x_hourly_rate' END AS r_method, '' AS run_hash,
    '' AS evidence_hash,
  CAST([] AS INTEGER[]) AS r_years, '' AS r_evidence, NOT reads AND b_cost = 532.8 AS r_old, CASE WHEN reads AND base AND named
      THEN 'declared_base_model' ELSE type0 END AS c_type, '' AS c_trainer, carded AND says = 7 AS c_1990, carded AND says IN (2,
      5) AS c_old,
  CASE WHEN carded AND says = 6 THEN 3.0 ELSE 0.0 END AS c_active, CASE WHEN carded AND says = 1 THEN 2.5 WHEN carded AND says = 5
      THEN 0.3 ELSE 0.0 END AS c_tokens, '' AS c_card, '' AS c_run, v_kind, v_conf, v_run, v_size FROM fin_sig f
      JOIN made USING (ordinal))"""
_CARD_RECORDS = f"WITH {Q._CTE.replace('signals AS (', 'made AS (')},\n{_CARD_SIGNALS},\n{_records_sql(True)}{_LIMITED}"


@query(_CARD_RECORDS, f"{_SHOW} rec")
def m13_s4_records_of_cards(spark, sf):
    """Records whose compute and claims are read from metadata, bulk cards and readmes."""
    models, now = hub.with_run_metadata(Q.kinded(spark, sf)), CATALOG.clock()
    rows = S.matched(R.effective_parameters(models, hub.base_params(spark, sf)), *CATALOG.selections, now=now)
    found = T.resolved(T.wanted(rows, CATALOG.selections), hub.model_cards(spark, sf), hub.readmes(spark, sf))
    return _shown(R.build(models, found, hub.reviews(spark, sf), hub.base_params(spark, sf), CATALOG, now))


_CLAIM_IS = Q._like("card", C.SCRATCH_CLAIM.replace("'", "''"))


@query(f"WITH {hub.VIEWS}", f"SELECT card_no, CASE WHEN {_CLAIM_IS} THEN 'claims' ELSE 'candidate' END AS status FROM cards")
def m2_claims_scratch(spark, sf):
    return hub.cards(spark, sf).select("card_no", F.when(P.matches(F.col("card"), C.SCRATCH_CLAIM),
        "claims").otherwise("candidate").alias("status"))


SAYINGS = (
    "It was trained from scratch.", "It was never trained from scratch.", "Only the tokenizer was trained from scratch.", "Модель обучена с нуля.",
    "This model is a distilled version of one trained from scratch.", "It was trained from scratch, followed by instruction fine-tuning.",
    "For comparison, others trained from scratch; ours was trained on scores from scratch.", "Nothing is said.",
)


def sayings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a sentence or two on their training, before, behind or in between."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (F.array(*map(F.lit, SAYINGS))[(c % len(SAYINGS)).cast("int")] for c in (F.col("doc_id"), F.floor(F.col("doc_id") / 8)))
    left = F.substring("text", 1, F.least(F.length("text"), F.lit(150)))
    return d.select("doc_id", F.concat_ws(" ", one, left, two, "text").alias("card"))


def _cut(start: str, stop: str, width: int) -> str:
    """The text from width bytes before start to as many after stop, without characters that a border cuts."""
    part = f"hex(array_slice(b, greatest({start} - {width}, 0) + 1, {stop} + {width}))"
    part = f"regexp_replace({part}, '^([89AB][0-9A-F])+', '')"
    tail = "([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$"
    even = f"CASE WHEN {part} SIMILAR TO '([0-7].|[CD].[89AB].|E.([89AB].){{{{2}}}}|F.([89AB].){{{{3}}}})*' THEN {part} ELSE regexp_replace({part}, '{tail}', '') END"
    return f"decode(unhex({even.replace('{{', '{').replace('}}', '}')}))"


_NO = " OR ".join(f"regexp_matches(near, '{p.replace(chr(39), chr(39) * 2)}')" for p in (C.SCRATCH_NEGATED, C.SCRATCH_OF_PART, C.RANDOM_PART, C.SCRATCH_NOT_DONE, C.SCRATCH_UPSTREAM, C.DERIVATIVE_NEARBY))
_SAID = f"""WITH s AS (SELECT doc_id, concat_ws(' ', {hub._sql_of(SAYINGS, 'doc_id')}, left(text, 150), {hub._sql_of(SAYINGS, '(doc_id // 8)')}, text) AS card FROM documents),
m AS (SELECT *, encode(card) AS b, regexp_extract_all(card, '{C.SCRATCH_CLAIM.replace("'", "''")}') AS ms, string_split_regex(card, '{C.SCRATCH_CLAIM.replace("'", "''")}') AS ps FROM s),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
f AS (SELECT *, list_sum(list_transform(ps[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: strlen(x))), 0) AS a FROM e),
g AS (SELECT doc_id, i, {_cut("a", "a + strlen(ms[i])", 100)} AS near, {_cut("a", "a + strlen(ms[i])", 300)} AS wide FROM f),
u AS (SELECT doc_id, arg_min(near, i) AS near FROM g WHERE NOT ({_NO} OR regexp_matches(wide, '{C.DERIVATIVE_SEQUENCE}')) GROUP BY 1)"""


@query(_SAID, f"""SELECT m.doc_id, CASE WHEN len(ms) = 0 THEN 'candidate' WHEN near IS NULL OR regexp_matches(card, '{C.DERIVATIVE_ITSELF}') THEN 'excluded' ELSE 'confirmed' END AS status,
  CASE WHEN len(ms) = 0 THEN 'no_explicit_scratch_claim' WHEN near IS NULL THEN 'scratch_claim_not_usable' WHEN regexp_matches(card, '{C.DERIVATIVE_ITSELF}') THEN 'current_model_is_derivative' ELSE 'explicit_scratch_claim' END AS reason,
  CASE WHEN len(ms) > 0 AND near IS NOT NULL AND NOT regexp_matches(card, '{C.DERIVATIVE_ITSELF}') THEN left(trim(regexp_replace(near, '[\\t-\\r \\x{{85}}\\x{{a0}}\\x{{3000}}]+', ' ', 'g')), 500) ELSE '' END AS evidence
  FROM m LEFT JOIN u ON u.doc_id = m.doc_id""")
def m2_scratch_status(spark, sf):
    """What texts say of their training, by windows of bytes around each claim, in SQL functions."""
    return W.scratch_status(sayings(spark, sf)).select("doc_id", "status", "reason", "evidence")


# ---- the scan by year

PAGE_ROWS = 100
_LISTED = """listed AS (SELECT *, (row_number() OVER (ORDER BY created_at DESC, ordinal) - 1) // 100 + 1 AS page FROM models)"""


def landed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The models as pages of a newest-first listing."""
    rows = numbered(hub.models(spark, sf), [F.col("created_at").desc(), F.col("ordinal").asc()]).withColumn("page",
        F.floor(F.col("place") / PAGE_ROWS) + 1)
    pages = rows.groupBy("page").agg(F.collect_list(F.struct(*hub.models(spark, sf).columns)).alias("items"))  # PAGE_ROWS at most
    return pages.withColumn("next", F.concat(F.lit("page="), F.col("page") + 1))


_READ = f"""{_LISTED},
stop AS (SELECT min(page) AS last FROM listed WHERE year(created_at) < 1996),
seen AS (SELECT listed.*, year(created_at) AS year FROM listed, stop WHERE page <= last AND year(created_at) IN (1996, 1998)),
judged AS (SELECT s.*, r.reason AS why, CASE WHEN d.doc_id IS NULL THEN 0 WHEN s.ordinal % 29 = 5 THEN 2 WHEN s.ordinal % 8 = 1 THEN 1
    ELSE 0 END AS says
  FROM seen s JOIN ({Q.METADATA_SQL}) r ON r.repo_id = s.repo_id LEFT JOIN documents d ON d.doc_id = s.ordinal),
told AS (SELECT year, CASE WHEN why <> 'pending' THEN 'excluded' WHEN says = 2 THEN 'error' WHEN says = 1 THEN 'confirmed'
    ELSE 'candidate' END AS status,
  CASE WHEN why <> 'pending' THEN why WHEN says = 2 THEN 'readme_fetch_error' WHEN says = 1 THEN 'explicit_scratch_claim'
      ELSE 'no_explicit_scratch_claim' END AS reason FROM judged)"""


def counted(spark: SparkSession, sf: str) -> DataFrame:
    models, _ = PG.scanned(landed_pages(spark, sf), [1996, 1998])
    texts = hub.model_cards(spark, sf).where("place >= 0").select(F.col("modelId").alias("repo_id"), F.col("card").alias("readme"),
        F.when(F.col("place") % 29 == 5, "timeout").alias("error"))
    return Y.counts(Y.classified(models, texts))


@query(f"WITH {Q._CTE},\n{_READ}", "SELECT year, status, reason, count(*) AS rows FROM told GROUP BY GROUPING SETS ((year, status), (year, reason))")
def a1_a2_counts_by_year(spark, sf):
    """From landed pages to counts: the prefix of pages, metadata, texts, and one grouping."""
    return counted(spark, sf)


@query(f"WITH {Q._CTE},\n{_READ}", """SELECT year, count(*) FILTER (WHERE status = 'confirmed') AS confirmed,
    count(*) FILTER (WHERE status = 'candidate') AS candidate, count(*) FILTER (WHERE status = 'excluded') AS excluded,
    count(*) FILTER (WHERE status = 'error') AS error,
  count(*) FILTER (WHERE status IN ('confirmed', 'candidate')) AS broad_upper_bound, any_value(m.reasons) AS reasons
  FROM told JOIN (SELECT year AS y, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT year, reason,
      count(*) AS n FROM told GROUP BY 1, 2) GROUP BY 1) m ON m.y = year GROUP BY 1""")
def a2_k2_year_summary(spark, sf):
    reasons = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return Y.by_year(counted(spark, sf)).withColumn("reasons", reasons)


@query(f"WITH {Q._CTE},\n{_LISTED}", """SELECT repo_id, page, year(created_at) AS year FROM listed WHERE page <= least(7,
    (SELECT min(page) FROM listed WHERE year(created_at) < 2000)) AND year(created_at) IN (2000, 2001)""")
def s1_scan_prefix(spark, sf):
    models, _ = PG.scanned(landed_pages(spark, sf), [2000, 2001], max_pages=7)
    return models.select("repo_id", "page", "year")


@query(f"WITH {hub.VIEWS}", """SELECT repo_id, author, downloads, likes, pipeline_tag, library_name, coalesce(params, -1) AS params, relation,
  base_model, created_at, array_to_string(list_transform(files, lambda f: coalesce(f, '-')), ',') AS files, array_to_string(list_transform(tags, lambda t: coalesce(t, '-')), ',') AS tags,
  CASE WHEN json_valid(card_data) THEN json_extract_string(card_data, '$.license') END AS license FROM models""")
def s1_p3_listed_models(spark, sf):
    """Models through the JSON of a listing and back: nested fields, the first base model, metadata as text."""
    known = F.try_parse_json("card_data").isNotNull()
    more = F.array(F.struct(F.col("base_model").alias("id")), F.struct(F.lit("other/base").alias("id")))
    item = F.struct(
        F.col("repo_id").alias("id"), "author", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("createdAt"),
        "downloads", "likes", "pipeline_tag", "library_name", "tags", F.transform("files", lambda f: F.struct(f.alias("rfilename"))).alias("siblings"),
        F.struct(F.col("params").alias("total")).alias("safetensors"),
        F.struct("relation", F.when(F.col("base_model").isNotNull(), more).alias("models")).alias("baseModels"), F.lit("@").alias("cardData"),
    )
    text = F.replace(F.to_json(item), F.lit('"@"'), F.when(known, F.col("card_data")).otherwise("null"))
    listed = hub.models(spark, sf).select(F.from_json(text, PG.LISTED).alias("m")).select("m.*")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit("-"))), ",").alias(c)
    return PG.models_of(listed).select(
        "repo_id", "author", "downloads", "likes", "pipeline_tag", "library_name", F.coalesce("params", F.lit(-1)).alias("params"), "relation",
        "base_model", "created_at", shown("files"),
        shown("tags"), F.get_json_object("card_data", "$.license").alias("license"),
    )


# ---- reviews by content


_QUESTIONS = r"""q AS (SELECT 'card/' || doc_id AS repo_id, CASE WHEN doc_id % 10 = 3 THEN ' ' ELSE text END AS card, doc_id % 4 AS t,
    doc_id % 3 AS p, source FROM documents),
h AS (SELECT *, trim(regexp_replace(card, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ',
    'g')) AS plain FROM q),
keys AS (SELECT *, CASE WHEN plain <> '' THEN sha256(concat_ws('|#|', 'review-1', 'text_llm', sha256(plain), 'text-generation', '', CASE t
    WHEN 0 THEN 'en|llm' ELSE 'llm' END, '', source, p::VARCHAR)) END AS k FROM h),
cached AS (SELECT DISTINCT k FROM keys WHERE regexp_extract(repo_id, '[0-9]+')::INTEGER % 5 = 0 AND k IS NOT NULL)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    none = F.lit(None).cast("string")
    return d.select(
        F.concat(F.lit("card/"), F.col("doc_id").cast("string")).alias("repo_id"), F.when(F.col("doc_id") % 10 == 3,
            " ").otherwise(F.col("text")).alias("card"), F.lit("text-generation").alias("pipeline_tag"), none.alias("library_name"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("llm"), F.lit("en"))).otherwise(F.array(F.lit("llm"))).alias("tags"),
            none.alias("relation"), F.array("source").alias("base_models"), (F.col("doc_id") % 3).alias("params"), "doc_id",
    )


@query(f"WITH {_QUESTIONS}", """SELECT repo_id, CASE WHEN k IS NULL THEN 'blank' WHEN k IN (SELECT k FROM cached) THEN 'cached'
    WHEN row_number() OVER (PARTITION BY k ORDER BY repo_id) = 1 THEN 'asked' ELSE 'shared' END AS how FROM keys""")
def j12_review_plan(spark, sf):
    """How each card's review is met: known by its content, asked for, or shared with an equal question."""
    rows = VC.keyed(questions(spark, sf))
    cache = rows.where("doc_id % 5 = 0 AND key IS NOT NULL").select("key").distinct()
    return VC.planned(rows, cache).select("repo_id", "how")
