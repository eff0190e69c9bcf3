"""Outputs of a run: tables as CSV and JSON written by the executors, small summaries and reports rendered on the driver.

Tables are folders of part files (Spark's committer makes them appear at once); only aggregates of bounded size (a row for
each selection, owners' first 100, counters) reach the driver.

Edge cases. Nulls are empty in CSV and left out in JSON; nested values are JSON text; lists are joined with a pipe; an empty
table writes its header only; an output that exists is replaced.
"""

from __future__ import annotations

import json
import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summary import MAPS, top_owners
from ..operators.taxonomy import BUCKETS

#: Columns of the tables.
RECORD_COLUMNS = (
    "selection", "repo_id", "repo_url", "owner", "owner_type", "created_at", "last_modified", "pipeline_tag", "library_name",
        "model_kind", "base_model", "own_parameters", "effective_parameters", "parameters_b", "downloads", "likes",
    "lower_training_cost_usd", "training_cost_usd", "upper_training_cost_usd", "training_cost_method", "training_cost_tier",
        "reported_compute_json", "scratch_claim_json", "local_llm_review_json", "tags", "compute_estimates_json", "errors",
)
OWNER_COLUMNS = (
    "owner", "owner_type", "profile_url", "fullname", "verified", "pro", "plan", "followers", "models", "datasets", "spaces", "papers",
        "members", "created_at", "details", "selected_repos", "selected_downloads", "selected_likes", "known_training_costs",
    "training_cost_usd", "selections", "error",
)
PROFILE_TEXTS, PROFILE_FLAGS, PROFILE_NUMBERS = ("plan", "created_at", "details"), ("verified", "pro"), ("followers", "models",
    "datasets", "spaces", "papers", "members")
RESULT_COLUMNS = (
    "selection", "repo_id", "owner", "parameters", "parameter_source", "parameter_range", "card_source", "card_available", "census",
        "stratum", "sampling_weight", "llm_kind", "llm_confidence", "independent_lower", "independent_central", "independent_upper",
    "duplicate_of", "raw_cost_usd", "weighted_lower_usd", "weighted_central_usd", "weighted_upper_usd", "error",
)
CANDIDATE_COLUMNS = ("selection", "repo_id", "owner", "created_at", "pipeline_tag", "library_name", "parameters", "downloads", "likes",
    "tags")
MANIFEST_COLUMNS = ("selection", "scope", "repo_id", "owner", "parameters", "parameter_range", "card_source", "census", "stratum",
    "stratum_population", "stratum_sample", "inclusion_probability", "sampling_weight")
YEAR_COLUMNS = ("year", "repo_id", "created_at", "status", "reason", "evidence")
REPORT_KINDS = ("base", "fork", "finetune", "adapter", "quantized", "merge")


def _money(name: str) -> Column:
    return F.format_string("%.2f", F.col(name))


def _time(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record_table(records: DataFrame, endpoint: str) -> DataFrame:
    """Records as the columns of models.csv, all text."""
    has = set(records.columns)
    values = {
        "repo_url": F.concat(F.lit(endpoint.rstrip("/") + "/"), "repo_id"), "created_at": _time("created_at"),
            "last_modified": F.col("last_modified") if "last_modified" in has else F.lit(""), "model_kind": F.col("kind"),
        "own_parameters": F.coalesce("own_params", F.lit(0)), "effective_parameters": F.coalesce("params", F.lit(0)),
            "parameters_b": F.when(F.col("params") > 0, F.format_string("%.6f", F.col("params") / 1e9)),
        "lower_training_cost_usd": F.when(F.col("lower").isNotNull(), _money("lower")),
            "training_cost_usd": F.when(F.col("cost").isNotNull(), _money("cost")),
            "upper_training_cost_usd": F.when(F.col("upper").isNotNull(), _money("upper")),
        "training_cost_method": F.col("method"), "training_cost_tier": F.col("tier"), "reported_compute_json": F.to_json("reported"),
            "scratch_claim_json": F.to_json("claim"), "local_llm_review_json": F.to_json("review"),
        "tags": F.array_join("tags", "|"), "compute_estimates_json": F.when(F.size("compute") > 0,
            F.to_json("compute")).otherwise("null"), "errors": F.array_join("errors", " | "),
    }
    return records.select(*[F.coalesce(values.get(n, F.col(n) if n in has else F.lit("")).cast("string"),
        F.lit("")).alias(n) for n in RECORD_COLUMNS])


def owner_table(owners: DataFrame, profiles: DataFrame, site: str) -> DataFrame:
    """Owners with a selected repository, most downloads first. profiles bear owner, owner_type and what they know of the other
    columns; an owner without a profile is `unknown`, with an error."""
    rank = F.when(F.col("owner_type") == "organization", 0).otherwise(1)
    has = set(profiles.columns)
    told = [c for c in (*PROFILE_TEXTS, *PROFILE_FLAGS, *PROFILE_NUMBERS, "full_name", "error") if c in has]
    one = profiles.groupBy("owner").agg(F.min_by(F.struct("owner_type", *told), rank).alias("p"))
    rows = owners.where("selected_repos > 0").join(one, "owner", "left")
    of = lambda c, default: F.coalesce(F.col(f"p.{c}"), F.lit(default)) if c in has else F.lit(default)
    values = {c: of(c, "") for c in PROFILE_TEXTS} | {c: of(c, False) for c in PROFILE_FLAGS} | {c: of(c,
        0).cast("long") for c in PROFILE_NUMBERS}
    values |= {
        "owner_type": F.coalesce("p.owner_type", F.lit("unknown")), "profile_url": F.concat(F.lit(site.rstrip("/") + "/"), "owner"),
            "fullname": of("full_name", ""), "selected_downloads": F.col("downloads"), "selected_likes": F.col("likes"),
        "training_cost_usd": F.format_string("%.2f", F.coalesce("training_cost_usd", F.lit(0.0))),
            "selections": F.array_join("selections", "|"), "error": F.coalesce(F.nullif(of("error", ""), F.lit("")),
            F.when(F.col("p").isNull(), "profile not found"), F.lit("")),
    }
    return rows.select(*[values.get(n, F.col(n)).alias(n) for n in OWNER_COLUMNS]).orderBy(F.desc("selected_downloads"), "owner")


def candidate_table(candidates: DataFrame) -> DataFrame:
    values = {"created_at": _time("created_at"), "parameters": F.coalesce("params", F.lit(0)), "tags": F.array_join("tags", "|")}
    return candidates.select(*[values.get(n, F.col(n)).alias(n) for n in CANDIDATE_COLUMNS])


def manifest_table(manifest: DataFrame) -> DataFrame:
    names = {"parameters": "params", "parameter_range": "bucket", "stratum_population": "population", "stratum_sample": "sample",
        "inclusion_probability": "inclusion", "sampling_weight": "weight"}
    return manifest.select(*[F.col(names.get(n, n)).alias(n) for n in MANIFEST_COLUMNS])


def result_table(found: DataFrame) -> DataFrame:
    """Results of a sample, costs weighted."""
    cost = F.coalesce("raw_cost", F.lit(0.0))
    fixed = lambda c: F.format_string("%.6f", c)
    values = {"parameters": "params", "parameter_range": "bucket", "sampling_weight": "weight", "llm_kind": "review.kind",
        "llm_confidence": "review.confidence"} | {f"independent_{f}": f for f in ("lower", "central", "upper")}
    values = {n: F.col(c) for n, c in values.items()} | {"raw_cost_usd": fixed(cost)} | {f"weighted_{f}_usd": fixed(F.when(F.col(f),
        cost * F.col("weight")).otherwise(0.0)) for f in ("lower", "central", "upper")}
    texts = ("llm_kind", "llm_confidence", "duplicate_of", "error")
    return found.select(*[(F.coalesce(values.get(n, F.col(n)), F.lit("")) if n in texts else values.get(n,
        F.col(n))).alias(n) for n in RESULT_COLUMNS])


def year_table(classified: DataFrame) -> DataFrame:
    return classified.select(*[(_time(n) if n == "created_at" else F.col(n)).alias(n) for n in YEAR_COLUMNS])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file through Hadoop's file system, so that any shared store will do."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def file_component(name: str) -> str:
    """A selection's name as part of a file name."""
    return re.sub("[^a-z0-9]+", "-", name.strip().lower()).strip("-") or "selection"


def write_candidates(candidates: DataFrame, path: str) -> None:
    """A folder for each selection, by one pass."""
    table = candidate_table(candidates)
    component = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(F.trim("selection")), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")),
        F.lit("selection"))
    table.withColumn("component", component).write.mode("overwrite").partitionBy("component").option("header", True).option("escape",
        '"').csv(path)


def summary_json(rows: DataFrame, **counters) -> str:
    """summary.json of selections' rows (one for each selection)."""
    out = {r["selection"]: {k: v for k, v in r.asDict(recursive=True).items() if k != "selection"} for r in rows.collect()}
    for item in out.values():
        for name in MAPS:
            item[name] = dict(sorted((item[name] or {}).items()))
    return json.dumps(counters | {"selections": dict(sorted(out.items()))}, indent=2, ensure_ascii=False) + "\n"


def years_json(counts: DataFrame, complete: bool) -> str:
    """The summary of a scan by year: statuses, reasons, and the broad upper bound, from a row for each year."""
    statuses = ("confirmed", "candidate", "excluded", "error")
    years = {r["year"]: {s: r[s] for s in statuses if r[s]} | {"reasons": r["reasons"],
        "broad_upper_bound": r["broad_upper_bound"]} for r in counts.collect()}
    return json.dumps({"complete": complete, "years": {str(y): years[y] for y in sorted(years)}}, indent=2, sort_keys=True) + "\n"


def _table(head: tuple[str, ...], rows: list[tuple]) -> str:
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(map(str,
        r)) + " |" for r in rows]]) + "\n"


def report(rows: DataFrame, owners: DataFrame, site: str = "") -> str:
    """report.md: ranges of cost, kinds and sizes in fixed order, and the 100 owners of largest cost."""
    out = ["# Training cost of published models\n"]
    for r in sorted(rows.collect(), key=lambda r: r["selection"]):
        item = r.asDict(recursive=True)
        out.append(f"## {item['selection']}\n")
        if item["description"]:
            out.append(item["description"] + "\n")
        for label, usd, n in (("Lower bound", "lower_training_cost_usd", "lower_costed_models"), ("Central estimate",
            "total_training_cost_usd", "known_training_costs"), ("Upper estimate", "upper_training_cost_usd", "upper_costed_models")):
            out.append(f"- {label}: **${item[usd]:.2f}** ({item[n]} runs)")
        if item["market_scope"] != "diffusion":
            out.append(f"- 20 tokens a parameter, active share: **${item['formula20_hybrid_usd']:.2f}**; total parameters: **${item['formula20_literal_usd']:.2f}**")
        out.append(f"- Repositories: {item['models']}; owners: {item['unique_owners']}; downloads: {item['total_downloads']}; likes: {item['total_likes']}")
        out.append(f"- Reviews: {item['reviewed']}; high={item['reviewed_high']}, medium={item['reviewed_medium']}, low={item['reviewed_low']}\n")
        maps = {k: item[k] or {} for k in MAPS}
        kinds = [(k, maps["model_kinds"][k], maps["costed_models_by_kind"].get(k, 0),
            f"{maps['training_cost_by_kind'].get(k, 0.0):.2f}") for k in REPORT_KINDS if maps["model_kinds"].get(k)]
        sizes = [(b, maps["base_models_by_size"][b], maps["costed_base_by_size"].get(b, 0),
            f"{maps['base_cost_by_size'].get(b) or 0.0:.2f}") for b in (*[n for _, n in BUCKETS], ">=500B",
            "unknown") if maps["base_models_by_size"].get(b)]
        out += [_table(("Kind", "Repositories", "Costed runs", "USD"), kinds), _table(("Parameters", "Base repositories", "Costed runs",
            "USD"), sizes)]
    best = top_owners(owners.where("known_training_costs > 0")).collect()
    if best:
        named = lambda o: f"[{o.replace('|', chr(92) + '|')}]({site}/{quote(o, safe='')})"
        out += ["## Owners of largest cost\n", _table(("Owner", "Costed models", "USD"), [(named(r["owner"]), r["known_training_costs"],
            f"{r['training_cost_usd']:.2f}") for r in best])]
    return "\n".join(out)
