"""Runs published as a whole: several tables and texts appear together, by one manifest.

A run's outputs are written into a folder of their own; then one small file, `current.json`, is written beside it and moved over the
old one. Readers go by that file, so they see all outputs of one run or all of another, and a run that fails half-way changes
nothing for them. Older runs stay until `prune` removes them.

Edge cases. Empty tables are published with their columns; a path without a manifest has no run; publishing again makes a new run.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as SA
from ..operators import summary as U
from ..operators import year_counts as Y
from ..operators.selection import Catalog, Sampling
from . import outputs as O


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], texts: dict[str, str] | None = None) -> dict:
    """Each table as CSV with a header and as JSON lines, and each text as a file; then the manifest that makes them current."""
    run = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/run-{run}"
    for name, df in tables.items():
        df = df.cache() if not df.is_cached else df
        O.write_csv(_flat(df), f"{folder}/{name}.csv")
        O.write_json(df, f"{folder}/{name}.json")
        df.unpersist()
    for name, text in (texts or {}).items():
        O.write_text(spark, text, f"{folder}/{name}")
    manifest = {"run": run, "generated_at": datetime.now(UTC).isoformat(), "tables": {n: df.columns for n, df in tables.items()},
        "texts": sorted(texts or {})}
    fresh, fs = _at(spark, f"{folder}/current.json")
    O.write_text(spark, json.dumps(manifest, indent=2) + "\n", f"{folder}/current.json")
    current, _ = _at(spark, f"{path.rstrip('/')}/current.json")
    if fs.exists(current):
        fs.delete(current, False)
    if not fs.rename(fresh, current):
        raise OSError(f"could not publish {current}")
    return manifest


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("struct", "array",
        "map")) else F.col(f.name) for f in df.schema.fields])


def current(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the current run, or None."""
    at, fs = _at(spark, f"{path.rstrip('/')}/current.json")
    if not fs.exists(at):
        return None
    return json.loads(spark.read.text(at.toString(), wholetext=True).first()[0])


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current run, all columns as text; nulls are empty."""
    found = current(spark, path)
    schema = ", ".join(f"`{c}` string" for c in found["tables"][name])
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue",
        "").schema(schema).csv(f"{path.rstrip('/')}/run-{found['run']}/{name}.csv").na.fill("")


def read_text(spark: SparkSession, path: str, name: str) -> str:
    return spark.read.text(f"{path.rstrip('/')}/run-{current(spark, path)['run']}/{name}", wholetext=True).first()[0]


def prune(spark: SparkSession, path: str) -> int:
    """Remove all runs but the current one; gives their number."""
    keep = f"run-{(current(spark, path) or {'run': ''})['run']}"
    at, fs = _at(spark, path)
    old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("run-") and s.getPath().getName() != keep]
    for p in old:
        fs.delete(p, True)
    return len(old)


def publish_scan(path: str, classified: DataFrame, complete: bool) -> dict:
    """models and summary.json of a scan by year."""
    years = Y.by_year(Y.counts(classified))
    return publish(classified.sparkSession, path, {"models": O.year_table(classified)}, {"summary.json": O.years_json(years, complete)})


def publish_candidates(path: str, matched: DataFrame) -> dict:
    """Before any card is read: each selection's base candidates, and pre-llm-summary.json."""
    spark = matched.sparkSession
    funnel = U.funnel(matched)
    names = {r["selection"]: f"pre-llm-{O.file_component(r['selection'])}-base-candidates" for r in funnel.select("selection").collect()}
    bases = matched.where("kind = 'base'")
    tables = {file: O.candidate_table(bases.where(F.col("selection") == name)).orderBy("repo_id") for name, file in names.items()}
    rows = sorted((r.asDict() for r in funnel.collect()), key=lambda r: r["selection"])
    summary = [
        {"selection": r["selection"], "repositories": r["repositories"], "preliminary_kinds": r["kinds"], "base_candidates": r["bases"],
            "base_with_known_parameters": r["with_parameters"], "base_without_parameters": r["without_parameters"],
         "candidate_json": f"{names[r['selection']]}.json", "candidate_csv": f"{names[r['selection']]}.csv"}
        for r in rows
    ]
    return publish(spark, path, tables, {"pre-llm-summary.json": json.dumps(summary, indent=2) + "\n"})


def publish_catalog(path: str, records: DataFrame, profiles: DataFrame, catalog: Catalog, complete: bool = True, **counters) -> dict:
    """models, owners, summary.json and report.md of final records (with owner_type)."""
    spark, site = records.sparkSession, catalog.endpoint or "https://localhost"
    totals, owners = U.selections(records, catalog), U.owners(U.in_record_order(records, catalog))
    texts = {"summary.json": O.summary_json(totals, effective_now=catalog.clock().isoformat() + "Z", complete=complete, **counters),
        "report.md": O.report(totals, owners, site)}
    return publish(spark, path, {"models": O.record_table(records, site), "owners": O.owner_table(owners, profiles, site)}, texts)


def sampling_plan(candidates: DataFrame, chosen: DataFrame, s: Sampling) -> dict:
    """Counters of a plan, by selection and by stratum."""
    by_selection = [r.asDict() for r in SA.plan(candidates, chosen, s).collect()]
    covered = chosen.where("covered").count()
    strata = chosen.groupBy("stratum").agg(F.max("population").alias("population"), F.count(F.lit(1)).alias("sample")).collect()
    total = lambda k: sum(r[k] for r in by_selection)
    maps = {"base_candidates_by_selection": "candidates", "manifest_entries_by_selection": "manifest"}
    return {
        "seed": s.seed, "base_candidates": total("candidates"), "parquet_covered_candidates": total("covered"),
            "missing_candidates": total("candidates") - total("covered"), "manifest_entries": total("manifest"),
            "covered_manifest_entries": covered,
        "targeted_readme_requests": total("targeted"), "census_entries": total("census"), **{n: dict(sorted((r["selection"],
            r[k]) for r in by_selection)) for n, k in maps.items()},
        "population_by_stratum": dict(sorted((r["stratum"], r["population"]) for r in strata)),
            "sample_by_stratum": dict(sorted((r["stratum"], r["sample"]) for r in strata)),
    }


def sampling_summary(plan: dict, found: DataFrame, baseline: DataFrame | None) -> dict:
    """Weighted totals by selection and stratum, and the market's range beside the baseline (None: there is none)."""
    spark = found.sparkSession
    base = baseline if baseline is not None else spark.createDataFrame([], "selection string, confirmed double, derivatives double")
    of_strata: dict[str, dict] = {}
    for r in SA.strata(found, "selection", "stratum").collect():
        of_strata.setdefault(r["selection"], {})[r["stratum"]] = {"population": plan["population_by_stratum"].get(r["stratum"],
            0)} | {k: v for k, v in r.asDict().items() if k not in ("selection", "stratum", "unknown_parameters")}
    market = {r["selection"]: r.asDict() for r in SA.market(found, base).collect()}
    selections = {}
    for name, count in plan["base_candidates_by_selection"].items():
        m = market.get(name, {})
        number = lambda k, m=m: m.get(k) or 0.0
        selections[name] = {
            "base_candidates": count, "sample": m.get("sample", 0), "cards_available": m.get("cards_available", 0),
                "uncostable_unknown_parameters": m.get("unknown_parameters", 0), "estimated_base_lower_usd": number("lower_cost"),
            "estimated_base_central_usd": number("central_cost"), "estimated_base_upper_usd": number("upper_cost"),
                "confirmed_baseline_usd": number("confirmed"), "reported_derivative_usd": number("derivatives"),
                "market_lower_usd": number("market_lower"),
            "market_central_usd": number("market_central"), "market_upper_usd": number("market_upper"),
                "strata": dict(sorted(of_strata.get(name, {}).items())),
        }
    warnings = [] if baseline is not None else ["no baseline: the lower bound is zero, and reported derivatives are not added"]
    warnings += ["candidates without parameters have no price and are counted apart",
        "the bounds tell how sure the evidence is; they are no confidence interval"]
    return {"plan": plan, "selections": selections, "baseline_available": baseline is not None, "warnings": warnings}


def sampling_report(summary: dict) -> str:
    plan = summary["plan"]
    out = ["# Market estimate from a stratified sample\n",
        f"- Candidates: {plan['base_candidates']}; with a bulk card: {plan['parquet_covered_candidates']}; in the manifest: {plan['manifest_entries']}; texts to fetch: {plan['targeted_readme_requests']}\n"]
    for name, item in sorted(summary["selections"].items()):
        out.append(f"## {name}\n")
        out += [f"- {label}: **${item[key]:.2f}**" for label, key in (("Confirmed baseline", "confirmed_baseline_usd"),
            ("Reported derivatives", "reported_derivative_usd"), ("Market, lower", "market_lower_usd"), ("Market, central",
            "market_central_usd"), ("Market, upper", "market_upper_usd"))]
        out.append(f"- Sampled: {item['sample']}; cards: {item['cards_available']}; without parameters: {item['uncostable_unknown_parameters']}\n")
        rows = [(s.replace("|", "\\|"), v["population"], v["sample"], v["cards_available"], f"{v['central_weighted']:.2f}",
            f"{v['central_cost']:.2f}") for s, v in item["strata"].items()]
        out.append(O._table(("Stratum", "Population", "Sample", "Cards", "Independent (weighted)", "USD"), rows))
    out += [f"- {w}" for w in summary["warnings"]]
    return "\n".join(out) + "\n"


def publish_sampling(path: str, candidates: DataFrame, chosen: DataFrame, s: Sampling, found: DataFrame | None = None,
    baseline: DataFrame | None = None) -> dict:
    """The manifest and its plan; with results also those, the summary and the report."""
    spark, plan = candidates.sparkSession, sampling_plan(candidates, chosen, s)
    tables, texts = {"sampling-manifest": O.manifest_table(chosen)}, {"sampling-plan-summary.json": json.dumps(plan, indent=2) + "\n"}
    if found is not None:
        summary = sampling_summary(plan, found, baseline)
        tables["sampling-results"] = O.result_table(found)
        texts |= {"sampling-summary.json": json.dumps(summary, indent=2) + "\n", "sampling-report.md": sampling_report(summary)}
    return publish(spark, path, tables, texts)
