"""Outputs are written with all their columns, together, and read back."""

import csv
import io
import json

import pytest
from conftest import SF

from cardloom.operators import sampling as SA
from cardloom.operators import selection as S
from cardloom.operators import year_counts as Y
from cardloom.plans import catalog_queries as Q
from cardloom.plans import record_queries as RQ
from cardloom.sinks import outputs as O
from cardloom.sinks import publish as B
from cardloom.sources import hub


@pytest.fixture(scope="module")
def final(spark):
    return RQ.final(spark, SF)


def test_catalog(spark, tmp_path, final):
    path = f"file://{tmp_path}/catalog"
    assert B.current(spark, path) is None
    profiles = hub.owners(spark, SF).selectExpr("*", "true AS verified", "3L AS followers", "'team' AS plan")
    B.publish_catalog(path, final, profiles, RQ.CATALOG, pages_scanned=4)
    models = B.read_table(spark, path, "models")
    assert tuple(models.columns) == O.RECORD_COLUMNS
    got = {(r["selection"], r["repo_id"]): r for r in models.collect()}
    records = {(r["selection"], r["repo_id"]): r for r in final.collect()}
    assert set(got) == set(records)
    for key, r in records.items():
        row = got[key]
        assert row["training_cost_usd"] == ("" if r["cost"] is None else f"{r['cost']:.2f}") and row["errors"] == " | ".join(r["errors"]) and row["model_kind"] == r["kind"]
        assert row["parameters_b"] == (f"{r['params'] / 1e9:.6f}" if r["params"] > 0 else "") and row["tags"] == "|".join(t for t in r["tags"] if t is not None)
        assert [e["cost_usd"] for e in json.loads(row["compute_estimates_json"]) or []] == pytest.approx([e["cost_usd"] for e in r["compute"] or []])
        assert (row["scratch_claim_json"] == "") == (r["claim"] is None)
    owners = B.read_table(spark, path, "owners")
    assert tuple(owners.columns) == O.OWNER_COLUMNS
    rows = owners.collect()
    assert len(rows) == final.select("owner").distinct().count() and sum(int(r["selected_repos"]) for r in rows) == final.select("owner",
        "repo_id").distinct().count()
    known = next(r for r in rows if r["owner_type"] != "unknown")
    assert (known["verified"], known["followers"], known["plan"], known["error"], known["pro"]) == ("true", "3", "team", "", "false")
    assert all(r["error"] == "profile not found" for r in rows if r["owner_type"] == "unknown")
    summary = json.loads(B.read_text(spark, path, "summary.json"))
    assert summary["pages_scanned"] == 4 and summary["effective_now"] == "2002-01-01T00:00:00Z" and set(summary["selections"]) == {s.name for s in RQ.CATALOG.selections}
    assert sum(x["models"] for x in summary["selections"].values()) == len(records)
    assert "## text" in B.read_text(spark, path, "report.md")


def test_runs_replace_each_other_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    one, two = (spark.createDataFrame([(x, 'say "a, b"\nc', [x])], "n int, t string, l array<int>") for x in (1, 2))
    B.publish(spark, path, {"a": one, "b": one}, {"t.txt": "one"})
    bad = two.selectExpr("CAST(raise_error('stop') AS int) AS n", "t", "l")
    with pytest.raises(Exception, match="stop"):
        B.publish(spark, path, {"a": two, "b": bad}, {"t.txt": "two"})
    assert [r["n"] for r in B.read_table(spark, path, "a").collect()] == ["1"] and B.read_text(spark, path, "t.txt") == "one"
    B.publish(spark, path, {"a": two, "b": two.limit(0)}, {"t.txt": "two"})
    assert [tuple(r) for r in B.read_table(spark, path, "a").collect()] == [("2", 'say "a, b"\nc', "[2]")] and B.read_text(spark, path,
        "t.txt") == "two"
    assert B.read_table(spark, path, "b").count() == 0 and B.prune(spark, path) == 2 and B.read_table(spark, path, "a").count() == 1


def test_scan(spark, tmp_path):
    models = RQ.PG.scanned(RQ.landed_pages(spark, SF), [1999, 2000])[0].withColumnRenamed("page", "_page")
    done = Y.classified(models, spark.createDataFrame([], "repo_id string, readme string, error string"))
    path = f"file://{tmp_path}/scan"
    B.publish_scan(path, done, True)
    rows = B.read_table(spark, path, "models")
    assert tuple(rows.columns) == O.YEAR_COLUMNS and rows.count() == done.count()
    summary = json.loads(B.read_text(spark, path, "summary.json"))
    assert summary["complete"] and sum(summary["years"][y].get(k, 0) for y in ("1999", "2000") for k in ("confirmed", "candidate",
        "excluded", "error")) == done.count()
    assert all(sum(v["reasons"].values()) == sum(v.get(k, 0) for k in ("confirmed", "candidate", "excluded",
        "error")) for v in summary["years"].values())


def test_candidates(spark, tmp_path):
    rows, path = Q.selected(spark, SF), f"file://{tmp_path}/pre"
    B.publish_candidates(path, rows)
    summary = {x["selection"]: x for x in json.loads(B.read_text(spark, path, "pre-llm-summary.json"))}
    for name, item in summary.items():
        table = B.read_table(spark, path, item["candidate_csv"].removesuffix(".csv"))
        assert tuple(table.columns) == O.CANDIDATE_COLUMNS and table.count() == item["base_candidates"] == item["base_with_known_parameters"] + item["base_without_parameters"]
        assert item["repositories"] == sum(item["preliminary_kinds"].values()) == rows.where(rows.selection == name).count()


def test_sampling(spark, tmp_path):
    candidates, path = RQ.candidates(spark, SF), f"file://{tmp_path}/sampling"
    plan_only = B.publish_sampling(path, candidates, SA.manifest(candidates, RQ.SAMPLING), RQ.SAMPLING)
    assert list(plan_only["tables"]) == ["sampling-manifest"]
    found = RQ.sampled(spark, SF)
    baseline = spark.createDataFrame([("text", 5e9, 10.5)], "selection string, confirmed double, derivatives double")
    B.publish_sampling(path, candidates, SA.manifest(candidates, RQ.SAMPLING), RQ.SAMPLING, found, baseline)
    manifest, results = B.read_table(spark, path, "sampling-manifest"), B.read_table(spark, path, "sampling-results")
    assert tuple(manifest.columns) == O.MANIFEST_COLUMNS and tuple(results.columns) == O.RESULT_COLUMNS and manifest.count() == results.count() == found.count()
    plan, summary = (json.loads(B.read_text(spark, path, f"sampling-{n}.json")) for n in ("plan-summary", "summary"))
    assert plan["manifest_entries"] == manifest.count() and sum(plan["sample_by_stratum"].values()) == plan["manifest_entries"]
    text = summary["selections"]["text"]
    assert text["market_lower_usd"] == 5e9 and text["market_central_usd"] >= 5e9 and sum(v["sample"] for v in text["strata"].values()) == text["sample"]
    rows = results.collect()
    assert sum(float(r["weighted_central_usd"]) for r in rows if r["selection"] == "text") == pytest.approx(text["estimated_base_central_usd"], rel=1e-6)
    assert "## text" in B.read_text(spark, path, "sampling-report.md") and not summary["warnings"][0].startswith("no baseline")
    assert not B.sampling_summary(plan, found, None)["baseline_available"]


def test_csv_is_read_by_others(spark, tmp_path):
    """Quotes, commas and line ends in values survive for a reader other than Spark."""
    O.write_csv(spark.createDataFrame([('a "b", c\nd', "")], "x string, y string").coalesce(1), f"file://{tmp_path}/t")
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert list(csv.reader(io.StringIO(text))) == [["x", "y"], ['a "b", c\nd', ""]]
