"""Manifests whose census needs more cards than a run may fetch."""

import dataclasses
import math

import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from cardloom.operators import sampling as SA
from cardloom.operators.selection import Sampling
from cardloom.plans import record_queries as RQ

LANDED = ("m14_w8_sampling_manifest", "a12_sampling_plan", "m15_w7_sampling_results", "a9_a10_weighted_totals", "a11_j10_market")


@pytest.mark.parametrize("name", LANDED)
def test_queries_of_landed_cards_fetch_none(name, spark, duck, monkeypatch):
    """A limit on fetched cards, here none at all, leaves out no row of a query that fetches nothing."""
    monkeypatch.setattr(RQ, "SAMPLING", dataclasses.replace(RQ.SAMPLING, max_targeted_readmes=0))
    assert rows_of(RQ.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(RQ.ORACLES[name]).fetchdf())


def test_census_over_the_limit(spark):
    rows = [("s", f"o/m{i}", None if i % 3 else 40_000_000_000, "unknown", i % 2 == 0) for i in range(60)]
    candidates = spark.createDataFrame(rows, "selection string, repo_id string, params long, bucket string, covered boolean")
    s = Sampling(sample_per_stratum=4, max_targeted_readmes=9)
    with pytest.raises(ValueError, match="the census alone needs 10 cards"):
        SA.manifest(candidates, s)
    whole = SA.whole_manifest(candidates, s)
    assert {(r["stratum"], r["population"], r["sample"], r["weight"], r["count"]) for r in whole.groupBy("stratum", "population", "sample",
        "weight").count().collect()} == {("s|census>=threshold|missing", 10, 10, 1.0, 10), ("s|census>=threshold|parquet", 10, 10, 1.0, 10),
        ("s|unknown|missing", 20, 4, 5.0, 4), ("s|unknown|parquet", 20, 4, 5.0, 4)}
    some = SA.manifest(candidates, dataclasses.replace(s, max_targeted_readmes=11))
    assert [(r["sample"], r["weight"]) for r in some.where("stratum = 's|unknown|missing'").collect()] == [(1, 20.0)]
    assert SA.whole_manifest(candidates.limit(0), s).count() == 0


def _costed(spark):
    """Results of two strata whose costs, a few values again and again, add up to some 1e13, and the costs by stratum."""
    costs = [483_911_223.0 + i % 6 / 7 for i in range(40_000)]
    rows = [(i % 2, c) for i, c in enumerate(costs)]
    found = spark.createDataFrame(rows, "stratum int, raw_cost double").withColumns({"selection": F.lit("s"), "card_available": F.lit(True),
        "params": F.lit(1), "weight": F.lit(1.25), "lower": F.lit(False), "central": F.lit(True), "upper": F.lit(True)})
    return found, [[1.25 * c for c in costs[i::2]] for i in range(2)]


@pytest.mark.parametrize("parts", [1, 7])
def test_totals_by_stratum_to_the_cent(parts, spark):
    """the cents of large totals are those of the exact sum, however the rows are split."""
    found, costs = _costed(spark)
    got = {r["stratum"]: r for r in SA.strata(found.repartition(parts)).collect()}
    for i in range(2):
        assert round(got[i]["central_cost"], 2) == round(got[i]["upper_cost"], 2) == round(math.fsum(costs[i]), 2)
        assert (got[i]["lower_cost"], got[i]["central_weighted"]) == (0.0, 25_000.0)


def test_totals_without_cents(spark):
    """Nulls are left out, and what is too large for cents or no number stays what a sum makes of it."""
    rows = [("null", None, 1.0), ("some", None, 1.0), ("some", 0.5, 3.0), ("large", 1e300, 2.0), ("large", 2.0**60, 1.0),
        ("inf", float("inf"), 1.0), ("inf", 1.5, 1.0), ("nan", float("nan"), 1.0)]
    frame = spark.createDataFrame(rows, "k string, cost double, weight double")
    got = {r["k"]: r["estimated_cost"] for r in SA.weighted_totals(frame, "k").collect()}
    assert math.isnan(got.pop("nan")) and got == {"null": None, "some": 1.5, "large": 2e300, "inf": math.inf}


def test_market_to_the_cent(spark):
    """so are the totals of a selection, with its baseline or without."""
    found, costs = _costed(spark)
    total = math.fsum(costs[0] + costs[1])
    for name, confirmed, added in (("s", 5e9, 10.5), ("other", 0.0, 0.0)):
        baseline = spark.createDataFrame([(name, 5e9, 10.5)], "selection string, confirmed double, derivatives double")
        row = SA.market(found, baseline).first()
        assert row["market_lower"] == confirmed
        assert round(row["market_central"], 2) == round(row["market_upper"], 2) == round(total + added, 2)
