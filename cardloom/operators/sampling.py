"""Census plus stratified sample with known inclusion, results of the sample, and weighted totals.

Edge cases. Null parameters count as unknown and are never census; equal repository ids in a stratum order by id; an empty
table has no manifest; a census that needs more cards than may be fetched is an error of manifest(), not of whole_manifest().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import costing as K
from .reviews import canonical_run_column
from .selection import Catalog, Sampling
from .taxonomy import size_bucket

SPREAD = 64  # a stratum is first ranked in so many parts
WHOLE = 2.0**53  # doubles from here on have no fraction


def sampling_hash(seed: int, repo_id: str = "repo_id") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}").cast("binary"), F.unhex(F.lit("00")), F.col(repo_id).cast("binary")), 256)


def stratified(candidates: DataFrame, s: Sampling) -> DataFrame:
    """Adds census and stratum. Needs selection, params, bucket, covered."""
    large = F.coalesce((F.col("params") > 0) & (F.col("params") / 1e9 >= s.census_min_parameters_b), F.lit(False))
    census = large & F.when(F.col("covered"), s.include_covered_census).otherwise(s.include_missing_census)
    rows = candidates.withColumn("census", census)
    group = F.when(F.col("census"), "census>=threshold").otherwise(F.col("bucket"))
    return rows.withColumn("stratum", F.concat_ws("|", "selection", group, F.when(F.col("covered"), "parquet").otherwise("missing")))


def whole_manifest(candidates: DataFrame, s: Sampling) -> DataFrame:
    """Every census candidate and up to sample_per_stratum others of each stratum, with weights, however many cards it needs: for
    cards that have landed."""
    return _weighted_rows(_drawn(candidates, s))


def manifest(candidates: DataFrame, s: Sampling) -> DataFrame:
    """The whole manifest, for a run that fetches missing cards: when more are wanted than max_targeted_readmes, the missing rows
    outside the census are cut to what is left, in hashed order, and their strata's weights grow."""
    return _weighted_rows(_within_capacity(_drawn(candidates, s), s))


def _drawn(candidates: DataFrame, s: Sampling) -> DataFrame:
    """The census and the samples, with the population of each stratum. Census rows are neither ranked nor shuffled; the others are
    ranked in SPREAD parts of a stratum, and only each part's first rows meet."""
    rows = written(stratified(candidates, s), "stratified")
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("population"))  # selections x buckets x 2
    others = rows.where(~F.col("census")).withColumn("_h", sampling_hash(s.seed)).withColumn("_part", F.pmod(F.xxhash64("repo_id"),
        F.lit(SPREAD)))
    for group in (Window.partitionBy("stratum", "_part"), Window.partitionBy("stratum")):
        others = others.withColumn("_r", F.row_number().over(group.orderBy("_h", "repo_id"))).where(F.col("_r") <= s.sample_per_stratum)
    return rows.where("census").unionByName(others.drop("_h", "_part", "_r")).join(F.broadcast(sizes), "stratum")


def _weighted_rows(rows: DataFrame) -> DataFrame:
    """Adds sample, weight, inclusion and card_source. A census is whole, so its sample is its population."""
    census = rows.where("census").withColumn("sample", F.col("population"))
    others = rows.where(~F.col("census")).withColumn("sample", F.count(F.lit(1)).over(Window.partitionBy("stratum")))
    weight = F.when(F.col("census"), 1.0).otherwise(F.col("population") / F.col("sample"))
    return census.unionByName(others).withColumn("weight", weight).withColumns({"inclusion": 1 / F.col("weight"),
        "card_source": F.when(F.col("covered"), "parquet").otherwise("targeted_readme")})


def _within_capacity(rows: DataFrame, s: Sampling) -> DataFrame:
    missing = rows.where(~F.col("covered"))
    large = F.coalesce((F.col("params") > 0) & (F.col("params") / 1e9 >= s.census_min_parameters_b), F.lit(False))
    wanted, in_census = missing.agg(F.count(F.lit(1)), F.count(F.when(F.col("census"), 1))).first()
    if in_census > s.max_targeted_readmes:
        raise ValueError(f"the census alone needs {in_census} cards, over max_targeted_readmes={s.max_targeted_readmes}")
    if wanted <= s.max_targeted_readmes:
        return rows
    left = missing.where(~large).orderBy(sampling_hash(s.seed + 1), "selection", "repo_id").limit(s.max_targeted_readmes - in_census)
    return rows.where(F.col("covered") | large).unionByName(left)


def plan(candidates: DataFrame, chosen: DataFrame, s: Sampling) -> DataFrame:
    """Counters by selection: candidates, covered, manifest, census and cards to fetch."""
    count = lambda c: F.count(F.when(c, 1))
    of = candidates.groupBy("selection").agg(F.count(F.lit(1)).alias("candidates"), count(F.col("covered")).alias("covered"))
    own = chosen.groupBy("selection").agg(F.count(F.lit(1)).alias("manifest"), count(F.col("census")).alias("census"),
        count(~F.col("covered")).alias("targeted"))
    return of.join(own, "selection", "left").na.fill(0, ["manifest", "census", "targeted"])


def results(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """Which manifest rows are independent in the lower, central and upper sense, and their weighted costs.

    Needs the manifest with scope, card_available, review, and the settled, usable claim with deterministic. The first profile
    of a selection prices; parameters may come from the review where the hub states none.
    """
    profiles = {p.name: p for p in catalog.compute_profiles}
    told = F.col("review.parameter_count_b")
    from_review = (F.coalesce("params", F.lit(0)) <= 0) & F.coalesce(told > 0, F.lit(False))
    rows = rows.withColumns({"params": F.when(from_review, F.floor(told * 1e9)).otherwise(F.coalesce("params", F.lit(0))).cast("long"),
        "parameter_source": F.when(F.coalesce("params", F.lit(0)) > 0, "hub_safetensors").when(from_review,
        "local_llm_verbatim_model_card").otherwise("unknown")})
    rows = rows.withColumn("bucket", size_bucket("params"))
    claim, review = F.col("claim"), F.col("review")
    here = F.col("card_available")
    lower = here & F.col("deterministic") & F.coalesce(claim["evidence_type"] != "declared_base_model", F.lit(False))
    own = F.coalesce((review["kind"] == "independent_base") & review["independently_pretrained"], F.lit(False)) & claim.isNotNull() & here
    rows = rows.withColumns({"lower": lower, "central": lower | own & (review["confidence"] == "high"),
        "upper": lower | own & review["confidence"].isin("high", "medium")})
    cost = F.lit(None).cast("double")
    for s in catalog.selections:
        if s.compute_profiles:
            p = profiles[s.compute_profiles[0]]
            formula = K.pictures if s.target_diffusion_only else lambda n, a, t, p: K.evidence(n, a, t, p)
            args = (F.col("params"), claim["active_parameters_b"]) + (() if s.target_diffusion_only else (claim["training_tokens_t"],))
            cost = F.when(F.col("selection") == s.name, K.cost(K.gpu_hours(formula(*args, p)[0], p), p)).otherwise(cost)
    error = F.when(~here, "model card unavailable after targeted fetch").when((F.col("params") <= 0) & F.col("upper"),
        "independent base candidate has no parameter count; excluded from cost estimate")
    return rows.withColumns({"raw_cost": F.when(here & (F.col("params") > 0), cost), "error": error,
        "duplicate_of": F.lit(None).cast("string")})


def without_duplicates(found: DataFrame) -> DataFrame:
    """Of results whose reviews name one run with equal parameters the first counts: census first, then the least weight."""
    run = canonical_run_column(F.col("review.canonical_training_run"))
    ok = F.col("upper") & (F.coalesce(F.col("review.canonical_training_run"), F.lit("")) != "") & (F.col("params") > 0)
    keyed = found.withColumn("_run", F.when(F.coalesce(ok, F.lit(False)), run))
    rank = F.struct((~F.col("census")).alias("c"), "weight", "repo_id")
    groups = keyed.where("_run IS NOT NULL").groupBy(F.col("selection").alias("_s"), F.col("_run").alias("_r"),
        F.col("params").alias("_p")).agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = keyed.join(groups, (F.col("selection") == F.col("_s")) & (F.col("_run") == F.col("_r")) & (F.col("params") == F.col("_p")),
        "left")
    lost = F.coalesce(F.col("_first.repo_id") != F.col("repo_id"), F.lit(False))
    changes = {c: F.col(c) & ~lost for c in ("lower", "central", "upper")}
    return out.withColumns(changes | {"duplicate_of": F.when(lost, F.col("_first.repo_id"))}).select(*found.columns)


def _sum(value: Column) -> Column:
    """A sum whose cents don't hang on the order of the rows: whole parts add without loss below 2^53, and the rests are small."""
    whole = F.rint(value)
    return F.sum(whole) + F.sum(F.when(F.abs(whole) < WHOLE, value - whole).otherwise(0.0))


def _weighted(flag: str, value: Column) -> Column:
    return _sum(F.when(F.col(flag), F.col("weight") * value).otherwise(0.0))


def strata(found: DataFrame, *by: str) -> DataFrame:
    """Horvitz-Thompson totals by stratum (or other columns)."""
    raw = F.coalesce("raw_cost", F.lit(0.0))
    out = [F.count(F.lit(1)).alias("sample"), F.count(F.when(F.col("card_available"), 1)).alias("cards_available"),
        F.count(F.when(F.col("params") <= 0, 1)).alias("unknown_parameters")]
    for flag in ("lower", "central", "upper"):
        out += [_weighted(flag, F.lit(1.0)).alias(f"{flag}_weighted"), _weighted(flag, raw).alias(f"{flag}_cost")]
    return found.groupBy(*(by or ("selection", "stratum"))).agg(*out)


def market(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """By selection: lower is the confirmed baseline, central and upper the estimated bases plus reported derivatives, and none
    is under the one before. baseline bears selection, confirmed and derivatives; a missing one counts as 0."""
    rows = strata(found, "selection").join(baseline.select("selection", "confirmed", "derivatives"), "selection", "left").na.fill(0.0,
        ["confirmed", "derivatives"])
    central = F.greatest(F.col("central_cost") + F.col("derivatives"), F.col("confirmed"))
    return rows.withColumns({"market_lower": F.col("confirmed"), "market_central": central,
        "market_upper": F.greatest(F.col("upper_cost") + F.col("derivatives"), central)})


def weighted_totals(rows: DataFrame, *by: str) -> DataFrame:
    """Horvitz-Thompson totals of cost."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.round(_sum(F.col("weight")), 6).alias("estimated_rows"),
        F.round(_sum(F.col("cost") * F.col("weight")), 2).alias("estimated_cost"))
