"""Costed records: what each selection keeps of a model, its resolved kind, its estimates and its cost.

Input rows are matched models (a row for each selection) with `reported` (compute), `claim`, `deterministic` and `review`; compute
and claim bear `earliest`, the first card with their fingerprint, which a review's claim has not. A row's selection picks its settings
from one small map, so the table is read once and each rule stands once, whatever the number of selections and profiles.

Edge cases. Null parameters count as 0 and price nothing; an estimate that is no finite number is an error text; a model
without signals has null structs; a selection without profiles prices nothing.
"""

from __future__ import annotations

from dataclasses import fields
from datetime import datetime
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import card_patterns as C
from ..functions import patterns as P
from . import costing as K
from . import reviews as R
from .costing import Profile
from .selection import INSTANT, Catalog, Selection, limited, matched

NOT_PROVEN = "repository name says base but model card does not prove independent pretraining"


def _settings(catalog: Catalog, now: datetime | None) -> Column:
    """What the row's selection asks for, as a struct: one small map, so that each rule is one expression whatever the number of
    selections and profiles."""
    profiles = {p.name: p for p in catalog.compute_profiles}

    def of_profile(p: Profile) -> Column:
        return F.struct(*[F.lit(getattr(p, n)).alias(n) for n in (*(f.name for f in fields(Profile)), "prices_pictures")])

    def of(s: Selection) -> Column:
        start, low, high = _window(s, now)
        priced = [of_profile(profiles[n]) for n in s.compute_profiles]
        flags = ("needs_scratch", "require_reported_compute", "require_reported_derivative_compute", "require_explicit_scratch_for_base",
            "count_reported_derivative_costs")
        nothing = F.filter(F.array(of_profile(Profile())), lambda p: F.lit(False))
        return F.struct(
            F.lit(start).cast("timestamp").alias("start"), F.lit(low).alias("low"), F.lit(high).alias("high"), *[F.lit(getattr(s,
                n)).alias(n) for n in flags], (F.array(*priced) if priced else nothing).alias("profiles"), F.lit(s.scope).alias("scope")
        )

    return F.create_map(*[x for s in catalog.selections for x in (F.lit(s.name), of(s))])[F.col("selection")]


def effective_parameters(rows: DataFrame, base_params: DataFrame) -> DataFrame:
    """Adapters count their base model's parameters. Adds params (own ones become own_params) and parameter_error."""
    of_base = base_params.select(F.col("base_id").alias("_base"), F.col("base_params").alias("_found"))
    adapter = F.col("kind") == "adapter"
    joined = rows.withColumnRenamed("params", "own_params").join(of_base, (F.col("base_model") == F.col("_base")) & adapter, "left")
    error = F.when(F.coalesce("base_model", F.lit("")) == "", "adapter has no declared base model").when(F.coalesce("_found",
        F.lit(0)) <= 0, "base model parameter count was not resolved")
    params = F.when(adapter, F.greatest(F.coalesce("_found", F.lit(0)), F.lit(0))).otherwise(F.coalesce("own_params", F.lit(0)))
    return joined.withColumns({"params": params.cast("long"), "parameter_error": F.when(adapter, error)}).drop("_base", "_found")


def resolved_kind(kind: Column, claim: Column, reported: Column, review: Column) -> Column:
    """A sure review, else a base with a claim, else a base whose compute evidence tells of adapters or tuning, else kind."""
    tuned = (kind == "base") & claim.isNull()
    return (
        F.when(R.reviewed_kind(review).isNotNull(), R.reviewed_kind(review))
        .when(tuned & F.coalesce(P.matches(reported["evidence"], C.ADAPTER_EVIDENCE), F.lit(False)), "adapter")
        .when(tuned & F.coalesce(P.matches(reported["evidence"], C.DERIVATIVE_EVIDENCE), F.lit(False)), "finetune")
        .otherwise(kind)
    )


def _window(s: Selection, now: datetime | None) -> tuple[datetime | None, int, int]:
    """Start of a selection, and its first and last year."""
    start, end = s.window(now)
    last = (end - INSTANT).year if end else 9999
    return start, start.year if start else 0, last


def _timely(years: Column, earliest: Column, start: Column, low: Column, high: Column) -> Column:
    told = F.coalesce(F.size(years), F.lit(0)) > 0
    inside = F.exists(years, lambda y: y.between(low, high))
    return F.when(told, inside).otherwise(F.coalesce(F.try_to_timestamp(earliest) >= start, F.lit(True)))


def in_window(years: Column, earliest: Column, s: Selection, now: datetime | None = None) -> Column:
    """Stated years decide; else the earliest card must not be older than the selection's start."""
    start, low, high = _window(s, now)
    return _timely(years, earliest, F.lit(start).cast("timestamp"), F.lit(low), F.lit(high))


def identity(name: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def owner_matches(trainer: Column, owner: Column) -> Column:
    """The claimed trainer names the owner or the other way round; too short names say nothing."""
    a, b = identity(F.coalesce(trainer, F.lit(""))), identity(F.coalesce(owner, F.lit("")))
    return (F.octet_length(a) < 3) | (F.octet_length(b) < 2) | F.contains(b, a) | F.contains(a, b)


def gated(rows: DataFrame, catalog: Catalog, now: datetime | None = None) -> DataFrame:
    """Rows that their selection keeps, with usable claims, the resolved kind (the preliminary one becomes prelim_kind) and the
    selection's settings (_s)."""
    out_of_scope = {"text_llm": "diffusion", "diffusion": "text_llm"}.get(catalog.review_scope) if catalog.reviews else None
    s = F.col("_s")
    rows = rows.withColumn("_s", _settings(catalog,
        now)).where((s["scope"] != F.lit(out_of_scope or "")) & ~((s["scope"] == "text_llm") & F.col("is_picture")))
    timely = lambda c: _timely(F.col(f"{c}.training_years"), F.col(f"{c}.earliest"), s["start"], s["low"], s["high"])
    usable = owner_matches(F.col("claim.claimed_trainer"), F.col("owner")) & timely("claim")
    rows = rows.withColumn("claim", F.when(usable, F.col("claim"))).withColumnRenamed("kind", "prelim_kind")
    rows = rows.withColumn("kind", resolved_kind(F.col("prelim_kind"), F.col("claim"), F.col("reported"), F.col("review")))
    derivative, told = F.col("kind").isin("finetune", "adapter"), F.col("reported").isNotNull()
    asks = s["require_reported_compute"]
    return rows.where(
        (F.col("kind") != "non_text")
        & (~asks | told)
        & (~s["require_reported_derivative_compute"] | ~derivative | told)
        & (~(asks | derivative) | ~told | timely("reported"))
        & (~s["require_explicit_scratch_for_base"] | (F.col("kind") != "base") | F.col("claim").isNotNull())
    )


def _finite(e: Column) -> Column:
    return F.forall(F.array(e["gpu_hours"], e["wall_days"], e["cost_usd"]), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def costed(rows: DataFrame) -> DataFrame:
    """From gated rows: adds compute (estimates), lower, cost and upper, method, tier and errors."""
    params, active, tokens = F.col("params"), F.col("claim.active_parameters_b"), F.col("claim.training_tokens_t")
    base, claim, reported = F.col("kind") == "base", F.col("claim"), F.col("reported")
    by_name = F.coalesce(claim["evidence_type"] == "declared_base_model", F.lit(False)) & F.col("review").isNull()
    nothing = F.array().cast("array<struct<profile:string,gpu_hours:double,wall_days:double,cost_usd:double,method:string>>")
    needs = F.col("_s.needs_scratch")

    def estimates(profile: Column) -> Column:
        """The literal estimate, if it differs, and the one that counts; the flag is true for those that count."""
        p = SimpleNamespace(**{f.name: profile[f.name] for f in fields(Profile)})
        literal = K.estimate(K.literal_flops(params, F.lit("base"), p), K.LITERAL, p)
        flops, method = K.evidence(params, active, tokens, p)
        drawn, told_by = K.pictures(params, active, p)
        pictures = profile["prices_pictures"] & F.col("is_picture")
        total = K.literal_flops(params, F.lit("base"), p)
        best = K.estimate(F.when(pictures, drawn).when(needs, flops).otherwise(total), F.when(pictures, told_by).when(needs,
            method).otherwise(K.LITERAL), p)
        differs = (best["method"] != K.LITERAL) | (F.abs(best["cost_usd"] - literal["cost_usd"]) > 0.005)
        return F.array(F.struct(literal.alias("e"), (_finite(best) & differs).alias("kept"), F.lit(False).alias("counts")),
            F.struct(best.alias("e"), _finite(best).alias("kept"), F.lit(True).alias("counts")))

    derivative = F.col("kind").isin("finetune", "adapter") & reported.isNotNull() & F.col("_s.count_reported_derivative_costs")
    priced = base & (F.size("_s.profiles") > 0) & (params > 0) & ~by_name & (claim.isNotNull() | ~needs)
    rows = rows.withColumn("_all", F.when(priced, F.flatten(F.transform("_s.profiles", estimates))))
    own = F.filter("_all", lambda x: x["counts"])
    first = F.try_element_at(F.filter(own, lambda x: x["kept"]), F.lit(1))["e"]
    medium = F.coalesce(claim["evidence_type"] == "local_llm_medium", F.lit(False)) & ~F.col("deterministic")
    high = F.coalesce(claim["evidence_type"] == "local_llm_high", F.lit(False)) & ~F.col("deterministic")
    price = first["cost_usd"]
    told = F.struct(F.lit("reported_training_time").alias("profile"), reported["gpu_hours"].alias("gpu_hours"),
        (reported["hours"] / 24).alias("wall_days"), reported["cost_usd"].alias("cost_usd"), reported["cost_method"].alias("method"))
    rows = rows.withColumns({
        "compute": F.when(derivative, F.array(told)).otherwise(F.coalesce(F.transform(F.filter("_all", lambda x: x["kept"]),
            lambda x: x["e"]), nothing)),
        "upper": F.when(derivative, reported["cost_usd"]).otherwise(price),
        "cost": F.when(derivative, reported["cost_usd"]).when(~medium, price),
        "lower": F.when(derivative, reported["cost_usd"]).when(~medium & ~high, price),
        "method": F.when(derivative, reported["cost_method"]).otherwise(first["method"]),
        "tier": F.when(derivative, "reported").when(price.isNotNull(), F.when(medium, "llm_medium_upper_only").when(high,
            "llm_high").otherwise("deterministic")),
        "errors": F.array_compact(F.concat(
            F.array(F.col("parameter_error"), F.when(base & by_name & (claim.isNotNull() | ~needs), F.lit(NOT_PROVEN))),
            F.coalesce(F.transform(F.filter(own, lambda x: ~x["kept"]),
                lambda x: F.concat(F.lit("compute estimate overflow for profile "), x["e"]["profile"])), F.array().cast("array<string>")),
        )),
    }).drop("_all", "_s")
    return rows


def build(models: DataFrame, signals: DataFrame, reviews: DataFrame, base_params: DataFrame, catalog: Catalog,
    now: datetime | None = None) -> DataFrame:
    """Records of all selections, before de-duplication, as of `now` (the catalog's clock unless given). models are retained hub
    models with kind and owner; signals bear modelId, compute and claim; reviews bear repo_id and review."""
    now = now or catalog.clock()
    rows = matched(effective_parameters(models, base_params), *catalog.selections, now=now)
    of = signals.select(F.col("modelId").alias("_id"), F.col("compute").alias("reported"), "claim")
    rows = rows.join(of, F.col("repo_id") == F.col("_id"), "left").drop("_id")
    rows = rows.join(R.claims_of_reviews(reviews).withColumnRenamed("repo_id", "_id"), F.col("repo_id") == F.col("_id"), "left").drop("_id")
    rows = R.settled(rows, catalog.reviews).drop("review_claim")
    return limited(costed(gated(rows, catalog, now)), *catalog.selections)
