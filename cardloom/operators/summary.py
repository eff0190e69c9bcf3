"""Summaries of records by selection and by owner.

Edge cases. A selection without records has a row of zeros when the catalog is given; null costs count as no cost; an owner
without a name is the empty name; maps hold only keys that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import costing as K
from .selection import Catalog, limited
from .taxonomy import size_bucket

#: The keyed maps: name -> (key column, rows that count, sum instead of count).
MAPS = {
    "owner_types": ("owner_type", "true", False), "model_kinds": ("kind", "true", False),
    "costed_models_by_kind": ("kind", "cost IS NOT NULL", False), "training_cost_by_kind": ("kind", "cost IS NOT NULL", True),
    "costed_models_by_method": ("method", "cost IS NOT NULL", False), "training_cost_by_method": ("method", "cost IS NOT NULL", True),
    "base_models_by_size": ("bucket", "kind = 'base'", False), "costed_base_by_size": ("bucket", "kind = 'base' AND cost IS NOT NULL",
        False), "base_cost_by_size": ("bucket", "kind = 'base' AND cost IS NOT NULL", True),
}


def literal_cost() -> Column:
    return F.try_element_at(F.filter("compute", lambda e: e["method"] == K.LITERAL), F.lit(1))["cost_usd"]


def sensitivity(scope: Column) -> tuple[Column, Column]:
    """(hybrid, literal) cost of a record with 20 tokens a parameter: derivatives as they are, bases by the literal estimate, in
    the hybrid by the share of active parameters; nothing for diffusion."""
    literal, b = F.coalesce(literal_cost(), F.lit(0.0)), F.col("params") / 1e9
    active = F.col("claim.active_parameters_b")
    share = F.when((active > 0) & (active < b), active / b).otherwise(1.0)
    counted = F.col("cost").isNotNull() & (scope != "diffusion")
    base = F.col("kind") == "base"
    return tuple(F.when(counted, F.when(base, literal * part).otherwise(F.col("cost"))).otherwise(0.0) for part in (share, F.lit(1.0)))


def keyed(records: DataFrame) -> DataFrame:
    """One row for each selection, map and key with its count and sum, from one pass: each record gives its entries."""
    rows = records.withColumn("bucket", size_bucket("params"))
    entries = F.array_compact(F.array(*[F.when(F.expr(when), F.struct(F.lit(name).alias("name"), F.coalesce(F.col(key),
        F.lit("")).alias("key"), F.lit(summed).alias("summed"))) for name, (key, when, summed) in MAPS.items()]))
    each = rows.select("selection", "cost", F.explode(entries).alias("e")).select("selection", "e.name", "e.key", "e.summed", "cost")
    return each.groupBy("selection", "name", "key", "summed").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("usd"))


def selections(records: DataFrame, catalog: Catalog) -> DataFrame:
    """A row for each selection of the catalog: counts, sums, and the keyed maps."""
    spark = records.sparkSession
    scope = F.lit("all")
    for s in catalog.selections:
        scope = F.when(F.col("selection") == s.name, s.scope).otherwise(scope)
    hybrid, literal = sensitivity(scope)
    count = lambda c: F.count(F.when(c, 1))
    totals = records.groupBy("selection").agg(
        F.count(F.lit(1)).alias("models"), F.count_distinct(F.coalesce("owner", F.lit(""))).alias("unique_owners"),
            F.sum("downloads").alias("total_downloads"), F.sum("likes").alias("total_likes"),
            count(F.col("params") > 0).alias("known_parameters"),
        count(F.col("lower").isNotNull()).alias("lower_costed_models"), F.sum("lower").alias("lower_training_cost_usd"),
            count(F.col("cost").isNotNull()).alias("known_training_costs"), F.sum("cost").alias("total_training_cost_usd"),
        count(F.col("upper").isNotNull()).alias("upper_costed_models"), F.sum("upper").alias("upper_training_cost_usd"),
            F.sum(hybrid).alias("formula20_hybrid_usd"), F.sum(literal).alias("formula20_literal_usd"),
        count(F.col("review").isNotNull()).alias("reviewed"),
            *[count(F.col("review.confidence") == c).alias(f"reviewed_{c}") for c in ("high", "medium")],
            count(F.col("review").isNotNull() & ~F.coalesce(F.col("review.confidence").isin("high", "medium"),
            F.lit(False))).alias("reviewed_low"),
    )
    entries = keyed(records).where(~F.col("summed")).groupBy("selection",
        "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("m"))
    sums = keyed(records).where("summed").groupBy("selection", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key",
        "usd")))).alias("m"))
    pick = lambda df, names: df.groupBy("selection").agg(*[F.first(F.when(F.col("name") == n, F.col("m")),
        ignorenulls=True).alias(n) for n in names])
    out = spark.createDataFrame([(s.name, s.description, s.scope) for s in catalog.selections],
        "selection string, description string, market_scope string")
    out = out.join(totals, "selection", "left").join(pick(entries, [n for n, m in MAPS.items() if not m[2]]), "selection",
        "left").join(pick(sums, [n for n, m in MAPS.items() if m[2]]), "selection", "left")
    return out.na.fill(0).select("*")


def funnel(rows: DataFrame) -> DataFrame:
    """By selection, before any card is read: repositories, base ones with and without parameters, and the map of kinds."""
    each = rows.groupBy("selection", "kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("params") > 0, 1)).alias("known"))
    of_bases = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "base", c)), F.lit(0))
    return each.groupBy("selection").agg(
        F.sum("n").alias("repositories"), of_bases(F.col("n")).alias("bases"), of_bases(F.col("known")).alias("with_parameters"),
            of_bases(F.col("n") - F.col("known")).alias("without_parameters"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"),
    )


def with_owner_types(records: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds owner_type, full_name: organizations first, then users, else unknown."""
    rank = F.when(F.col("owner_type") == "organization", 0).otherwise(1)
    one = owners.groupBy("owner").agg(F.min_by(F.struct("owner_type", "full_name"), rank).alias("_o"))
    return records.join(one, "owner", "left").withColumns({"owner_type": F.coalesce("_o.owner_type", F.lit("unknown")),
        "full_name": F.col("_o.full_name")}).drop("_o")


def of_allowed_owners(records: DataFrame, catalog: Catalog) -> DataFrame:
    """Selections by owner type keep those types only; limits that waited for them are applied."""
    keep = F.lit(True)
    for s in catalog.selections:
        if s.owner_types:
            keep &= (F.col("selection") != s.name) | F.col("owner_type").isin(*[t.lower() for t in s.owner_types])
    return limited(records.where(keep), *[s for s in catalog.selections if s.owner_types], after_owners=True)


def owners(records: DataFrame) -> DataFrame:
    """Owners' distinct repositories, downloads, likes and costs (by the first record of each repository), and the sorted
    distinct selections of all their records."""
    own = records.withColumn("owner", F.coalesce("owner", F.lit("")))
    first = own.groupBy("owner", "repo_id").agg(F.min_by(F.struct("downloads", "likes", "cost"), "selection_order").alias("r"),
        F.collect_set("selection").alias("s"))
    return first.groupBy("owner").agg(
        F.count(F.lit(1)).alias("selected_repos"), F.sum("r.downloads").alias("downloads"), F.sum("r.likes").alias("likes"),
            F.count("r.cost").alias("known_training_costs"), F.sum("r.cost").alias("training_cost_usd"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("selections"),
    )


def in_record_order(records: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds selection_order: records follow each other by selection, and a repository comes once in each."""
    number = F.lit(len(catalog.selections))
    for i, s in enumerate(catalog.selections):
        number = F.when(F.col("selection") == s.name, i).otherwise(number)
    return records.withColumn("selection_order", number)


def top_owners(found: DataFrame, n: int = 100) -> DataFrame:
    return found.orderBy(F.desc(F.coalesce("training_cost_usd", F.lit(0.0))), "owner").limit(n)
