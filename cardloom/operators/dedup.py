"""De-duplication of costed runs: in each group of records the first in order keeps its cost; the others keep their row.

A pass finds the winner of each group with a map-side minimum and joins it back, so no group is sorted in one task; passes
run over a narrow ledger of the costed records only, written between them, as each sees what the ones before took away.

Edge cases. Records without a cost, and those whose key has an empty part that must not be empty, take no part; nulls in a key
are equal; ties end at the record's place (by selection, then by the selection's own order); an empty table stays empty; every column that isn't a cost is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import written
from . import taxonomy as X
from .ordinal import numbered, record_order
from .reviews import canonical_run_column
from .selection import Selection

LEDGER = ("selection", "ordinal", "place", "repo_id", "owner", "kind", "base_model", "params", "created_at", "likes", "downloads", "cost",
    "upper", "method", "run_hash", "evidence_hash", "claim_run", "claim_card", "review")
MONEY = ("cost", "lower", "upper")


@dataclass(frozen=True)
class Pass:
    method: str
    said: str  # error text, before the winner's repository
    eligible: Column
    keys: list[Column]
    order: list[Column]  # least first, all orderable together
    some: Column | None = None  # must hold for one record of the group at least


def _down(name: str) -> Column:
    return -F.coalesce(name, F.lit(0))


def _age() -> list[Column]:
    return [F.coalesce(F.col("created_at").cast("string"), F.lit("")), _down("likes"), _down("downloads")]


def _fame() -> list[Column]:
    return [_down("likes"), _down("downloads"), F.coalesce(F.col("created_at").cast("string"), F.lit(""))]


def _name() -> Column:
    """All after the first slash, lower case."""
    return F.regexp_extract(F.lower("repo_id"), "(?s)/(.*)", 1)


def _either(a: str, b: str) -> Column:
    return F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))


def base_cost() -> Column:
    return F.coalesce(F.col("method").startswith("formula_txt_") | F.col("method").startswith("reported_pretraining_tokens_"),
        F.lit(False)) & F.col("cost").isNotNull()


def reported_run() -> Pass:
    """Copies of one disclosed run: the oldest stays."""
    ok = F.col("method").isin("gpu_hours_x_hourly_rate", "reported_total_cost") & F.col("cost").isNotNull() & _either("run_hash",
        "evidence_hash").isNotNull()
    return Pass("duplicate_reported_training_run", "cost counted once under canonical repository ", ok, [_either("run_hash",
        "evidence_hash")], _age())


def reported_trajectory() -> Pass:
    """Snapshots of one name, one of them dated at least: the largest cost stays, then the newest."""
    told = _either("run_hash", "evidence_hash").isNotNull() | F.col("method").isin("gpu_hours_x_hourly_rate", "reported_total_cost")
    ok = F.col("kind").isin("finetune", "adapter") & told & F.col("cost").isNotNull() & F.col("repo_id").contains("/")
    keys = [F.lower("owner"), F.col("kind"), F.coalesce(F.lower("base_model"), F.lit("")), F.regexp_replace(_name(),
        P.java(P.DATE_SUFFIX), ""), F.col("params")]
    return Pass("duplicate_reported_training_trajectory", "reported trajectory cost counted once under cumulative repository ", ok, keys,
        [-F.col("cost"), -F.unix_micros(F.col("created_at").cast("timestamp"))], _name().rlike(P.java(P.DATE_SUFFIX)))


def scratch_run() -> Pass:
    """Copies of one claim with equal parameters: the oldest stays."""
    return Pass("duplicate_scratch_training_run", "scratch cost counted once under canonical repository ",
        base_cost() & _either("claim_run", "claim_card").isNotNull(), [_either("claim_run", "claim_card"), F.col("params")], _age())


def checkpoint_trajectory() -> Pass:
    """Checkpoints of one owner's name; a name without a checkpoint suffix takes no part."""
    keys = [F.lower("owner"), F.regexp_replace(_name(), P.java(P.CHECKPOINT_NAME), ""), F.col("params")]
    return Pass("duplicate_scratch_training_trajectory", "scratch trajectory cost counted once under canonical repository ",
        base_cost() & F.col("repo_id").contains("/") & _name().rlike(P.java(P.CHECKPOINT_NAME)), keys, _age())


def family_mirror() -> Pass:
    """Mirrors by the whole canonical name: the most liked stays."""
    ok = base_cost() & (F.octet_length(X.family()) >= 6) & ~X.family().isin("model", "base-model")
    return Pass("duplicate_base_family_mirror", "base-family cost counted once under canonical repository ", ok, [X.family(),
        F.col("params")], _fame())


def reviewed_run() -> Pass:
    """Runs that reviews call by one name: sure reviews first, then the most liked."""
    run = canonical_run_column(F.col("review.canonical_training_run"))
    ok = (F.col("review.kind") == "independent_base") & F.col("review.confidence").isin("high",
        "medium") & F.col("upper").isNotNull() & (F.octet_length(run) >= 6) & (run != "unknown")
    return Pass("duplicate_local_llm_training_run", "local-LLM canonical run counted once under ", ok, [run, F.col("params")],
        [(F.col("review.confidence") != "high").cast("int"), *_fame()])


PASSES = (reported_run, reported_trajectory, scratch_run, checkpoint_trajectory, family_mirror, reviewed_run)


def _taken(ledger: DataFrame, lost: Column, method: str, said: str, winner: str) -> DataFrame:
    changes = {c: F.when(~lost, F.col(c)) for c in ("cost", "upper")}
    changes |= {"method": F.when(lost, method).otherwise(F.col("method")), "said": F.when(lost, F.concat("said",
        F.array(F.concat(F.lit(said), winner)))).otherwise(F.col("said"))}
    return ledger.withColumns(changes)


def run_pass(ledger: DataFrame, p: Pass) -> DataFrame:
    names = [f"_k{i}" for i in range(len(p.keys) + 1)]
    keyed = ledger.withColumns(dict(zip(names, [F.col("selection"), *p.keys], strict=True)) | {"_in": F.coalesce(p.eligible, F.lit(False))})
    keyed = keyed.withColumns({n: F.when(F.col("_in"), F.col(n)) for n in names})
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(p.order)], F.col("place").alias("last"), "repo_id")
    groups = keyed.where("_in").groupBy(*[F.col(n).alias(f"{n}_") for n in names]).agg(F.min(rank).alias("_first"),
        F.count(F.lit(1)).alias("_n"), F.max(F.lit(True) if p.some is None else F.coalesce(p.some, F.lit(False))).alias("_some"))
    groups = groups.where((F.col("_n") > 1) & F.col("_some"))
    same = F.col("_in")
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"{n}_"))
    out = keyed.join(groups, same, "left")
    lost = F.coalesce(F.col("_first.last") != F.col("place"), F.lit(False))
    return _taken(out, lost, p.method, p.said, F.col("_first.repo_id")).select(*ledger.columns)


def derivative_of_base(ledger: DataFrame) -> DataFrame:
    """Derivatives whose disclosed run is a base record's: the last such base record names it."""
    bases = ledger.where((F.col("kind") == "base") & F.col("cost").isNotNull() & (F.col("run_hash") != ""))
    runs = bases.groupBy(F.col("selection").alias("_s"), F.col("run_hash").alias("_run")).agg(F.max_by("repo_id", "place").alias("_base"))
    mine = F.col("kind").isin("finetune",
        "adapter") & F.col("cost").isNotNull() & (F.col("selection") == F.col("_s")) & (F.col("run_hash") == F.col("_run"))
    out = ledger.join(runs, mine, "left")
    return _taken(out, F.col("_base").isNotNull(), "duplicate_reported_base_training_run",
        "reported compute belongs to canonical base repository ", F.col("_base")).select(*ledger.columns)


def ledger(records: DataFrame, selections: tuple[Selection, ...]) -> DataFrame:
    """The narrow table that passes run over: costed records with their place in record order."""
    columns = [c for c in LEDGER if c != "place"]
    rows = records.where("cost IS NOT NULL OR upper IS NOT NULL").select(*columns, F.array().cast("array<string>").alias("said"))
    return numbered(rows, record_order(selections))


def _applied(records: DataFrame, ledger: DataFrame) -> DataFrame:
    told = ledger.where(F.size("said") > 0).select(F.col("selection").alias("_s"), F.col("ordinal").alias("_o"),
        F.col("method").alias("_m"), "said")
    out = records.join(told, (F.col("selection") == F.col("_s")) & (F.col("ordinal") == F.col("_o")), "left")
    lost = F.col("_m").isNotNull()
    changes = {c: F.when(~lost, F.col(c)) for c in (*MONEY, "compute") if c in records.columns}
    changes["method"] = F.coalesce("_m", "method")
    if "tier" in records.columns:
        changes["tier"] = F.when(F.col("_m") == "duplicate_local_llm_training_run", "duplicate").otherwise(F.col("tier"))
    if "errors" in records.columns:
        changes["errors"] = F.concat("errors", F.coalesce("said", F.array().cast("array<string>")))
    return out.withColumns(changes).drop("_s", "_o", "_m", "said")


def apply_pass(records: DataFrame, make, selections: tuple[Selection, ...]) -> DataFrame:
    """One pass alone."""
    records = written(records, "records")
    return _applied(records, run_pass(ledger(records, selections), make()))


def chained(records: DataFrame, selections: tuple[Selection, ...]) -> DataFrame:
    """All passes in their order, each after what the ones before took away. Records are written once, as they are read twice."""
    records = written(records, "records")
    rows = written(derivative_of_base(written(ledger(records, selections), "ledger")), "ledger")
    for make in PASSES:
        rows = written(run_pass(rows, make()), "ledger")
    return _applied(records, rows)
