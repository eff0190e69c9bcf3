"""Declarative selections: one Column from a configuration; conjuncts that aren't set are left out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import taxonomy as X
from .costing import Profile

#: Names that a configuration may use.
KINDS = ("base", "fork", "finetune", "adapter", "quantized", "merge")
OWNER_TYPES = ("user", "organization", "unknown")
SORTS = {"downloads": "downloads", "likes": "likes", "created_at": "created_at", "parameters": "params", "repo_id": "repo_id"}
LOOKBACK_DAYS = 365
INSTANT = timedelta(microseconds=1)


@dataclass(frozen=True)
class Selection:
    """Fields bear the names of the configuration files."""

    name: str
    description: str = ""
    lookback_days: int = 0
    created_from: str = ""
    created_to: str = ""
    pipeline_tags: tuple = ()
    libraries: tuple = ()
    model_kinds: tuple = ()
    target_llm_only: bool = False
    target_diffusion_only: bool = False
    owner_types: tuple = ()
    tags_any: tuple = ()
    tags_all: tuple = ()
    exclude_tags: tuple = ()
    model_id_regex: str = ""
    min_parameters_b: float | None = None
    max_parameters_b: float | None = None
    include_unknown_parameters: bool = False
    min_downloads: int = 0
    max_downloads: int = 0
    min_likes: int = 0
    max_likes: int = 0
    sort_by: str = "downloads"
    sort_direction: str = "desc"
    limit: int = 0
    compute_profiles: tuple = ()
    require_reported_derivative_compute: bool = False
    require_reported_compute: bool = False
    require_explicit_scratch_for_base: bool = False
    formula_requires_explicit_scratch: bool = False
    count_reported_derivative_costs: bool = False
    declared_base_min_likes: int = 0
    declared_base_min_downloads: int = 0

    @property
    def scope(self) -> str:
        return "text_llm" if self.target_llm_only else "diffusion" if self.target_diffusion_only else "all"

    @property
    def needs_scratch(self) -> bool:
        return self.require_explicit_scratch_for_base or self.formula_requires_explicit_scratch

    def window(self, now: datetime | None = None) -> tuple[datetime | None, datetime | None]:
        """[from, before): a day of created_to, and the instant of now, count to their ends; without created_from the last
        lookback_days before the end; no bounds where neither they nor now are given."""
        end = before(self.created_to) if self.created_to else now and now + INSTANT
        start = moment(self.created_from) if self.created_from else None
        if start is None and end is not None and (self.lookback_days or now is not None):
            start = (end if self.created_to else now) - timedelta(days=self.lookback_days or LOOKBACK_DAYS)
        return start, end

    def check(self, profiles: set[str] = frozenset()) -> None:
        def bad(what: str):
            raise ValueError(f"selection {self.name!r}: {what}")

        if not self.name:
            bad("every selection needs a name")
        if self.target_llm_only and self.target_diffusion_only:
            bad("cannot enable both target_llm_only and target_diffusion_only")
        if self.sort_by not in SORTS or self.sort_direction not in ("asc", "desc"):
            bad("unsupported sort_by or sort_direction")
        numbers = (self.lookback_days, self.limit, self.min_downloads, self.max_downloads, self.min_likes, self.max_likes,
            self.min_parameters_b or 0, self.max_parameters_b or 0)
        if min(numbers) < 0:
            bad("bounds cannot be negative")
        for least, most in ((self.min_downloads, self.max_downloads), (self.min_likes, self.max_likes), (self.min_parameters_b,
            self.max_parameters_b)):
            if most and (least or 0) > most or most == 0 and least and isinstance(most, float):
                bad("a least bound exceeds the largest")
        for own, known, what in ((self.model_kinds, KINDS, "model kind"), (self.owner_types, OWNER_TYPES, "owner type"),
            (self.compute_profiles, profiles, "compute profile")):
            if unknown := set(own) - set(known):
                bad(f"unsupported {what} {sorted(unknown)}")
        start, end = self.window()
        if start and end and start >= end:
            bad("created_from is after created_to")

    @classmethod
    def from_dict(cls, data: dict) -> Selection:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in _known(cls, data).items()})

    @classmethod
    def from_json(cls, text: str) -> Selection:
        """Strict: unknown keys and trailing text are errors."""
        return cls.from_dict(json.loads(text))


def _known(cls, data: dict) -> dict:
    if unknown := set(data) - {f.name for f in fields(cls)}:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return data


@dataclass(frozen=True)
class Sampling:
    enabled: bool = False
    seed: int = 2025
    census_min_parameters_b: float = 34.0
    sample_per_stratum: int = 150
    max_targeted_readmes: int = 3000
    readme_workers: int = 1
    request_interval_ms: int = 0
    readme_cache_dir: str = "cache/targeted-readmes"
    manifest_file: str = "sampling-manifest.json"
    results_file: str = "sampling-results.json"
    summary_file: str = "sampling-summary.json"
    report_file: str = "sampling-report.md"
    baseline_summary_file: str = ""
    include_covered_census: bool = True
    include_missing_census: bool = True


@dataclass(frozen=True)
class Catalog:
    """A whole configuration file. Settings of services and logs are kept as they are."""

    endpoint: str = ""
    output_dir: str = "catalog-results"
    scan: dict = field(default_factory=dict)
    logging: dict = field(default_factory=dict)
    owners: dict = field(default_factory=dict)
    local_llm: dict = field(default_factory=dict)
    sampling: Sampling = field(default_factory=Sampling)
    compute_profiles: tuple = ()
    selections: tuple = ()

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        """Strict: unknown keys, trailing text, repeated names and invalid settings are errors."""
        data = dict(_known(cls, json.loads(text)))
        data["compute_profiles"] = tuple(Profile(**_known(Profile, p)) for p in data.get("compute_profiles") or ())
        data["selections"] = tuple(Selection.from_dict({k: v for k, v in s.items() if v is not None}) for s in data.get("selections") or ())
        data["sampling"] = Sampling(**{k: v for k, v in _known(Sampling, data.get("sampling") or {}).items() if v is not None})
        out = cls(**data)
        names = [p.name for p in out.compute_profiles]
        if len(set(names)) < len(names) or len({s.name for s in out.selections}) < len(out.selections):
            raise ValueError("names must be unique")
        if not out.selections:
            raise ValueError("config must contain at least one selection")
        for p in out.compute_profiles:
            p.check()
        for s in out.selections:
            s.check(set(names))
        return out

    @property
    def reviews(self) -> bool:
        return bool(self.local_llm.get("enabled"))

    @property
    def review_scope(self) -> str:
        return self.local_llm.get("scope") or "text_llm"

    def clock(self) -> datetime:
        """The instant that a run takes as now, in UTC: scan.now, else the time of the call. Read it once for a run."""
        told = self.scan.get("now")
        return moment(told) if told else datetime.now(UTC).replace(tzinfo=None)


def moment(text: str) -> datetime:
    """YYYY-MM-DD or RFC 3339, in UTC without a zone."""
    if len(text) != 10 and ("T" not in text or text[-1] != "Z" and text[-6:-5] not in ("+", "-")):
        raise ValueError(f"invalid date {text!r}: use YYYY-MM-DD or RFC 3339")
    got = datetime.fromisoformat(text)
    return got.astimezone(UTC).replace(tzinfo=None) if got.tzinfo else got


def before(text: str) -> datetime:
    """The first instant after an inclusive end: the next day's start, or a microsecond on."""
    return moment(text) + (timedelta(days=1) if len(text) == 10 else INSTANT)


def condition(s: Selection, now: datetime | None = None) -> Column:
    """Needs repo_id, created_at, pipeline_tag, library_name, tags, kind, params, downloads, likes; uses is_text and is_picture."""
    tags = X.lowered()
    low = lambda xs: [x.lower() for x in xs]
    start, end = s.window(now)
    if now is not None and end > now + INSTANT:  # a model of the future belongs to no run
        end = now + INSTANT
    parts = [F.col("created_at").isNotNull()] if start or end else []
    if start:
        parts.append(F.col("created_at") >= F.lit(start))
    if end:
        parts.append(F.col("created_at") < F.lit(end))
    for column, wanted in (("pipeline_tag", s.pipeline_tags), ("library_name", s.libraries), ("kind", s.model_kinds)):
        if wanted:
            parts.append(F.lower(column).isin(*low(wanted)))
    if s.target_llm_only:
        parts.append(F.col("is_text"))
    if s.target_diffusion_only:
        parts.append(F.col("is_picture"))
    if s.tags_any:
        parts.append(X.has_any(tags, low(s.tags_any)))
    if s.tags_all:
        parts.append(F.size(F.array_except(F.array(*map(F.lit, low(s.tags_all))), tags)) == 0)
    if s.exclude_tags:
        parts.append(~X.has_any(tags, low(s.exclude_tags)))
    if s.model_id_regex:
        parts.append(X.P.matches(F.col("repo_id"), s.model_id_regex))
    for column, least, most in (("downloads", s.min_downloads, s.max_downloads), ("likes", s.min_likes, s.max_likes)):
        if least:
            parts.append(F.col(column) >= least)
        if most:
            parts.append(F.col(column) <= most)
    if s.min_parameters_b is not None or s.max_parameters_b is not None:
        b = F.col("params") / 1e9
        known = F.lit(True)
        if s.min_parameters_b is not None:
            known &= b >= s.min_parameters_b
        if s.max_parameters_b is not None:
            known &= b <= s.max_parameters_b
        parts.append(F.when(F.coalesce("params", F.lit(0)) <= 0, F.lit(s.include_unknown_parameters)).otherwise(known))
    return F.coalesce(reduce(and_, parts, F.lit(True)), F.lit(False))


def matched(models: DataFrame, *selections: Selection, now: datetime | None = None) -> DataFrame:
    """A row for each selection that a model belongs to, from one scan: the domains are computed once in a projection, and
    the names of all selections that hold are exploded."""
    domains = models.withColumns({"is_text": X.is_text_model(), "is_picture": X.is_diffusion_model()})
    names = F.array_compact(F.array(*[F.when(condition(s, now), F.lit(s.name)) for s in selections]))
    return domains.withColumn("selection", F.explode(names))


def order(s: Selection) -> list[Column]:
    key = F.col(SORTS[s.sort_by])
    return [key.asc() if s.sort_direction == "asc" else key.desc(), F.col("repo_id").asc()]


def limited(rows: DataFrame, *selections: Selection, after_owners: bool = False) -> DataFrame:
    """The first `limit` rows of each selection that has one, by distributed top-k; other rows pass untouched. Limits of
    selections by owner type wait until owners are known."""
    now = [s for s in selections if s.limit and (after_owners or not s.owner_types)]
    if not now:
        return rows
    out = rows.where(~F.col("selection").isin(*[s.name for s in now]))
    for s in now:
        out = out.unionByName(rows.where(F.col("selection") == s.name).orderBy(*order(s)).limit(s.limit))
    return out


def select(models: DataFrame, *selections: Selection, now: datetime | None = None) -> DataFrame:
    """Matching rows of each selection, limits applied."""
    return limited(matched(models, *selections, now=now), *selections, after_owners=True)
