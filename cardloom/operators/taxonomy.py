"""Kinds, domains, files and metadata rules of repositories, as columns."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P

#: Upper ends of parameter ranges in billions, and the ranges' names.
BUCKETS = ((2, "<2B"), (7, "2-<7B"), (13, "7-<13B"), (34, "13-<34B"), (70, "34-<70B"), (120, "70-<120B"), (500, "120-<500B"))
CARD_BASE_KEYS = ("base_model", "baseModel", "base_models")


def lowered(tags: str = "tags") -> Column:
    return F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), F.lower)


def has_any(tags: Column, wanted) -> Column:
    return F.exists(tags, lambda t: F.coalesce(t.isin(*wanted), F.lit(False)))


def card_value(key: str, card: str = "card_data") -> Column:
    """A top-level value of the card's structured metadata (JSON text), as JSON text; null if absent or not an object."""
    return F.to_json(F.try_variant_get(F.try_parse_json(card), f"$.{key}", "variant"))


def non_empty(value: Column) -> Column:
    """A JSON value that is neither null, a blank text, nor an empty list or object; any other scalar counts."""
    return F.coalesce(~value.isin("null", "[]", "{}") & ~value.rlike(r'^"(?:\s|\\[nrtf])*"$'), F.lit(False))


def card_declares_base() -> Column:
    return reduce(or_, [non_empty(card_value(k)) for k in CARD_BASE_KEYS])


def kind() -> Column:
    """First rule that holds: known lineage, relation, quantization, merge, trainer, adapter, declared base, fork, fine-tune
    name, base."""
    tags, repo = lowered(), F.col("repo_id")
    relation, library = F.lower(F.coalesce("relation", F.lit(""))), F.lower(F.coalesce("library_name", F.lit("")))
    named = lambda *ps: reduce(or_, [P.matches(repo, p) for p in ps])
    prefixed = lambda s: F.exists(tags, lambda t: F.coalesce(t.startswith(s), F.lit(False)))
    known = F.create_map(*[F.lit(x) for pair in P.KIND_OVERRIDES.items() for x in pair])
    return (
        F.when(repo.isin(*P.KIND_OVERRIDES), F.try_element_at(known, repo))
        .when(relation.isin("quantized", "merge"), relation)
        .when(has_any(tags, P.QUANT_TAGS) | library.isin(*P.QUANT_LIBRARIES) | named(P.QUANT_NAME, P.CONVERT_NAME, P.EMBEDDED_SOURCE_NAME,
            P.HF_CONVERSION_NAME), "quantized")
        .when(has_any(tags, P.MERGE_TAGS) | named(P.MERGE_NAME), "merge")
        .when(relation.isin("adapter", "finetune"), relation)
        .when(has_any(tags, P.TRAINER_TAGS), "finetune")
        .when(has_any(tags, P.ADAPTER_TAGS) | prefixed("base_model:adapter:") | named(P.ADAPTER_NAME), "adapter")
        .when(prefixed("base_model:") | F.col("base_model").isNotNull() | card_declares_base(), "finetune")
        .when(named(P.FORK_NAME, P.CHECKPOINT_NAME, P.UUID_NAME, P.AFFINE_NAME), "fork")
        .when(named(P.FINETUNE_NAME), "finetune")
        .otherwise("base")
    )


def _joined() -> Column:
    return F.lower(F.concat_ws(" ", F.col("repo_id"), F.array_join("tags", " ")))


def is_text_model() -> Column:
    pipeline = F.lower(F.coalesce("pipeline_tag", F.lit("")))
    return ~P.matches(pipeline, P.NON_TEXT_PIPELINE) & ~P.matches(_joined(),
        P.NON_TEXT) & (pipeline.isin(*P.TEXT_PIPELINES) | P.matches(_joined(), P.LLM_SIGNAL))


def is_diffusion_model() -> Column:
    pipeline = F.lower(F.coalesce("pipeline_tag", F.lit("")))
    return (
        F.when(pipeline.isin(*P.IMAGE_PIPELINES), True)
        .when(pipeline.isin(*P.OTHER_PIPELINES), False)
        .otherwise(~P.matches(_joined(), P.DIFFUSION_EXCLUDED) & P.matches(_joined(), P.DIFFUSION_TARGET))
    )


def has_weights(files: str = "files") -> Column:
    """A file by whose name it holds weights."""
    return F.exists(F.coalesce(files, F.array().cast("array<string>")), lambda f: F.coalesce(P.matches(f, P.WEIGHT_FILE) & ~P.matches(f,
        P.NON_WEIGHT_FILE), F.lit(False)))


def retained(files: str = "files", params: str = "params") -> Column:
    """The weight gate: a stated total of parameters, or a weight file."""
    return (F.coalesce(params, F.lit(0)) > 0) | has_weights(files)


def _all_tags() -> Column:
    """Lower-cased tags of the repository and of its card's metadata (a list or one text)."""
    own = F.try_variant_get(F.try_parse_json("card_data"), "$.tags", "array<string>")
    one = F.try_variant_get(F.try_parse_json("card_data"), "$.tags", "string")
    more = F.coalesce(own, F.when(card_value("tags").startswith('"'), F.array(one)), F.array().cast("array<string>"))
    return F.concat(lowered(), F.transform(more, F.lower))


def metadata_reason() -> Column:
    """Why metadata alone excludes a repository from the scratch count; null if its card must be read."""
    tags = F.filter(_all_tags(), lambda t: t.isin(*P.DERIVATIVE_TAGS))
    adapter, conversion = lambda f: P.matches(f, P.ADAPTER_FILE), lambda f: P.matches(f, P.CONVERSION_FILE)
    telling = F.filter(F.coalesce("files", F.array().cast("array<string>")), lambda f: adapter(f) | conversion(f))
    return (
        F.when(~has_weights(), "no_recognized_full_weight_file")
        .when(card_declares_base() | F.col("base_model").isNotNull(), "declares_base_model")
        .when(F.size(tags) > 0, "derivative_tag")
        .when(P.matches(F.element_at(F.split("repo_id", "/"), -1), P.DERIVATIVE_NAME), "derivative_name")
        .when(F.size(telling) > 0, F.when(adapter(F.try_element_at(telling, F.lit(1))), "adapter_files").otherwise("conversion_files"))
    )


def metadata_evidence(reason: Column) -> Column:
    """What a reason rests on, or an empty text. Give the reason as a column of a projection before, so that it is found once."""
    values = [card_value(k) for k in CARD_BASE_KEYS]
    stated = F.coalesce(*[F.when(non_empty(v), F.when(v.startswith('"'), F.try_variant_get(F.try_parse_json("card_data"), f"$.{k}",
        "string")).otherwise(v)) for k, v in zip(CARD_BASE_KEYS, values, strict=True)], F.col("base_model"))
    tags = F.array_sort(F.array_distinct(F.filter(_all_tags(), lambda t: t.isin(*P.DERIVATIVE_TAGS))))
    return F.when(reason == "declares_base_model", F.substring(stated, 1, 300)).when(reason == "derivative_tag", F.array_join(tags,
        ", ")).when(reason == "derivative_name", F.col("repo_id")).otherwise("")


def size_bucket(params: str = "params") -> Column:
    out = F.when(F.col(params).isNull() | (F.col(params) <= 0), "unknown")
    for top, name in BUCKETS:
        out = out.when(F.col(params) < top * 1_000_000_000, name)
    return out.otherwise(">=500B")


def owner() -> Column:
    """The author, else what stands before the first slash, else empty."""
    return F.coalesce(F.nullif(F.col("author"), F.lit("")), F.when(F.col("repo_id").contains("/"), F.split("repo_id", "/")[0]), F.lit(""))


def family(repo_id: Column | None = None) -> Column:
    """Name without owner, serialization suffix and separators' differences."""
    repo_id = F.col("repo_id") if repo_id is None else repo_id
    name = F.regexp_replace(F.lower(F.element_at(F.split(repo_id, "/"), -1)), P.java(P.BASE_SUFFIX), "")
    return F.trim(F.translate(name, "_.", "--"), F.lit("-"))


def checkpoint_family() -> Column:
    return F.regexp_replace(F.lower("repo_id"), P.java(P.CHECKPOINT_NAME), "")


def any_needle(text: str, needles) -> Column:
    """One of the needles occurs, in any case: the text is lowered and gone through once."""
    return F.lower(text).rlike("|".join(re.escape(n) for n in needles))


def may_report_compute(card: str = "card") -> Column:
    return any_needle(card, P.COMPUTE_NEEDLES) | (F.lower(card).contains("training") & F.col(card).contains("$"))


def may_claim_scratch(card: str = "card") -> Column:
    return any_needle(card, P.SCRATCH_NEEDLES)
