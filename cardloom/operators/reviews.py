"""Reviewed labels: reading and validating a reviewer's answers, and settling them with what cards say.

`parsed` takes the answers as text (JSON somewhere in prose) beside the card; `latest` reads a cache of JSON lines whose later
lines win; `settled` decides which claim a record keeps.

Edge cases. An answer without a valid object gives null; unknown kinds and confidences are invalid; malformed cache lines and
lines without a key are skipped; a blank or absent card is `unknown` / `low`; repeated keys keep the last line.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import card_patterns as C
from ..functions import patterns as P
from ..session import ship
from .card_signals import CLAIM, _arrow, active_parameters, collapse, sha256, trained_tokens

#: Kinds and confidences of a review.
KINDS = ("independent_base", "continued_pretraining", "finetune", "adapter", "fork_or_mirror", "quantized", "merge", "non_text", "unknown")
CONFIDENCES = ("high", "medium", "low")
REVIEW = "struct<kind:string,confidence:string,independently_pretrained:boolean,parameter_count_b:double,parameter_evidence:string,upstream_model:string,canonical_training_run:string,training_years:array<long>,evidence:string,reason:string>"
_TEXTS = ("kind", "confidence", "parameter_evidence", "upstream_model", "canonical_training_run", "evidence", "reason")


def canonical_run(value: str) -> str:
    """Lower case; each run of other characters than a-z, 0-9 and / is one dash; no dashes or slashes at the ends."""
    return re.sub("[^a-z0-9/]+", "-", value.strip().lower()).strip("-/")


def canonical_run_column(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9/]+", "-"), F.lit("-/"))


def _within(card: str, quote: str) -> bool:
    return collapse(quote).lower() in collapse(card).lower()


def valid(answer: dict, card: str) -> dict | None:
    """The review with its unsupported parts taken out, or None. Evidence must stand in the card, word for word."""
    if not isinstance(answer, dict) or any(not isinstance(answer.get(k) or "", str) for k in _TEXTS):
        return None
    out = {k: (answer.get(k) or "").strip() for k in _TEXTS}
    out |= {"kind": out["kind"].lower(), "confidence": out["confidence"].lower(),
        "canonical_training_run": canonical_run(out["canonical_training_run"])}
    out["reason"] = answer.get("reason") or ""
    if out["kind"] not in KINDS or out["confidence"] not in CONFIDENCES:
        return None
    own = answer.get("independently_pretrained") is True and out["kind"] == "independent_base"
    if out["kind"] == "independent_base" and not own:
        out |= {"kind": "unknown", "confidence": "low"}
    if out["confidence"] != "low" and not (out["evidence"] and _within(card, out["evidence"])):
        return None
    size = answer.get("parameter_count_b") or 0
    if not isinstance(size, int | float) or isinstance(size, bool):
        return None
    if size < 0 or size > 0 and not (out["parameter_evidence"] and _within(card, out["parameter_evidence"])):
        size, out["parameter_evidence"] = 0, ""
    years = sorted({int(y) for y in re.findall(P.compiled(C.YEAR), out["evidence"])})
    return out | {"independently_pretrained": own, "parameter_count_b": float(size), "training_years": years}


def found(answer: str, card: str) -> dict | None:
    """The first valid review in a text: an object at any opening brace."""
    read = json.JSONDecoder()
    for m in re.finditer(r"\{", answer):
        try:
            value, _ = read.raw_decode(answer, m.start())
        except ValueError:
            continue
        if (review := valid(value, card)) is not None:
            return review
    return None


def parsed(answers: DataFrame) -> DataFrame:
    """repo_id and review (null if none is valid) from repo_id, card and answer."""
    ship(answers.sparkSession)

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("answer").to_pylist(), batch.column("card").to_pylist(), strict=True)
            got = [found(a or "", c or "") for a, c in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("repo_id"), pa.array([g and {n: g[n] for n, *_ in _fields()} for g in got],
                pa.struct(_fields()))], ["repo_id", "review"])

    return answers.select("repo_id", "card", "answer").mapInArrow(run, f"repo_id string, review {REVIEW}")


def _fields() -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return [(n, kinds[k]) for n, k in (f.split(":") for f in REVIEW[7:-1].split(","))]


def latest(spark: SparkSession, path: str) -> DataFrame:
    """key and review of a cache of JSON lines; the last line of a key wins, by file, block and line, however the files are split:
    lines of one block are numbered in one task."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    entry = F.from_json("value", f"key string, review {REVIEW}")
    rows = lines.withColumn("entry", entry).where(F.coalesce(F.col("entry.key"), F.lit("")) != "")
    return rows.groupBy(F.col("entry.key").alias("key")).agg(F.max_by("entry.review", F.struct("file", "block", "at")).alias("review"))


def without_card(reason: str = "model is absent from bulk model-card snapshot") -> Column:
    """The review of a repository whose card is blank or absent."""
    values = {"kind": "unknown", "confidence": "low", "reason": reason}
    return F.from_json(F.lit(json.dumps(values)), REVIEW)


def of_all(wanted: DataFrame, cards: DataFrame, reviews: DataFrame) -> DataFrame:
    """repo_id and review of every wanted repository: its review, or that of a blank or absent card. cards bear modelId and card."""
    there = cards.groupBy(F.col("modelId").alias("repo_id")).agg(F.max(F.trim(F.coalesce("card", F.lit(""))) != "").alias("_told"))
    rows = wanted.select("repo_id").distinct().join(there, "repo_id", "left").join(reviews.select("repo_id", "review"), "repo_id", "left")
    missing = F.when(F.col("_told").isNull(), without_card()).when(~F.col("_told"), without_card("model card is empty"))
    return rows.select("repo_id", F.coalesce(missing, "review").alias("review"))


def reviewed_kind(review: Column) -> Column:
    """The kind that a high-confidence review stands for, else null."""
    known = F.create_map(*[F.lit(x) for pair in P.REVIEW_KINDS.items() for x in pair])
    return F.when(review["confidence"] == "high", F.try_element_at(known, review["kind"]))


def _independent(review: Column) -> Column:
    return F.coalesce((review["kind"] == "independent_base") & review["independently_pretrained"] & review["confidence"].isin("high",
        "medium"), F.lit(False))


def claims_of_reviews(rows: DataFrame) -> DataFrame:
    """Adds review_claim: what an independent high or medium review claims, with tokens and active parameters read from its
    evidence. Needs repo_id and review; only such rows go through Python."""
    ship(rows.sparkSession)
    some = rows.where(_independent(F.col("review"))).select("repo_id", "review")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.column("review").to_pylist():
                evidence = collapse(r["evidence"] or "")
                run_of = r["canonical_training_run"] or evidence
                out.append({
                    "source": "review", "evidence_type": f"local_llm_{r['confidence']}", "evidence": evidence, "card_hash": "",
                        "run_hash": sha256(run_of), "claimed_trainer": "",
                    "training_years": r["training_years"] or [], "active_parameters_b": active_parameters(evidence),
                        "training_tokens_t": trained_tokens(evidence),
                })
            yield pa.RecordBatch.from_arrays([batch.column("repo_id"), pa.array(out, _arrow(CLAIM))], ["repo_id", "review_claim"])

    return rows.join(some.mapInArrow(run, f"repo_id string, review_claim {CLAIM}"), "repo_id", "left")


def settled(rows: DataFrame, enabled: bool) -> DataFrame:
    """claim and deterministic from the card's claim, the review and review_claim. With reviews on, a claim by name alone gives
    way to the review's, which keeps the card's numbers and years; a sure review of another kind ends any claim; without a
    claim the review's stands."""
    claim, review, other = F.col("claim"), F.col("review"), F.col("review_claim")
    weak = F.lit(enabled) & F.coalesce(claim["evidence_type"] == "declared_base_model", F.lit(False))
    years = F.when(F.size(claim["training_years"]) > 0, claim["training_years"]).otherwise(other["training_years"])
    kept = F.when(other.isNotNull(), other.withField("active_parameters_b", claim["active_parameters_b"]).withField("training_tokens_t",
        claim["training_tokens_t"]).withField("training_years", years))
    own = F.when(weak, kept).otherwise(claim)
    ended = F.coalesce(reviewed_kind(review) != "base", F.lit(False))
    return rows.withColumns({"claim": F.when(~ended, F.coalesce(own, other)), "deterministic": claim.isNotNull() & ~weak})
