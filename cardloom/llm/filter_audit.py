"""Filter interaction audit by lattice-edge aggregation.

Every document fails some of n filters: its mask. Under an order of the filters a document walks the lattice of subsets, and what
a step does to it depends only on the edge (filters applied already, next filter), of which five filters have 80. So documents are
added up by (part, mask), each of the at most 32 sums goes to the 80 edges, and the edges are joined to the steps of all orders
(600), which are paths through the lattice: no order is ever run over the documents. A filter's Shapley total weighs each edge by
the number of orders that pass through it.

Copies are found by the SHA-256 of the text: the least doc_id of each digest is a grouped minimum, combined before the shuffle,
and comes back by a join on (digest, doc_id), so the copies of one text spread over all tasks. The texts are read once; what
follows works on a written table of narrow facts.

Edge cases. A null text counts as the empty one, which fails A only (and E beside other empty texts); a null doc_id is smaller than
none and has no smaller one, so it neither fails E nor makes others fail it; rows that repeat a doc_id and its text count one by
one and don't fail E for each other; a doc_id with several labels is good or toxic if one of them says so; a null source is part
''; an empty table gives no parts; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

BLANKS = "[ \\t-\\r]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails A: few words, B: few distinct words, C: many capitals, D: marks."""
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def document_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: rows of each part by the filters A to E that they fail (bit 0 is A)."""
    raw = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(source, F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(text_filters(F.col("text")).values())), F.lit(0))
    facts = durable(raw.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")))
    first = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    copy = facts.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left").select(
        # a null id meets no label, so its rows spread by their digests
        F.coalesce(F.col("doc_id").cast("string"), F.hex("digest")).alias("id"),
        "part",
        (F.col("mask") + F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)).alias("mask"),
    )
    rows = copy.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    says = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    labelled = rows.join(says, "id", "left")
    return labelled.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def lattice_edges(masks: DataFrame, filters: int) -> DataFrame:
    """What each edge (applied, next) of the lattice does in each part, and the Shapley total of its filter."""
    everything = range(1 << filters)
    edges = [(s, f) for s in everything for f in range(filters) if not s >> f & 1]
    paths = {s: factorial(s.bit_count()) * factorial(filters - 1 - s.bit_count()) for s in everything if s + 1 < 1 << filters}
    edge = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(1 << f).alias("bit"), F.lit(paths[s]).cast("long").alias("orders")) for s, f in edges])
    at = masks.select("*", F.inline(edge))
    bit = F.col("bit")
    here = F.col("mask").bitwiseAND(F.col("applied")) == 0
    fails = F.col("mask").bitwiseAND(bit) != 0
    add = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    summed = at.groupBy("part", "applied", "next", "orders").agg(
        add(here & ~fails).alias("kept"),
        add(here & fails).alias("removed"),
        add(~here & fails).alias("redundant"),
        add(F.col("mask") == bit).alias("unique_fails"),
        add(here & fails, "good").alias("good_lost"),
        add(here & fails, "toxic").alias("toxic_lost"),
    )
    return summed.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "next"))).drop("orders")


def order_steps(spark: SparkSession, letters: str) -> DataFrame:
    """Each step of each order as an edge: n! * n rows."""
    rows = []
    for order in permutations(range(len(letters))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(letters[i] for i in order), step, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    edges = lattice_edges(document_masks(docs, labels), 5)
    steps = F.broadcast(order_steps(docs.sparkSession, "ABCDE"))  # 600 rows
    return edges.join(steps, ["applied", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op11_lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
facts AS (
  SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS tox
  FROM words LEFT JOIN labels USING (doc_id)),
cells AS (
  SELECT part, [a, b, c, d, e] AS f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE tox) AS tox
  FROM facts GROUP BY 1, 2),
l(x) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (
  SELECT [p.x, q.x, r.x, s.x, u.x] AS o FROM l p, l q, l r, l s, l u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
steps AS (SELECT o, x AS step, o[x] AS now, o[1:x - 1] AS before FROM orders, l),
walked AS (
  SELECT part, o, step, now, n, good, tox, f[now] AS fails, len(list_filter(before, lambda y: f[y])) > 0 AS gone,
         len(list_filter(f, lambda y: y)) AS n_fails
  FROM cells, steps),
found AS (
  SELECT part, o, step, now, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails AND n_fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS good_lost,
         coalesce(sum(tox) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM walked GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda y: chr((64 + y)::INTEGER)), '') AS filter_order, step, kept, removed, redundant,
       unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, now))::BIGINT AS shapley
FROM found
"""
