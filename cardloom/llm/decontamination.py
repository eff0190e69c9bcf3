"""Benchmark decontamination by winnowing. Native: SQL functions only.

Words are hashed, every K words in a row give a k-gram hash, and of every W such hashes in a row the least is kept: a
fingerprint. Any span of K + W - 1 = 13 words shared by a document and an item holds the same W k-grams in both, so
both keep the same least one: no shared span of 13 words or more is missed. Fingerprints of all documents are joined
with those of all items; a text with a common fingerprint is a candidate. Hits are then extended: every 13-word
window of a candidate's whole text is joined with the items' windows on 96 bits of hash, and the union of matching
windows is counted. Items of fewer than 13 words are one window each; for every such length that occurs (twelve at
most) all word n-grams of that length are fingerprints, for which winnowing could give no guarantee.

Documents are read twice: once for fingerprints, and again for candidates only. Copies of a text are judged once, under the
text's MD5. The items' side of a join is broadcast only when counted at BROADCAST_ROWS rows at most; beyond that the join is
shuffled, and its skewed partitions are split by adaptive execution, as they hold distinct items' keys on one side.
Arrays are exploded with the outer form: the other one infers a filter on the array that the optimizer pushes below the
projections that made it, evaluating the nested lambdas over again for every element.

Edge cases. A null text has no words; so has a text of punctuation alone, and both have n_hit 0 and are clean; an item
without words has no window; equal item_ids count once; a null item_id counts as "null"; repeated documents give
one row each; with an empty benchmark every document is clean; extra columns are kept by remove_contaminated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh, lookup, small, table, without, written

WINDOW, K = 13, 5
W = WINDOW - K + 1
_CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _CUT), "")


def places(n: Column, length: int) -> Column:
    """0 to n - length, or nothing."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def grams(h: str, n: str, length: int, second: bool = False) -> Column:
    """Hash of every `length` word hashes in a row."""
    of = F.hash if second else F.xxhash64
    return F.transform(places(F.col(n), length), lambda i: of(F.lit(length), *[F.col(h)[i + j] for j in range(length)]))


def least_of(name: str, step: int, count: int) -> Column:
    """At every place the least of `count` elements, `step` apart."""
    span = step * (count - 1) + 1
    return F.transform(places(F.size(name), span), lambda i: F.least(*[F.col(name)[i + step * j] for j in range(count)]))


def hashed(df: DataFrame, text: str) -> DataFrame:
    """Replace the text by its words' hashes h and their number n."""
    return df.withColumn("h", F.transform(words(F.col(text)), lambda w: F.xxhash64(w))).withColumn("n", F.size("h")).drop(text)


def fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """From h and n to fps: winnowed k-gram hashes, and all n-grams of the short items' lengths."""
    assert W == 9  # the least of 9 is the least of three neighbouring least-of-threes
    df = df.withColumn("g", grams("h", "n", K)).withColumn("t", least_of("g", 1, 3)).withColumn("m", least_of("t", 3, 3))
    every = F.array_distinct("m")
    for length in short:
        every = F.concat(every, F.array_distinct(grams("h", "n", length)))
    return df.withColumn("fps", every).drop("g", "t", "m")


def item_windows(items: DataFrame, lengths: list[int]) -> DataFrame:
    """From item, h and n to the windows: length, two hashes, item."""
    out = []
    for length in lengths:
        pair = F.explode_outer(F.arrays_zip(grams("h", "n", length).alias("a"), grams("h", "n", length, True).alias("b")))
        keep = F.col("n") >= WINDOW if length == WINDOW else F.col("n") == length
        out.append(items.where(keep).select("item", pair.alias("w")).select(F.lit(length).alias("len"), F.col("w.a").alias("a"), F.col("w.b").alias("b"), "item").where("a IS NOT NULL"))
    return reduce(DataFrame.unionByName, out).distinct()


def hit_counts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with key and n_words for its text column, key -> n_hit and items for texts with hits)."""
    items = durable(hashed(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text")), "text"))
    short = sorted(r[0] for r in items.where((F.col("n") > 0) & (F.col("n") < WINDOW)).select("n").distinct().collect())
    own = fingerprints(items.where(F.col("n") >= WINDOW), []).select("fps")
    for length in short:
        own = own.union(items.where(F.col("n") == length).select(grams("h", "n", length)))
    item_fps = own.select(F.explode_outer("fps").alias("fp")).where("fp IS NOT NULL").distinct()
    item_fps = durable(item_fps)
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = docs.withColumn("key", key)
    scanned = written(fingerprints(hashed(rows.withColumn("_text", F.col(text)), "_text"), short).drop("h", text).withColumnRenamed("n", "n_words"), "winnowed")
    found = scanned.select("key", F.explode("fps").alias("fp")).join(small(item_fps), "fp", "left_semi").select("key").distinct()
    candidates = durable(found)
    texts = docs.select(F.col(text).alias("text")).withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    texts = texts.join(small(candidates), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = hashed(texts, "text")
    windows = durable(item_windows(items, [*short, WINDOW]))
    spans = None
    for length in [*short, WINDOW]:
        pair = F.posexplode_outer(F.arrays_zip(grams("h", "n", length).alias("a"), grams("h", "n", length, True).alias("b"))).alias("at", "w")
        part = texts.select("key", pair).select("key", "at", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.lit(length).alias("len")).where("a IS NOT NULL")
        spans = part if spans is None else spans.unionByName(part)
    hits = spans.join(small(windows), ["len", "a", "b"]).select("key", (F.col("at") * 16 + F.col("len")).alias("span"), "item")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, span: Column) -> Column:
        start = F.floor(span / 16).cast("int")
        stop = start + F.pmod(span, F.lit(16))
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], start))).alias("n"))

    counted = hits.groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    return scanned.drop("fps"), counted.select("key", F.aggregate("spans", zero, add)["n"].cast("long").alias("n_hit"), "items")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    scanned, hits = hit_counts(docs.select("doc_id", "text"), benchmark)
    rows = scanned.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), "key")
    out = lookup(rows, durable(hits), "key")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text is not contaminated, unchanged."""
    scanned, hits = hit_counts(docs.select("text"), benchmark)
    (key,) = fresh(docs, "key")
    bad = lookup(scanned.select("key", "n_words"), durable(hits), "key").where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("key").alias(key)).distinct()
    own = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return without(docs.withColumn(key, own), durable(bad), key).drop(key)


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS t FROM bl),
lens AS (SELECT DISTINCT l FROM bl),
dp AS (SELECT r, l, unnest(range(1, len(w) - l + 2)) AS p, w FROM d, lens WHERE len(w) >= l),
hit AS (SELECT dp.r, dp.p, dp.l, win.item_id FROM dp JOIN win ON win.l = dp.l AND win.t = array_to_string(dp.w[dp.p:dp.p + dp.l - 1], ' ')),
cov AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov ON cov.r = d.r LEFT JOIN its ON its.r = d.r
"""
