"""Near-duplicate groups by Order MinHash over labelled 5-word shingles, verified by banded alignment.

A text's shingles (SHINGLE words in a row; a text of fewer is one shingle) are labelled with their occurrence number,
so a repeated shingle counts as often as it comes. Each of SKETCHES hash functions picks the PICKS least labelled
shingles and keeps them in the text's own order; two texts agree on a sketch if they pick the same shingles in the same
order, with probability near similarity ** PICKS for texts alike in order. At similarity 0.8 a pair agrees nowhere
with probability (1 - 0.8**4)**24 = 3e-6.

Texts that agree on a sketch form a bucket. Pairs are never emitted all against all: in each bucket, in hashed order, a
text that agrees on AGREE sketches with earlier leaders becomes their candidate, and leads itself if there is none; a
bucket of over PART texts is led in parts, then among the parts' leaders. At 0.8 fewer than AGREE sketches agree with
probability 5e-4. Candidates are verified. Texts of one leader may be alike where the leader is not, so every bucket that
then spans several groups is gone through pair by pair: each pair of different groups that agrees on AGREE sketches is compared. No bucket and no partner is dropped. Such pairs are many only among texts that share a
template without being near copies; their number grows with the square of such a family. A comparison aligns
the two sequences of shingles: matching labelled shingles within the band of shifts that the threshold allows,
longest increasing chain, and similarity = chain / (n + m - chain) >= THRESHOLD. Links are closed to groups by
connected components.

Copies (equal words) are one node under a 128-bit hash of their words before anything is compared. Texts travel once to
each comparison; a text with many partners is sent to chunks of CHUNK partners, so no group fills one task.

Edge cases. A null or empty text, or one without words, equals any other without words (one group, `words` 0); texts of
fewer than 5 words match only on equal words; null and repeated doc_ids are fine: a row's group follows from its text
alone, and its id is the least doc_id of the group (null if all are). keep_one keeps one row of each group, the least by
(doc_id, text); extra columns are kept by it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, chunks, components, drop, durable, fresh, hashed_words, lookup, mix, small, table, written

SHINGLE, PICKS, SKETCHES = 5, 4, 24
THRESHOLD = 0.8
FEW = 16  # texts of so few shingles are candidates on one agreeing sketch
CHUNK = 128
AGREE = 3
PART = 1024
TILE = 256
_U = np.uint64
_SEEDS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0xD1B54A32D192ED03 * (i + 7)) % (1 << 64) | 1 for i in range(SKETCHES)], _U)


def _nodes(words: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits over the words of each text, in order."""
    place = np.arange(len(words)).astype(_U) - np.repeat(first[:-1], np.diff(first)).astype(_U)
    with np.errstate(over="ignore"):
        halves = []
        for seed in (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)):
            run = np.concatenate([np.zeros(1, _U), np.cumsum(mix((words ^ seed) + place * seed))])
            halves.append(mix(run[first[1:]] - run[first[:-1]] + np.diff(first).astype(_U) * seed))
    pair = np.stack(halves, 1).astype(">u8")
    return [p.tobytes() for p in pair]


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingle hashes of all texts in order, and the n+1 bounds."""
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(first[:-1], count) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    with np.errstate(over="ignore"):
        g = np.zeros(len(start), _U)
        for k in range(SHINGLE):
            g = mix(g * _U(0x9E3779B97F4A7C15) + words[start + k])
        row = np.repeat(np.arange(len(n)), count).astype(_U)
        order = np.argsort(g ^ mix(row + _U(1)), kind="stable")
        same = np.zeros(len(g), bool)
        same[1:] = (g[order[1:]] == g[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        at = np.arange(len(g))
        label = np.empty(len(g), _U)
        label[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(_U)
        g = mix(g + label * _U(0xC2B2AE3D27D4EB4F))
    return g, bounds


def order_minhash(g: np.ndarray) -> np.ndarray:
    """One 64-bit value for each sketch: the picked labelled shingles, in text order."""
    with np.errstate(over="ignore"):
        h = g[None, :] * _SEEDS[:, None]
        h ^= h >> _U(32)
        k = min(PICKS, len(g))
        at = np.sort(np.argpartition(h, k - 1, axis=1)[:, :k] if k < len(g) else np.broadcast_to(np.arange(k), (SKETCHES, k)), axis=1)
        out = _SEEDS.copy()
        for j in range(k):
            out = mix(out * _U(0x9E3779B97F4A7C15) + g[at[:, j]])
    return out


def similarity(a: np.ndarray, b: np.ndarray, at_least: float = THRESHOLD) -> float:
    """Of two labelled shingle sequences, by banded alignment; 0 if it can't reach at_least."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < at_least * max(n, m):
        return 0.0
    order = np.argsort(b)
    place = np.minimum(np.searchsorted(b, a, sorter=order), m - 1)
    other = order[place]
    both = b[other] == a
    if both.sum() < at_least * (n + m) / (1 + at_least) - 1e-9:
        return 0.0
    mine, other = np.flatnonzero(both), other[both]
    band = int((n + m) * (1 - at_least) / (1 + at_least)) + 1  # more unmatched shingles than this fail
    near = np.abs(mine - other) <= band
    other = other[near]
    if len(other) < 2 or (other[1:] > other[:-1]).all():
        chain = len(other)
    else:
        tails: list[int] = []
        for x in other.tolist():
            i = bisect_left(tails, x)
            tails[i : i + 1] = [x]
        chain = len(tails)
    s = chain / (n + m - chain)
    return s if s >= at_least - 1e-12 else 0.0


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node, words, sketches (empty for texts of fewer than SHINGLE words)."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                words, first = hashed_words(part.column("text"))
                g, bounds = shingles(words, first)
                sketches = [order_minhash(g[a:b]).view(np.int64) if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)]
                flat = np.concatenate([s for s in sketches if s is not None] or [np.zeros(0, np.int64)])
                edge = np.concatenate([[0], np.cumsum([0 if s is None else SKETCHES for s in sketches])])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(_nodes(words, first), pa.binary()), pa.array(np.diff(first), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat))],
                    ["doc_id", "node", "words", "sketches"],
                )

    return arrow_map(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run,
        "doc_id long, node binary, words long, sketches array<long>")


def _with_nodes(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(*hashed_words(part.column("text"))), pa.binary()), part.column("text")],
                    ["node", "text"])

    return arrow_map(docs.select("text"), run, "node binary, text string")


class Forest:
    """Links thinned to those that join two trees."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: bytes, b: bytes) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())],
        ["center", "node"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (center, node) that join the same texts as those pairs (center, node) whose texts are similar enough."""
    heavy = pairs.groupBy("center").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
    dealt = pairs.join(small(durable(heavy)), "center", "left").select("center", "node", F.coalesce(F.pmod(F.xxhash64("node"),
        F.ceil(F.col("n") / CHUNK)), F.lit(0)).alias("chunk"))
    dealt = durable(dealt)
    members = dealt.join(texts, "node").select("center", "chunk", F.lit(1).alias("side"), "node", "text")
    heads = dealt.select("center", "chunk").distinct().join(texts.withColumnRenamed("node", "center"), "center").select("center", "chunk",
        F.lit(0).alias("side"), F.col("center").alias("node"), "text")
    both = members.unionByName(heads).repartition("center", "chunk").sortWithinPartitions("center", "chunk", "side", "node")

    def run(batches):
        center, chunk, own, first = None, None, np.zeros(0, _U), None
        for batch in batches:
            for part in chunks(batch):
                g, bounds = shingles(*hashed_words(part.column("text")))
                found = []
                for i, (c, k, side, node) in enumerate(zip(*[part.column(n).to_pylist() for n in ("center", "chunk", "side", "node")],
                    strict=True)):
                    mine = g[bounds[i] : bounds[i + 1]]
                    if side == 0:
                        center, chunk, own, first = c, k, mine.copy(), None
                    elif (c, k) == (center, chunk) and similarity(own, mine):
                        found.append((first or c, node))  # members of a chunk hang on its first, so no hub has all of them
                        first = first or node
                yield _links(found)

    return arrow_map(both, run, "center binary, node binary")


def _need(words: np.ndarray) -> np.ndarray:
    return np.where(words - SHINGLE + 1 <= FEW, 1, AGREE)


def _leaders(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Within each group of rows, in the order given by `rank`: pairs (center, node) of a node and every earlier leader
    that it agrees with on AGREE sketches (one, for FEW shingles), and a row without a center for each node that leads, as it
    agrees with none."""
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, "rank", "node")

    def run(batches):
        key, held, least, names = None, np.zeros((64, SKETCHES), np.int64), np.zeros(64, np.int64), []
        for batch in batches:
            values = batch.column("sketches")
            matrix = np.asarray(values.values.slice(values.offset * SKETCHES, len(values) * SKETCHES)).reshape(-1, SKETCHES)
            columns = [batch.column(k).to_pylist() for k in keys]
            nodes = batch.column("node").to_pylist()
            need = _need(np.asarray(batch.column("words")))
            centers, found, where = [], [], []
            for i, (k, node) in enumerate(zip(zip(*columns, strict=True), nodes, strict=True)):
                if k != key:
                    key, names = k, []
                n = len(names)
                hits = np.flatnonzero((held[:n] == matrix[i]).sum(1) >= np.minimum(least[:n], need[i])) if n else ()
                for h in hits:
                    centers.append(names[h])
                    found.append(node)
                    where.append(k[0])
                if not len(hits):
                    if n == len(held):
                        held, least = np.concatenate([held, np.zeros_like(held)]), np.concatenate([least, np.zeros_like(least)])
                    held[n], least[n] = matrix[i], need[i]
                    names.append(node)
                    centers.append(None)
                    found.append(node)
                    where.append(k[0])
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(centers, pa.binary()), pa.array(found, pa.binary())],
                ["bucket", "center", "node"])

    return arrow_map(sorted_rows, run, "bucket long, center binary, node binary")


def _dealt(rows: DataFrame, seed: int) -> DataFrame:
    return rows.withColumns({"rank": F.xxhash64("node", F.lit(0)), "part": F.pmod(F.xxhash64("node", F.lit(seed)),
        F.ceil(F.col("n") / PART))})


def _led(rows: DataFrame) -> DataFrame:
    """Candidate pairs: of leaders in parts of a bucket with their followers, then among the leaders of its parts, in parts again."""
    first = durable(_leaders(_dealt(rows, -1), ["bucket", "part"]))
    large = rows.where(F.col("n") > PART).drop("n").join(first.where("center IS NULL").select("bucket", "node"), ["bucket", "node"],
        "left_semi")
    large = durable(large)
    again = large.join(large.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")
    pairs = first.where("center IS NOT NULL").select("center", "node").union(_leaders(_dealt(again, -2), ["bucket",
        "part"]).where("center IS NOT NULL").select("center", "node"))
    out = durable(pairs.select(F.least("center", "node").alias("center"), F.greatest("center", "node").alias("node")).distinct())
    drop(first, large)
    return out


def _wanted(k: int, a: np.ndarray, b: np.ndarray, matrix: np.ndarray, root: np.ndarray, size: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs of rows a and b have different roots, sizes that allow the threshold, and agree on enough sketches, the
    first of them k."""
    equal = np.zeros((len(a), len(b)), np.int8)
    for s in range(SKETCHES):
        same = matrix[a, s][:, None] == matrix[b, s][None, :]
        if s < k:
            equal[same] = -SKETCHES - 1
        else:
            equal += same
    x, y = size[a][:, None], size[b][None, :]
    return (equal >= np.minimum(need[a][:, None], need[b][None, :])) & (root[a][:, None] != root[b][None, :]) & (np.minimum(x,
        y) >= THRESHOLD * np.maximum(x, y))


def _codes(values: list) -> np.ndarray:
    code = {v: c for c, v in enumerate(dict.fromkeys(values))}
    return np.array([code[v] for v in values])


def _runs(batches, keys: tuple[str, ...], columns: tuple[str, ...]):
    """(key, {column: values}) of each group of rows that follow each other with equal keys; sketches become a matrix."""
    key, held = None, {}

    def packed():
        return {c: np.concatenate(v) if c == "sketches" else sum(v, []) for c, v in held.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        edge = np.ones(batch.num_rows + 1, bool)
        edge[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in names])
        edge = np.flatnonzero(edge)
        values = {}
        for c in columns:
            col = batch.column(c)
            values[c] = np.asarray(col.values.slice(col.offset * SKETCHES, len(col) * SKETCHES)).reshape(-1,
                SKETCHES) if c == "sketches" else col.to_pylist()
        for a, b in zip(edge, edge[1:], strict=False):
            new = tuple(int(c[a]) for c in names)
            if new != key:
                if key is not None:
                    yield key, packed()
                key, held = new, {c: [] for c in columns}
            for c in columns:
                held[c].append(values[c][a:b])
    if key is not None:
        yield key, packed()


def _rest(rows: DataFrame) -> DataFrame:
    """Who takes part in comparisons that are left: pairs of a bucket with different roots that agree on enough sketches, the
    first of them this bucket's. Parts of a large bucket meet two by two, each two in a group of their own. Rows bucket, k, x, y,
    side, node, root, words, sketches: a text once for each tile (x, y) of about TILE by TILE texts that it has a pair in."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = rows.withColumns({"own": F.pmod(F.xxhash64("node", F.lit(-1)), parts).cast("int"), "tile": F.pmod(F.xxhash64("node",
        F.lit(-3)), F.ceil(F.col("n") / TILE)).cast("int")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("bucket", "i", "j", "k", "own",
        "tile", "node", "root", "words", "sketches")
    sorted_rows = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "own", "root", "node")

    def run(batches):
        for (bucket, i, j), of in _runs(batches, ("bucket", "i", "j"), ("k", "own", "tile", "node", "root", "words", "sketches")):
            words, own, tile, root, k = np.array(of["words"]), np.array(of["own"]), np.array(of["tile"]), _codes(of["root"]), of["k"][0]
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            found = []
            for at in range(0, len(left), 256):
                a = left[at : at + 256]
                b = right[right > a[0]] if i == j else right
                if (root[a] == root[a[0]]).all():
                    b = b[root[b] != root[a[0]]]
                if not len(b):
                    continue
                hit = _wanted(k, a, b, of["sketches"], root, words - SHINGLE + 1, _need(words))
                if i == j:
                    hit &= b[None, :] > a[:, None]
                p, q = (side[at] for side, at in zip((a, b), np.nonzero(hit), strict=True))
                low, high = np.minimum(tile[p], tile[q]), np.maximum(tile[p], tile[q])
                both = np.concatenate([np.stack([low, high, p], 1), np.stack([low, high, q], 1)])
                if len(both):
                    found.append(np.unique(both, axis=0))
            if not found:
                continue
            x, y, at = np.unique(np.concatenate(found), axis=0).T
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), bucket)), pa.array(np.full(len(at), k), pa.int32()), pa.array(x, pa.int32()), pa.array(y,
                        pa.int32()), pa.array(tile[at], pa.int32()), pa.array([of["node"][n] for n in at], pa.binary()),
                    pa.array([of["root"][n] for n in at], pa.binary()), pa.array(words[at], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * SKETCHES, pa.int32()),
                        pa.array(of["sketches"][at].ravel())),
                ],
                ["bucket", "k", "x", "y", "side", "node", "root", "words", "sketches"],
            )

    return arrow_map(sorted_rows, run, "bucket long, k int, x int, y int, side int, node binary, root binary, words long, sketches array<long>")


def _cut(texts: list[str]) -> list[np.ndarray]:
    """The labelled shingles of each text."""
    out = []
    for part in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
        g, bounds = shingles(*hashed_words(part.column("text")))
        out += [g[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


def _verified_rest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (center, node) that join the same texts as the similar pairs among the members of each tile."""
    dealt = members.join(texts, "node").select("bucket", "x", "y", "k", "side", "node", "root", "words", "sketches", "text")
    both = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "node")

    def run(batches):
        for (_, x, y), of in _runs(batches, ("bucket", "x", "y"), ("k", "side", "node", "root", "words", "sketches", "text")):
            words, side, root, nodes = np.array(of["words"]), np.array(of["side"]), _codes(of["root"]), of["node"]
            left, right = np.flatnonzero(side == x), np.flatnonzero(side == y)
            hit = _wanted(of["k"][0], left, right, of["sketches"], root, words - SHINGLE + 1, _need(words))
            if x == y:
                hit &= right[None, :] > left[:, None]
            if not hit.any():
                continue
            cut = _cut(of["text"])
            codes = np.split(np.unique(np.concatenate(cut), return_inverse=True)[1], np.cumsum([len(c) for c in cut])[:-1])
            size = np.array([len(c) for c in cut])
            theirs = np.concatenate([codes[n] for n in right])
            edge = np.concatenate([[0], np.cumsum(size[right])[:-1]])
            mine = np.zeros(max(int(c.max()) for c in codes) + 1, bool)
            forest, found = Forest(), []
            for i in np.flatnonzero(hit.any(1)):
                a = int(left[i])
                mine[codes[a]] = True
                common = np.add.reduceat(mine[theirs].astype(np.int32), edge)  # a chain is no longer than this
                mine[codes[a]] = False
                for j in np.flatnonzero(hit[i] & (common >= THRESHOLD * (size[a] + size[right]) / (1 + THRESHOLD) - 1e-9)):
                    b = int(right[j])
                    ends = of["root"][a], of["root"][b]
                    if forest.find(ends[0]) != forest.find(ends[1]) and similarity(cut[a], cut[b]):
                        forest.join(*ends)
                        found.append((nodes[a], nodes[b]))
            if found:
                yield _links(found)

    return arrow_map(both, run, "center binary, node binary")


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, node, words, class_id and class_size."""
    rows = written(sketched(docs), "sketches")
    nodes = durable(rows.where(F.size("sketches") > 0).groupBy("node").agg(F.first("sketches").alias("sketches"),
        F.first("words").alias("words")))
    entries = nodes.select("node", F.posexplode("sketches").alias("k", "value")).select("node", "k", F.xxhash64("k",
        "value").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(entries.join(shared, "bucket"), "buckets")
    wanted = buckets.select("node").distinct()
    texts = written(_with_nodes(docs).groupBy("node").agg(F.first("text").alias("text")).join(wanted, "node", "left_semi"), "candidates")
    tried = _led(buckets.join(nodes, "node"))
    links = durable(_verified(tried, texts))
    edges = links.select(F.col("center").alias("a"), F.col("node").alias("b"))
    roots = durable(components(edges))
    placed = durable(buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    drop(buckets)
    apart = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("bucket")
    members = durable(_rest(placed.join(apart, "bucket", "left_semi").join(nodes, "node")))
    drop(placed, tried, nodes)
    good = durable(_verified_rest(members, texts))
    if not good.isEmpty():
        roots = durable(components(edges.union(good.select(F.col("center").alias("a"), F.col("node").alias("b")))))
    drop(members, good, links, texts)
    each = rows.groupBy("node").agg(F.min("doc_id").alias("id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id",
        "node")).alias("head"), F.count(F.lit(1)).alias("n"))
    each = durable(each.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    classes = each.groupBy("root").agg(F.min("id").alias("class_id"), F.min("head").alias("head"), F.sum("n").alias("class_size"))
    of_node = durable(lookup(each.select("node", "root"), classes, "root").drop("root"))
    return lookup(rows.select("doc_id", "node", "words"), of_node, "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, unchanged: that of the least doc_id, then of the least hash and text."""
    found = written(groups(docs), "groups")
    id_, node, own = fresh(docs, "id", "node", "own_node")
    heads = found.select(F.col("head.doc_id").alias(id_), F.col("head.node").alias(node)).distinct()

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_nodes(*hashed_words(part.column("text"))), pa.binary())],
                    [*part.schema.names, own])

    marked = arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField(own, T.BinaryType())]))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(node))
    kept = marked.join(heads, here, "left_semi")
    repeats = found.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(id_),
        F.col("node").alias(node))
    if repeats.isEmpty():
        return kept.select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    order = F.struct(*[F.col(c).cast("string") for c in ("text", *[c for c in docs.columns if c not in ("doc_id", "text")])])
    one = kept.join(repeats, here, "left_semi").groupBy("doc_id", own).agg(F.min_by(row, order).alias(node)).select(f"{node}.*")
    return kept.join(repeats, here, "left_anti").select(*docs.columns).unionByName(one)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
