"""Merkle dataset manifest: trees of fixed fanout over each group's rows, built by mountain-range stacks.

Rows are dealt to shards by range of (group, order), so a shard holds runs of consecutive leaves, and prefix sums of the runs' sizes
give each leaf its index in its group. A shard's task pushes its leaves on a stack with one open run of nodes for each level: a run
that is full (or ends the group) is hashed and carried one level up, as in counting with base FANOUT, and the new node is
recorded. A run that began in another shard or goes on in one can't be hashed there: its nodes are left as peaks. Peaks are few (some
FANOUT a level on each side of a run of leaves); they are merged level by level, a group-by of at most FANOUT rows to a parent. A
short run at the end of a group is hashed as it is, without padding; a lone node stays as it is.

Proofs go the other way: a shard's own nodes, the few nodes of other shards that are siblings on its edges, and its leaves meet in
one task, ordered from the top level down. A leaf's path is, for each level, the digests to the left and to the right of its
ancestor in its run; hashing along paths is left to SQL functions, apart from the code that built the tree.

The groups' own roots are the leaves of a second tree, built in the same way; its paths continue those of the rows.

Edge cases. Null columns are hashed as `-`; a null source is a group before all others (the empty source is another one); null
doc_ids come first; rows that repeat a doc_id are ordered by their leaf digests, so equal rows differ only in place; an empty table has
no rows and no root; extra columns are ignored; texts of any length are hashed in the JVM as they stand.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, durable, small, table

FANOUT = 3
SHARD_ROWS = 200_000  # leaves that one task holds at once
OUT_ROWS = 2_048
HEAD = 64  # above every level: a run's own row
PATH = "array<struct<left:string,right:string>>"


def level_sizes(total: int) -> list[int]:
    """Nodes of each level over `total` leaves, up to the root."""
    sizes = [total]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FANOUT))
    return sizes


class MountainRange:
    """The nodes over leaves start, start + 1, ... of a group of `total`; push() gives the records that a leaf completes:
    (level, index, digest, peak)."""

    def __init__(self, start: int, total: int):
        self.next = start
        self.sizes = level_sizes(total)
        self.open: list[list[str]] = [[] for _ in self.sizes]

    def push(self, digest: str) -> list[tuple[int, int, str, bool]]:
        out, level, at = [], 0, self.next
        self.next += 1
        while True:
            run = self.open[level]
            run.append(digest)
            if (at + 1) % FANOUT and at + 1 < self.sizes[level]:
                return out
            self.open[level] = []
            if len(run) <= at % FANOUT or level + 1 == len(self.sizes):  # its start is elsewhere, or it is the root
                return out + [(level, at - len(run) + 1 + i, d, True) for i, d in enumerate(run)]
            level, at, digest = level + 1, at // FANOUT, hashlib.sha256("".join(run).encode()).hexdigest()
            out.append((level, at, digest, False))

    def close(self) -> list[tuple[int, int, str, bool]]:
        """What is left open goes on in another shard."""
        out, end = [], self.next
        for level, run in enumerate(self.open):
            out += [(level, end - len(run) + i, d, True) for i, d in enumerate(run)]
            end //= FANOUT
        return out


@dataclass
class Tree:
    """leaves: shard, grp, idx, leaf, data. runs: shard, grp, start, rows, total. nodes: records of the shards' stacks. edges: grp, level,
    idx, digest of the peaks and what they were merged to. roots: grp, root."""

    leaves: DataFrame
    runs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    shards: int


def _power(level: Column) -> Column:
    return F.array(*[F.lit(FANOUT**k).cast("long") for k in range(40)])[level]


def build(rows: DataFrame, order: str, shards: int | None = None) -> Tree:
    """The trees over rows (grp, <order>, leaf, data): one for each grp, leaves ascending by (order, leaf). rows are read more than
    once: pass a written table."""
    if shards is None:
        count, wanted = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(1, -(-count // SHARD_ROWS), min(wanted, count // 1000))
    by = [F.col("grp"), F.col(order).asc_nulls_first(), F.col("leaf"), F.col("place")]
    dealt = rows.withColumn("place", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(shards, *by).sortWithinPartitions(*by)
    dealt = durable(dealt.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("place"), "grp", "leaf",
        "data"))
    found = dealt.groupBy("shard", "grp").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    whole = Window.partitionBy("grp")  # one row for each shard
    before = whole.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = durable(found.select("*", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
        F.sum("rows").over(whole).alias("total")))
    placed = dealt.join(small(runs.select("shard", "grp", "first", "start", "total")), ["shard", "grp"])
    placed = placed.select("shard", "grp", (F.col("start") + F.col("place") - F.col("first")).alias("idx"), "total", "leaf", "data")
    shards = (runs.agg(F.max("shard")).first()[0] or 0) + 1
    ordered = placed.select("shard", "grp", "idx", "total", "leaf").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard",
        "grp", "idx")
    nodes = durable(arrow_map(ordered, _stack, "shard int, grp string, level int, idx long, digest string, peak boolean, total long"))
    most = runs.agg(F.max("total")).first()[0] or 1
    depth = len(level_sizes(most)) - 1
    peaks = durable(nodes.where("peak").select("grp", "total", "level", "idx", "digest"))  # few; each level reads them
    edges = _merge(peaks, depth)
    roots = edges.where(_size(F.col("total"), F.col("level")) == 1).select("grp", F.col("digest").alias("root"))
    return Tree(placed, runs, nodes, edges, roots, shards)


def _size(total: Column, level: Column) -> Column:
    """Nodes of a level over `total` leaves."""
    power = _power(level)
    return _div(total + power - 1, power)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _stack(batches):
    key, stack, out = None, None, []

    def pack():
        shard, grp, level, idx, digest, peak, total = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(shard, pa.int32()), pa.array(grp, pa.string()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()),
                pa.array(digest, pa.string()), pa.array(peak, pa.bool_()), pa.array(total, pa.int64())],
            ["shard", "grp", "level", "idx", "digest", "peak", "total"],
        )

    def keep(found):
        out.extend([(*key, *record, stack.sizes[0]) for record in found])

    for batch in batches:
        for shard, grp, idx, total, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (shard, grp):
                if stack:
                    keep(stack.close())
                key, stack = (shard, grp), MountainRange(idx, total)
            keep(stack.push(leaf))
            if len(out) >= OUT_ROWS:
                yield pack()
    if stack:
        keep(stack.close())
    if out:
        yield pack()


def _merge(peaks: DataFrame, depth: int) -> DataFrame:
    """Peaks of all shards and every node above them."""
    all_nodes, made = peaks, None
    for level in range(depth):
        at = peaks.where(F.col("level") == level)
        at = at.union(made) if made is not None else at
        at = at.where(_size(F.col("total"), F.lit(level)) > 1).withColumn("parent", _div(F.col("idx"), F.lit(FANOUT).cast("long")))
        run = F.sort_array(F.collect_list(F.struct("idx", "digest")))["digest"]  # at most FANOUT
        made = durable(
            at.groupBy("grp", "total", "parent").agg(run.alias("run"))
            .select("grp", "total", F.lit(level + 1).alias("level"), F.col("parent").alias("idx"), F.sha2(F.concat_ws("", "run"),
                256).alias("digest"))
        )
        all_nodes = all_nodes.union(made)
    return all_nodes


def _siblings_elsewhere(runs: DataFrame) -> DataFrame:
    """shard, grp, level, idx of the nodes that a shard's paths need and its own stack has not completed."""
    start, end, total, level = F.col("start"), F.col("start") + F.col("rows"), F.col("total"), F.col("level")
    power, above = _power(level), _power(level + 1)
    levels = runs.withColumn("level", F.explode(F.filter(F.sequence(F.lit(0), F.lit(38)), lambda k: _size(total, k) > 1)))
    low = FANOUT * _div(start, above)
    high = F.least(FANOUT * _div(end - 1, above) + FANOUT, _size(total, level))
    own_from = _size(start, level)
    own_to = F.when(end == total, _size(total, level)).otherwise(_div(end, power))
    needs = levels.select("shard", "grp", "level", low.alias("low"), high.alias("high"), own_from.alias("a"), own_to.alias("b"))
    none = F.array().cast("array<bigint>")
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    a, b = (F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col("high")) for x in "ab")
    return needs.select("shard", "grp", "level", F.explode(F.concat(span(F.col("low"), a), span(b, F.col("high")))).alias("idx"))


def proofs(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """data, leaf, root (of its group) and path of every leaf; `above` (grp, path) continues the paths of a group."""
    spark = tree.leaves.sparkSession
    data = tree.leaves.schema["data"].dataType
    empty = F.lit(None).cast(data).alias("data")
    no_path = F.lit(None).cast(PATH).alias("above")
    other = _siblings_elsewhere(tree.runs).join(tree.edges.select("grp", "level", "idx", "digest"), ["grp", "level", "idx"])
    head = tree.runs.join(tree.roots, "grp")
    head = head.join(above.select("grp", F.col("path").alias("above")), "grp") if above is not None else head.withColumn("above",
        F.array().cast(PATH))
    rows = (
        tree.leaves.select("shard", "grp", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"), F.lit(True).alias("own"),
            "data", no_path)
        .union(tree.nodes.where("NOT peak").select("shard", "grp", "level", "idx", "digest", F.lit(False), empty, no_path))
        .union(other.select("shard", "grp", "level", "idx", "digest", F.lit(False), empty, no_path))
        .union(head.select("shard", "grp", F.lit(HEAD), "total", "root", F.lit(False), empty, "above"))
    )
    together = rows.repartitionById(tree.shards, F.col("shard")).sortWithinPartitions(F.col("shard"), F.col("grp"), F.col("level").desc(),
        F.col("idx"))
    schema = T.StructType([T.StructField("data", data), T.StructField("leaf", T.StringType()), T.StructField("root", T.StringType())])
    schema = schema.add("path", spark.createDataFrame([], f"path {PATH}").schema["path"].dataType)
    return arrow_map(together, _paths, schema)


def _paths(batches):
    held: list[pa.RecordBatch] = []  # of one shard's group
    key, waiting, n = None, [], 0

    def flush():
        nonlocal waiting, n
        done = pa.Table.from_batches(waiting).combine_chunks().to_batches()
        waiting, n = [], 0
        return done

    def add(batch):
        nonlocal n
        waiting.append(batch)
        n += len(batch)
        return n >= OUT_ROWS

    for batch in batches:
        grp, shard = batch.column("grp"), np.asarray(batch.column("shard"))
        names = np.asarray(grp.to_pylist(), object)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), len(names)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a and key != (shard[a], names[a]):
                if held:
                    for part in _run_paths(held):
                        if add(part):
                            yield from flush()
                held, key = [], (shard[a], names[a])
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        for part in _run_paths(held):
            if add(part):
                yield from flush()
    if waiting:
        yield from flush()


def _run_paths(batches: list[pa.RecordBatch]):
    """The paths of one run of leaves, from its rows, top level first."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    level, idx, digest = (rows.column(c).combine_chunks() for c in ("level", "idx", "digest"))
    level, idx = np.asarray(level), np.asarray(idx)
    head = rows.slice(0, 1).to_pylist()[0]
    left: list[str] = []
    right: list[str] = []
    base: list[int] = []  # place in left and right of node 0 of a level
    for k in range(len(level_sizes(head["idx"])) - 1):
        a, b = np.searchsorted(-level, [-k, -k + 1])
        nodes = digest.slice(a, b - a).to_pylist()
        base.append(len(left) - int(idx[a]))
        for at in range(0, len(nodes), FANOUT):
            run = nodes[at : at + FANOUT]
            for i in range(len(run)):
                left.append("".join(run[:i]))
                right.append("".join(run[i + 1 :]))
    own = np.flatnonzero(np.asarray(rows.column("own").combine_chunks().to_numpy(zero_copy_only=False)))
    top = len(left)
    left += [x["left"] for x in head["above"]]
    right += [x["right"] for x in head["above"]]
    lefts, rights = pa.array(left, pa.string()), pa.array(right, pa.string())
    data = rows.column("data").combine_chunks()
    for at in range(0, len(own), OUT_ROWS):
        mine = own[at : at + OUT_ROWS]
        steps = [base[k] + idx[mine] // FANOUT**k for k in range(len(base))] + [np.full(len(mine), top + i) for i in range(len(left) - top)]
        places = pa.array(np.stack(steps, 1).ravel() if steps else np.empty(0, np.int64), pa.int64())
        pairs = pa.StructArray.from_arrays([lefts.take(places), rights.take(places)], ["left", "right"])
        path = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1) * len(steps), pa.int32()), pairs)
        take = pa.array(mine)
        yield pa.RecordBatch.from_arrays([data.take(take), digest.take(take), pa.array([head["digest"]] * len(mine), pa.string()), path],
            ["data", "leaf", "root", "path"])


def proof_digest(path: Column) -> Column:
    """H of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda digest, x: F.sha2(F.concat(x["left"], digest, x["right"]), 256))


def leaf_digest(columns: list[Column]) -> Column:
    sized = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*sized), 256)


def manifest(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path (to the root) and the leaf of the tampered row, for every row."""
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    leaf = leaf_digest([*cells, F.col("text")])
    tampered = F.when(hit & (F.instr("text", "\n") > 0), leaf_digest([*cells, F.replace(F.col("text"), F.lit("\n"), F.lit(""))]))
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))  # null first: "-" is below "s"
    rows = docs.select(name.alias("grp"), F.col("doc_id").cast("long").alias("ord"), leaf.alias("leaf"), tampered.alias("tampered"))
    rows = durable(rows).withColumn("data", F.struct(F.col("ord").alias("doc_id"), "tampered"))
    tree = build(rows, "ord", shards)
    top = build(tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("ord"), F.col("root").alias("leaf"),
        F.struct("grp").alias("data")), "ord")
    above = proofs(top).select(F.col("data.grp").alias("grp"), "path")
    root = top.roots.first()  # one row
    return proofs(tree, durable(above)).select(
        "data.doc_id", "leaf", F.col("root").alias("subroot"), F.lit(root and root["root"]).cast("string").alias("root"), "path",
        F.coalesce("data.tampered", "leaf").alias("tampered"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """Digests of the proofs, the root that the tampered leaf gives, and whether it is the root."""
    full = rows.withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return full.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_mountain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(manifest(table(spark, sf_dir, "documents")))
