"""Scores of texts by a log-bilinear language model trained with noise-contrastive estimation in numpy.

Tokens are blank-separated words with A-Z lower-cased, and an end after each text. Counts of all tokens of all training
texts are summed in Spark by 64-bit hash, of which all but the low bits (the shape, see SHAPES) tell words apart. The model predicts the class of a token from the classes of the two tokens before:
r = R[a] C1 + R[b] C2, score of w = r . Q[w] + bias[w]. Classes are the HEAD most frequent tokens, each its own, and SHAPES
classes of all other words by their last bytes and length, so that every word has vectors, whatever its rank.

Training goes over every training token. Input partitions are put together into groups of about GROUP_TOKENS tokens, so how much
one group learns doesn't depend on how the input is split. The first group alone is gone through first; then every group starts
from what it learnt, takes a step of noise-contrastive estimation (BATCH tokens against NOISE draws from the class frequencies)
after the other through all its texts, and the groups' parameters are averaged by their tokens in a second shuffle. So the steps
grow with the corpus, a lost task is redone alone, and the driver holds one set of parameters. A partition larger than a group
stays one group.

Scoring looks up three tables that each task makes once, of scores after either token and of the log sums of all contexts, so its
work is by token and not by context and class, and log-probabilities are exactly normalised. A word of a shape class also costs its share of the class by count, (c + 0.1) / (N + 0.1 (V + 1))
with N and V of the class, so that the probabilities of all tokens, with one unseen for each shape, sum to one. Counts of such
words reach their texts by a shuffled join of distinct tokens; no vocabulary is collected or broadcast.

Edge cases. A null or empty text is the end alone; ids may be null or repeat, one row out per row in; with no training
text every token is unseen and the model stays as it started; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, _NOT_SPACE, arrow_map, chunks, crc_mod, drop, mix, span_hashes, table, text_bytes, word_spans, written

HEAD, SHAPES = 255, 256
WIDTH, NOISE, BATCH = 16, 48, 1024
RATE = 0.01
GROUP_TOKENS = 8_000_000  # some 50 MB of text
SLOT = 256  # parameters that travel in one row when they are averaged
TINY = 1e-200
END = 0x454E44  # the end token's key; word hashes are 64 bits
PAD = 0.1


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, ends included, and the n+1 bounds. A hash bears the token's shape in its low bits."""
    data, offsets = text_bytes(col)
    data = _LOWER[data]
    start, end, row = word_spans(data, offsets, _NOT_SPACE)
    h = span_hashes(data, start, end)
    size = end - start
    tail = np.minimum(size, 6).astype(np.uint64)
    for k in range(1, 4):
        tail = tail * np.uint64(257) + np.where(size >= k, data[np.maximum(end - k, 0)] if len(data) else 0, 256).astype(np.uint64)
    low = np.uint64(SHAPES - 1)
    h = ((h & ~low) | (mix(tail) & low)).view(np.int64)
    first = np.searchsorted(row, np.arange(len(offsets)))
    n = len(offsets) - 1
    return np.insert(h, first[1:], END), first + np.arange(n + 1)


def token_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                h, c = np.unique(tokens(part.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])

    return arrow_map(docs.select("text"), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _shape():
    return F.col("h").bitwiseAND(F.lit(SHAPES - 1)).cast("int")


class Classes:
    """Class of a token: its rank in the head, or len(head) and its shape; one more class stands before a text."""

    def __init__(self, head: list[int]):
        self.sorted = np.sort(np.array(head, np.int64))
        self.order = np.argsort(np.array(head, np.int64))
        self.n = len(head)
        self.all = self.n + SHAPES

    def of(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, h), self.n - 1)
        return np.where(self.sorted[at] == h, self.order[at], self.n + (h & (SHAPES - 1))).astype(np.int64)

    def contexts(self, c: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the tokens two before and one before each token."""
        start = bounds[:-1]
        one = np.concatenate([[self.all], c[:-1]])
        one[start] = self.all
        two = np.concatenate([[self.all], one[:-1]])
        two[start] = self.all
        return two, one


class LogBilinear:
    """Parameters of the model: R (classes + 1), Q, C1, C2, bias, as one flat array behind views."""

    def __init__(self, unigram: np.ndarray, flat: np.ndarray | None = None, seed: int = 0):
        v = len(unigram)
        sizes = [(v + 1, WIDTH), (v, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (v,)]
        ends = np.cumsum([int(np.prod(s)) for s in sizes])
        self.unigram = unigram
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = rng.normal(0, 0.1, ends[-1]).astype(np.float32)
            flat[ends[1] : ends[2]] = (0.5 * np.eye(WIDTH)).ravel()
            flat[ends[2] : ends[3]] = np.eye(WIDTH).ravel()
            flat[ends[3] :] = np.log(unigram)
        # an unpickled array has a dtype object of its own, with which np.add.at is slow; the view has numpy's
        self.flat = flat = flat.view(flat.dtype.type)
        self.r, self.q, self.c1, self.c2, self.bias = (flat[a:b].reshape(s) for a, b, s in zip(np.concatenate([[0], ends[:-1]]), ends,
            sizes, strict=True))

    def train(self, batches, rate: float = RATE) -> int:
        """Steps of noise-contrastive estimation, with decaying scaled gradients; how many tokens were seen.

        Contexts are multiplied, and their gradients summed, by class. All larger arrays are made once: a worker's memory is costly to
        take anew each step."""
        rng, seen = np.random.default_rng(1), 0
        square = np.full_like(self.flat, 1e-8)
        own = LogBilinear(self.unigram, np.zeros_like(self.flat))  # the gradient
        change, turned = np.empty_like(self.flat), np.empty_like(self.r)
        log_noise = (np.log(NOISE) + np.log(self.unigram)).astype(np.float32)
        draws = np.cumsum(self.unigram)
        left, right = np.empty_like(self.r), np.empty_like(self.r)  # of each class as second last and last token; then their gradients
        rooms = np.empty((4, 0, WIDTH), np.float32)
        for step, (two, one, w) in enumerate(batches):
            n = len(w)
            if rooms.shape[1] < n:
                rooms, room, cells = np.empty((4, n, WIDTH), np.float32), np.empty(NOISE * n, np.float32), np.empty((n, WIDTH), np.int64)
            h, to, dh, more = rooms[:, :n]
            noise = np.minimum(np.searchsorted(draws, rng.random(NOISE) * draws[-1]), len(draws) - 1)
            np.take(np.matmul(self.r, self.c1, out=left), two, 0, h, "clip")
            h += np.take(np.matmul(self.r, self.c2, out=right), one, 0, more, "clip")
            np.take(self.q, w, 0, to, "clip")
            good = 0.5 - 0.5 * np.tanh(0.5 * (np.einsum("ij,ij->i", h, to) + self.bias[w] - log_noise[w]))
            bad, of_noise = room[: NOISE * n].reshape(NOISE, n), self.q[noise]  # a row for each noise class
            np.matmul(-of_noise, h.T, out=bad)
            bad += (log_noise[noise] - self.bias[noise])[:, None]
            with np.errstate(over="ignore"):
                np.exp(bad, out=bad)
            bad += 1
            np.divide(-1, bad, out=bad)
            np.matmul(bad.T, of_noise, out=dh)
            dh += np.multiply(good[:, None], to, out=to)
            own.flat[:] = 0
            _scatter(own.q, w, np.multiply(good[:, None], h, out=more), cells)
            np.add.at(own.q, noise, bad @ h)
            own.bias += np.bincount(w, good, len(own.bias)).astype(np.float32)
            np.add.at(own.bias, noise, bad.sum(1))
            left[:], right[:] = 0, 0
            _scatter(left, two, dh, cells)
            _scatter(right, one, dh, cells)
            np.matmul(left, self.c1.T, out=own.r)
            own.r += np.matmul(right, self.c2.T, out=turned)
            np.matmul(self.r.T, left, out=own.c1)
            np.matmul(self.r.T, right, out=own.c2)
            own.flat /= n
            np.multiply(own.flat, own.flat, out=change)
            change -= square
            change *= 0.05
            square += change
            np.divide(square, 1 - 0.95 ** (step + 1), out=change)
            change += 1e-10
            np.sqrt(change, out=change)
            np.divide(own.flat, change, out=change)
            change *= rate / (1 + step / 200) ** 0.5
            self.flat += change
            seen += n
        return seen

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a class scores after each token two before, what after each one before (bias included), and the log of the sum of
        exp(score) over all classes for each pair of them. exp turns the sum of two scores into a product, so all sums are one
        product of matrices, in doubles; where both factors vanish the scores are added first."""
        q = self.q.astype(float)
        left, right = self.r @ self.c1 @ q.T, self.r @ self.c2 @ q.T + self.bias
        a, b = left.max(1, keepdims=True), right.max(1, keepdims=True)
        sums = np.exp(left - a) @ np.exp(right - b).T
        whole = np.log(np.maximum(sums, TINY)) + a + b.T
        for i in np.flatnonzero((sums < TINY).any(1)):
            logits = left[i] + right
            top = logits.max(1, keepdims=True)
            whole[i] = top[:, 0] + np.log(np.exp(logits - top).sum(1))
        return left, right, whole

    def log10_of(self, two: np.ndarray, one: np.ndarray, w: np.ndarray, tables=None) -> np.ndarray:
        """Normalised log10 probability of each class w after its context."""
        left, right, whole = tables or self.tables()
        return (left[two, w] + right[one, w] - whole[two, one]) / np.log(10)


@lru_cache(maxsize=4)
def _places(rows: int, width: int) -> np.ndarray:
    """The place of every number of a table."""
    return np.arange(rows * width).reshape(rows, width)


def _scatter(to: np.ndarray, at: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> None:
    """Adds each row to its own row of `to`. cells: room for the place of every number."""
    cells = np.take(_places(*to.shape), at, 0, cells[: len(at)], "clip")
    np.add.at(to.reshape(-1), cells.reshape(-1), rows.reshape(-1))


def trained(docs: DataFrame, head: list[int], unigram: np.ndarray, total: int) -> LogBilinear:
    """The model after the first group alone, and then all groups from there. total: training tokens."""
    unigram = unigram.astype(np.float32)
    model = LogBilinear(unigram)
    texts = docs.select("text").coalesce(max(1, -(-total // GROUP_TOKENS)))
    for first in (True, False):
        sent = docs.sparkSession.sparkContext.broadcast(model.flat)

        def run(batches, sent=sent, first=first):
            if first and TaskContext.get().partitionId():
                return
            own, kinds = LogBilinear(unigram, sent.value.copy()), Classes(head)

            def steps():
                for batch in batches:
                    for part in chunks(batch):
                        h, bounds = tokens(part.column("text"))
                        w = kinds.of(h)
                        two, one = kinds.contexts(w, bounds)
                        order = np.random.default_rng(len(w)).permutation(len(w))
                        for a in range(0, len(w), BATCH):
                            at = order[a : a + BATCH]
                            yield two[at], one[at], w[at]

            seen = own.train(steps(), RATE if first else RATE / 2)
            if seen:
                slots = range(0, len(own.flat), SLOT)
                sums = pa.array([own.flat[a : a + SLOT].astype(float) * seen for a in slots], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(slots), pa.int32()), pa.array([float(seen)] * len(slots)), sums], ["slot",
                    "seen", "sums"])

        def reduce(batches):
            total: dict[int, list] = {}
            for batch in batches:
                for slot, seen, sums in zip(batch.column("slot").to_pylist(), batch.column("seen").to_pylist(), batch.column("sums"),
                    strict=True):
                    held = total.setdefault(slot, [0.0, np.zeros(len(sums.values))])
                    held[0] += seen
                    held[1] += sums.values.to_numpy()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(s / n).tolist() for n,
                    s in total.values()], pa.list_(pa.float64()))], ["slot", "mean"])

        sums = written(arrow_map(texts, run, "slot int, seen double, sums array<double>"), "lm-parameters")
        means = arrow_map(sums.repartition("slot"), reduce, "slot int, mean array<double>").collect()  # one set of parameters
        drop(sums)
        if means:
            model = LogBilinear(unigram, np.concatenate([np.array(r["mean"], np.float32) for r in sorted(means, key=lambda r: r["slot"])]))
        sent.unpersist()
    return model


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    spark = docs.sparkSession
    counts = written(token_counts(training), "token-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    best = [(r["h"], r["c"]) for r in counts.orderBy(F.desc("c"), "h").limit(HEAD).collect()]
    if END not in [h for h, _ in best]:
        end = counts.where(F.col("h") == END).first()
        best = [*best[: HEAD - 1], (END, end["c"] if end else 0)]
    head, head_counts = [h for h, _ in best], np.array([c for _, c in best], float)
    of_shape = {r["shape"]: (r["c"], r["n"]) for r in counts.where(~F.col("h").isin(head)).groupBy(_shape().alias("shape")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    shape_counts = np.array([of_shape.get(i, (0, 0)) for i in range(SHAPES)], float)
    unigram = np.concatenate([head_counts, shape_counts[:, 0]]) + PAD
    unigram /= unigram.sum()
    model = trained(training, head, unigram, int(total))
    sent = spark.sparkContext.broadcast(model.flat)
    base_of = np.log10((head_counts + PAD) / (total + PAD * (kinds + 1)))
    known = head_counts > 0

    def run(batches):
        own, at = Classes(head), TaskContext.get().partitionId() << 33
        lm = LogBilinear(unigram.astype(np.float32), sent.value)
        tables = lm.tables()
        for batch in batches:
            for part in chunks(batch):
                h, bounds = tokens(part.column("text"))
                c = own.of(h)
                sums = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  no text is without its end
                p = sums(lm.log10_of(*own.contexts(c, bounds), c, tables))
                head_or_none = np.minimum(c, own.n)
                of_head = np.append(base_of, 0.0)[head_or_none]
                rest = np.flatnonzero(c >= own.n)
                row = np.searchsorted(bounds, rest, "right") - 1
                order = np.lexsort((h[rest], row))
                hh, rr = h[rest][order], row[order]
                new = np.ones(len(hh), bool)
                new[1:] = (hh[1:] != hh[:-1]) | (rr[1:] != rr[:-1])
                where = np.flatnonzero(new)
                times = np.diff(np.append(where, len(hh)))
                edge = np.searchsorted(rr[where], np.arange(len(bounds)))
                size = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(at, at + size)), part.column("doc_id"), pa.array(np.diff(bounds)),
                            pa.array(sums(np.append(known, False)[head_or_none].astype(np.int64))), pa.array(sums(of_head)), pa.array(p),
                        pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(hh[where]),
                            pa.array(times)], ["h", "n"])),
                    ],
                    ["row", "doc_id", "n_tokens", "n_head", "base_head", "model", "rest"],
                )
                at += size

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    rows = written(arrow_map(rows, run, "row long, doc_id long, n_tokens long, n_head long, base_head double, model double, rest array<struct<h:long,n:long>>"), "scored")
    c = F.coalesce("c", F.lit(0))
    whole = F.array(*[F.lit(float(n + PAD * (v + 1))) for n, v in shape_counts])
    tail = rows.select("row", F.explode("rest").alias("t")).select("row", F.col("t.h").alias("h"), F.col("t.n").alias("n")).join(counts,
        "h", "left")
    tail = tail.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_rest"),
        F.sum(F.col("n") * F.log10((c + PAD) / (total + PAD * (kinds + 1)))).alias("base_rest"),
        F.sum(F.col("n") * F.log10((c + PAD) / whole[_shape()])).alias("model_rest"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return rows.drop("rest").join(tail, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_head") + zero("n_rest")).cast("long").alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_head") + zero("base_rest")).alias("base_score"), (F.col("model") + zero("model_rest")).alias("score"),
    )


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod(F.col("doc_id"), 10)
    return score(docs, docs.where(fold != 0)).withColumn("held_out", crc_mod(F.col("doc_id"), 10) == 0)
