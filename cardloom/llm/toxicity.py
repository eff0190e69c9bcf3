"""Toxicity by a subsequence string-kernel SVM on Nyström landmarks.

A text is a bag of units: blank-separated words, lower-cased, without the marks inside them, so that "i.d-i_o.t" is one
word again (digits stay among letters, as in "1d10t"; a number alone is no unit); runs of three or more single letters are one unit too; a unit of SPAN letters or more is cut into overlapping
parts, of which each is trained on and scored, and its value is its best part's. Two parts compare by the gap-weighted subsequence kernel: every choice of three
letters in order counts, DECAY to the power of the span it takes, so an inserted letter or a gap lowers the similarity a
little instead of losing the word; letters are compared as they are, of any alphabet, over the whole part. Divided by the length's norm sqrt(sum of squared weights), it is a kernel.

Training is by multiple instances, as labels are on whole texts: a toxic text has toxic units among others, a clean one
has none. Starting from parts that no clean text has (or, seen COMMON times or more, that are RATIO times as frequent in toxic texts), ranked by how often they and their letter triples come in toxic texts
against the clean ones, a linear SVM (squared hinge, Newton steps) on Nyström features of LANDMARKS units is trained, the best units of each toxic
text become the positives, and so on for ROUNDS. A logistic model of a text's two best units gives its probability.
A decision function on landmarks is linear in their letter triples, so it is applied as one table over the landmarks' letters
(a letter of no landmark weighs nothing) to the parts of any text, each distinct unit once.

Labels come from rows with crc32(doc_id) mod 4 other than 2. The classifier is fitted on a bounded sample of them: up to
MAX_TOXIC toxic and MAX_CLEAN clean ids, those of least hash, one text each of at most LONGEST bytes, and up to MAX_NEGATIVES
negative parts; every text is scored, whole, by its two best units.

Edge cases. A null or empty text has no units and scores low; without a label of either class all texts score the
training share of toxic labels (0.5 if there is none); a text whose labels differ counts as toxic; null labels are
ignored; repeated rows and ids give one row each; extra columns are kept by drop_toxic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, chunks, crc_mod, on_leave, table

SPAN, STEP = 16, 8
DECAY = 0.5
COMMON, RATIO = 5, 8
LONGEST = 400_000
DENSE = 1 << 22  # a table of so many triples at most is held whole
LANDMARKS, ROUNDS = 160, 3
MAX_TOXIC, MAX_CLEAN, MAX_NEGATIVES = 2000, 4000, 6000
THRESHOLD = 0.3
CACHE_UNITS = 200_000
BLOCK = 4000  # units whose triples are held at once
_MARKS = re.compile(r"[\W_]+")
_BEST = 2


def units(text: str) -> list[str]:
    """The units of a text, in order, without repeats."""
    out: dict[str, None] = {}
    letters: list[str] = []
    for word in dict.fromkeys(text.lower().split()) if not _SINGLES.search(text) else text.lower().split():
        plain = word if word.isalpha() else _MARKS.sub("", word)
        plain = "" if plain.isdigit() else plain
        if len(plain) == 1:
            letters.append(plain)
            continue
        if len(letters) >= 3:
            out["".join(letters)] = None
        letters = []
        if plain:
            out[plain] = None
    if len(letters) >= 3:
        out["".join(letters)] = None
    return list(out)


_SINGLES = re.compile(r"(?:(?<!\S)[^\W\d_]\s+){3}")


def parts(unit: str) -> list[str]:
    if len(unit) < SPAN:
        return [unit]
    return [unit[i : i + SPAN - 1] for i in range(0, max(1, len(unit) - SPAN + 1 + STEP), STEP)]


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(length)] * 3, indexing="ij"))
    keep = (i < j) & (j < k)
    at = np.stack([i[keep], j[keep], k[keep]], 1)
    return at, (DECAY ** (at[:, 2] - at[:, 0] - 2)).astype(np.float32)


@dataclass
class Model:
    letters: dict[str, int]  # from 1 on; 0 is the start mark, and the number after the last any other letter
    keys: np.ndarray  # triples that have a weight, ascending
    weights: np.ndarray
    bias: float
    logit: np.ndarray  # of 1, best, second best
    constant: float | None = None

    def __post_init__(self):
        self.cache: dict[str, float] = {}
        size = (len(self.letters) + 2) ** 3
        self.table = None
        if size <= DENSE:
            self.table = np.zeros(size, np.float32)
            self.table[self.keys] = self.weights

    def of_triples(self, ids: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[ids]
        at = np.minimum(np.searchsorted(self.keys, ids), len(self.keys) - 1)
        return np.where(self.keys[at] == ids, self.weights[at], np.float32(0))

    def values(self, words: list[str]) -> np.ndarray:
        """The decision value of each unit."""
        flat = [p for w in words for p in parts(w)]
        owner = np.repeat(np.arange(len(words)), [len(parts(w)) for w in words])
        out = np.full(len(flat), self.bias)
        size = np.fromiter((len(p) + 1 for p in flat), np.int64, len(flat))
        if len(self.keys):
            for n in np.unique(size):
                if n < 3:
                    continue
                rows = np.flatnonzero(size == n)
                for a in range(0, len(rows), BLOCK):
                    own = rows[a : a + BLOCK]
                    ids, weights, norm = features([flat[r] for r in own], int(n), self.letters)
                    out[own] += (self.of_triples(ids) @ weights) / norm
        best = np.full(len(words), -np.inf)
        np.maximum.at(best, owner, out)
        return best

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        bags = [units(t) for t in texts]
        new = list({u for b in bags for u in b if u not in self.cache})
        if len(self.cache) + len(new) > CACHE_UNITS:
            self.cache.clear()
            new = list({u for b in bags for u in b})
        self.cache.update(zip(new, self.values(new).tolist(), strict=True))
        low = self.bias - 1.0
        x = np.ones((len(texts), 3))
        for i, b in enumerate(bags):
            top = sorted(map(self.cache.__getitem__, b))[-_BEST:]
            x[i, 1:] = (top[-1] if top else low), (top[-2] if len(top) > 1 else low)
        return _sigmoid(np.clip(x, -1.5, 1.5) @ self.logit)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_AT: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def features(words: list[str], n: int, letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Triple ids (words x triples), their weights and the norm, for words of n - 1 letters behind a start mark."""
    if n not in _AT:
        _AT[n] = _triples(n)
    at, weights = _AT[n]
    base = len(letters) + 2
    code = np.array([[0, *[letters.get(c, base - 1) for c in w]] for w in words], np.int32 if base < 1000 else np.int64)
    ids = (code[:, at[:, 0]] * base + code[:, at[:, 1]]) * base + code[:, at[:, 2]]
    return ids, weights, float(np.sqrt((weights**2).sum()))


def phi(words: list[str], letters: dict[str, int]):
    """(word, triple id, value) arrays: the kernel's explicit features, divided by the norm, in the words' order."""
    where, ids, values = [], [], []
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        if n < 2:
            continue
        own = np.flatnonzero(size == n)
        f, weights, norm = features([words[i] for i in own], int(n) + 1, letters)
        where.append(np.repeat(own, f.shape[1]))
        ids.append(f.ravel().astype(np.int64))
        values.append(np.tile(weights / norm, len(own)))
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    where = np.concatenate(where)
    order = np.argsort(where, kind="stable")
    return where[order], np.concatenate(ids)[order], np.concatenate(values)[order]


def _spread(own: list[str], times: np.ndarray, letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(triples, in how many of the words each comes, counted `times`)."""
    size, keys, counts = (len(letters) + 2) ** 3, [np.zeros(0, np.int64)], [np.zeros(0)]
    for a in range(0, len(own), BLOCK):
        w, ids, _ = phi(own[a : a + BLOCK], letters)
        pair = np.unique(w * size + ids)
        key, at = np.unique(pair % size, return_inverse=True)
        keys.append(key)
        counts.append(np.bincount(at, weights=times[a + pair // size], minlength=len(key)))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3.0) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        a, c = x[active], weight[active]
        step = np.linalg.solve((a * c[:, None]).T @ a + np.diag(reg), (a * c[:, None]).T @ y[active]) - w
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(bags: list[list[str]], labels: np.ndarray) -> Model:
    """From the units of texts and their labels."""
    labels = np.asarray(labels, bool)
    if labels.all() or not labels.any():
        return Model({}, np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, np.zeros(3), float(labels.mean()) if len(labels) else 0.5)
    texts, bags = bags, [list(dict.fromkeys(p for u in b for p in parts(u))) for b in bags]
    letters = {c: i + 1 for i, c in enumerate(sorted({c for b in bags for u in b for c in u}))}
    clean: dict[str, int] = {}
    df: dict[str, int] = {}
    for b, t in zip(bags, labels, strict=True):
        of = df if t else clean
        for u in b:
            of[u] = of.get(u, 0) + 1
    n_toxic, n_clean = int(labels.sum()), int((~labels).sum())
    telling = {u for u, n in df.items() if len(u) > 1 and (u not in clean or n >= COMMON and n * n_clean > RATIO * clean[u] * n_toxic)}
    toxic = [[u for u in b if u in telling] for b, t in zip(bags, labels, strict=True) if t]
    pool = sorted(telling)
    rng = np.random.default_rng(0)
    common = sorted((u for u in clean if u not in telling), key=lambda u: (-clean[u], u))
    rest = common[MAX_NEGATIVES // 2 :]
    negatives = common[: MAX_NEGATIVES // 2] + [rest[i] for i in rng.permutation(len(rest))[: MAX_NEGATIVES // 2]]
    background = common[:MAX_NEGATIVES] + [rest[i] for i in rng.permutation(len(rest))[: 4 * MAX_NEGATIVES]]
    times = np.array([df[u] for u in pool], float)
    totals = np.maximum(1.0, [len(background), times.sum()])
    spread = [_spread(background, np.ones(len(background)), letters), _spread(pool, times, letters)]
    keys = np.union1d(spread[0][0], spread[1][0])
    share = np.zeros((2, len(keys)))
    for side, (key, count) in enumerate(spread):
        share[side, np.searchsorted(keys, key)] = count
    mean = (share.sum(0) + 1e-9) / totals.sum()
    z = (share[1] / totals[1] - share[0] / totals[0]) / np.sqrt(mean * (1 / totals).sum())
    model = Model(letters, keys, z.astype(np.float32), 0.0, np.zeros(3))
    first = model.values(pool) if pool else np.zeros(0)
    evidence = dict(zip(pool, first / (np.abs(first).max() + 1e-9) + 0.2 * np.log(times), strict=True)) if pool else {}
    for turn in range(ROUNDS):
        value = evidence
        if turn and pool:
            now = np.clip(model.values(pool), -1, 1)
            value = {u: evidence[u] + v for u, v in zip(pool, now.tolist(), strict=True)}
        chosen: dict[str, float] = {}
        for b in toxic:
            for u in sorted(b, key=lambda u: (-value[u], u))[:_BEST]:
                chosen[u] = chosen.get(u, 0) + 1
        positives = sorted(chosen, key=lambda u: (-chosen[u] * max(value[u], 0), u))
        hard = np.argsort(-model.values(negatives), kind="stable")
        marks = positives[: LANDMARKS // 2] + positives[LANDMARKS // 2 :: max(1,
            len(positives) // (LANDMARKS // 4))][: LANDMARKS // 4] + [negatives[i] for i in hard[: LANDMARKS // 4]]
        w, ids, v = phi(marks, letters)
        used = np.unique(ids)  # triples of no landmark have no row
        if not len(used) or not positives:
            return Model({}, used[:0], np.zeros(0, np.float32), 0.0, np.zeros(3), float(labels.mean()))
        of_mark = np.zeros((len(used) + 1, len(marks)), np.float32)  # the last row, of zeros, for all other triples
        row_of = lambda ids: _rows(used, ids)
        np.add.at(of_mark, (row_of(ids), w), v)
        gram = of_mark.T @ of_mark
        s, u = np.linalg.eigh(gram.astype(np.float64))
        keep = s > 1e-6 * s.max()
        whiten = u[:, keep] / np.sqrt(s[keep])
        rank = sorted((u for u in pool if u not in chosen), key=lambda u: (value[u], u))
        unlike = [rank[i] for i in rng.permutation(len(rank) // 2)[: MAX_NEGATIVES // 2]]
        train = positives + negatives + unlike
        w, ids, v = phi(train, letters)
        k, rows = np.zeros((len(train), len(marks))), row_of(ids)
        edge = np.searchsorted(w, np.arange(len(train) + 1))
        for i in range(len(train)):
            a, b = edge[i], edge[i + 1]
            if b > a:
                k[i] = v[a:b] @ of_mark[rows[a:b]]
        x = np.hstack([k @ whiten, np.ones((len(train), 1))])
        y = np.where(np.arange(len(train)) < len(positives), 1.0, -1.0)
        weight = np.ones(len(train))
        weight[: len(positives)] = [chosen[p] for p in positives]
        weight[: len(positives)] *= 0.5 * (len(train) - len(positives)) / weight[: len(positives)].sum()
        solved = _svm(x, y, weight)
        model = Model(letters, used, (of_mark[:-1] @ (whiten @ solved[:-1])).astype(np.float32), float(solved[-1]), np.zeros(3))
    model = _compact(model, marks)
    known = sorted({u for b in texts for u in b})
    model.cache = dict(zip(known, model.values(known).tolist(), strict=True))
    low = model.bias - 1.0
    x = np.ones((len(texts), 3))
    for i, b in enumerate(texts):
        top = sorted((model.cache[u] for u in b), reverse=True)[:_BEST] + [low, low]
        x[i, 1:] = top[0], top[1]
    x = np.clip(x, -1.5, 1.5)
    model.logit = _logistic(x, labels.astype(float))
    if model.logit[1:].min() < 0:  # the two go together in training; a single unit must not speak against
        one = _logistic(np.stack([x[:, 0], 0.5 * x[:, 1] + 0.5 * x[:, 2]], 1), labels.astype(float))
        model.logit = np.array([one[0], 0.5 * one[1], 0.5 * one[1]])
    model.cache = {}
    return model


def _rows(used: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(used, ids), len(used) - 1)
    return np.where(used[at] == ids, at, len(used))


def _compact(model: Model, marks: list[str]) -> Model:
    """The same decision over the landmarks' letters alone."""
    own = {c: i + 1 for i, c in enumerate(sorted({c for u in marks for c in u}))}
    old = len(model.letters) + 2
    to = np.zeros(old, np.int64)
    for c, i in own.items():
        to[model.letters[c]] = i
    a, b, c = model.keys // (old * old), model.keys // old % old, model.keys % old
    keys = (to[a] * (len(own) + 2) + to[b]) * (len(own) + 2) + to[c]
    order = np.argsort(keys)
    return Model(own, keys[order], model.weights[order], model.bias, model.logit, model.constant)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows outside the held-out fold."""
    own = labels.where(F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64("doc_id")
    some = own.where("toxic > 0").orderBy(rank, "doc_id").limit(MAX_TOXIC).union(own.where("toxic <= 0").orderBy(rank,
        "doc_id").limit(MAX_CLEAN))
    texts = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).select("doc_id", "text").join(F.broadcast(some),
        "doc_id")  # MAX_TOXIC + MAX_CLEAN ids at most
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for batch in batches:
            bags = ["\n".join(units(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(bags, pa.string())], ["doc_id",
                "toxic", "units"])

    kinds = dict(texts.dtypes)
    rows = arrow_map(texts, run, f"doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, units string").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["units"]))
    one: dict[str, str] = {}  # a unit of many texts is held once
    bags = [[one.setdefault(u, u) for u in r["units"].split("\n")] if r["units"] else [] for r in rows]
    marks = np.array([r["toxic"] > 0 for r in rows])
    del rows, one
    return fit(bags, marks)


_models: dict[str, Model] = {}
on_leave(__name__, _models.clear)


def _opened(name: str, value) -> Model:
    """The broadcast model, opened once in a worker, with its cache of units."""
    if name not in _models:
        _models.clear()
        _models[name] = Model(*value.value)
    return _models[name]


def _sent(spark: SparkSession, model: Model):
    return spark.sparkContext.broadcast((model.letters, model.keys, model.weights, model.bias, model.logit, model.constant))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row."""
    sent = _sent(docs.sparkSession, model)
    name = f"{docs.sparkSession.sparkContext.applicationId}-{id(sent)}-{hash(model.weights.tobytes())}"

    def run(batches):
        own = _opened(name, sent)
        for batch in batches:
            for part in chunks(batch):
                s = own.scores([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array(s >= THRESHOLD).cast(pa.int32())],
                    ["doc_id", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return arrow_map(rows, run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that aren't predicted toxic, unchanged."""
    sent = _sent(docs.sparkSession, model)
    name = f"{docs.sparkSession.sparkContext.applicationId}-{id(sent)}-{hash(model.weights.tobytes())}"

    def run(batches):
        own = _opened(name, sent)
        for batch in batches:
            for part in chunks(batch):
                s = own.scores([t or "" for t in part.column("text").to_pylist()])
                yield part.filter(pa.array(s < THRESHOLD))

    return arrow_map(docs, run, docs.schema)


def op4_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
