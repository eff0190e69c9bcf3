import hashlib
import pickle
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF, rows_of

from cardloom.llm import bpe, chat_format, decontamination, html_extract, lm_scoring, near_dedup, quality_rules, sharding, token_output, toxicity
from cardloom.llm.common import hashed_words
from cardloom.llm.queries import ORACLES, QUERIES
from cardloom.llm.tokens import UNSURE, tables

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
ODD = [(None, None, "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (2, "   \n\t", None, None, None, None), (3, "one two", "en", "s", 7,
    "x"), (3, "one two", "en", "s", 7, "x"), (4, LONG, "en", "s", 1, "x"), (5, LONG, "en", "s", 1, "x"), (6, "é日本́ <|endoftext|> 's x",
    "en", "s", 1, "x"), (None, "a a a a a a a a", "en", "s", 1, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(ORACLES[name]).fetchdf())


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library():
    t, tree, rnd = library(), bpe._tree(bpe.default_path()), random.Random(1)
    kind, _ = tables()
    safe = [chr(i) for i in np.flatnonzero(kind != UNSURE)]
    texts = [x[1] or "" for x in ODD] + ["a" * 5000, "ab" * 3000, "don't we'll 'tis ''s I'M", "Σίσυφος ΣΑΣ İ", "日本語" * 400, "\x1f a\x85b"]
    texts += ["".join(rnd.choice(safe[:700] + list(" 'strevmld") * 30) for _ in range(rnd.randrange(60))) for _ in range(200)]
    texts += ["".join(rnd.choice("thanione") for _ in range(rnd.randrange(100, 3000))) for _ in range(40)]
    ids, bounds = tree.encoder.batch(pa.array(texts))
    for i, x in enumerate(texts):
        want = t.encode(x, add_special_tokens=False).ids
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want
        assert tree.decode(want) == t.decode(want, skip_special_tokens=False)


def test_bpe_rows(odd, none):
    got = bpe.encode_digests(odd, bpe.default_path()).collect()
    assert len(got) == len(ODD) and bpe.encode_digests(none, bpe.default_path()).count() == 0
    empty = next(r for r in got if r["doc_id"] == 1)
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, step in ((1, 5), (1000, 50), (3000, 70_000), (300, 1)):
        ends = np.cumsum(rng.integers(1, step + 1, n))
        code = token_output.EliasFano(token_output.ef_encode(ends, 2))
        assert (code.ends() == ends).all() and all(code.end(i) == ends[i] for i in range(0, n, 13))


def test_token_files(odd, none):
    got = token_output.read_tokens(token_output.write_tokens(odd, bpe.default_path())).collect()
    assert len(got) == len(ODD) and token_output.read_tokens(token_output.write_tokens(none, bpe.default_path())).count() == 0
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got][2:] == sorted(r["doc_id"] for r in got[2:])


def test_sharding(odd, none):
    got = sharding.shard_documents(odd).toPandas()
    assert len(got) == len(ODD) and sharding.shard_documents(none).count() == 0
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert ((got.grown_shard == got["shard"]) | (got.grown_shard == 8)).all()
    assert got[got.doc_id == 3]["shard"].nunique() == 1


def test_sharding_weights(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    share = sharding.assign(rows, "doc_id", [1.0, 2.0, 1.0]).groupBy("shard").count().toPandas().set_index("shard")["count"] / 20_000
    assert abs(share[1] - 0.5) < 0.02


def test_quality_brute(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = quality_rules.quality_digests(spark.createDataFrame(ODD, SCHEMA).select("doc_id",
        "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))).toPandas()
    texts = [x[1] for x in ODD] + list(docs.text)

    def brute(x):
        w = [a for a in re.split(r"[ \t-\r]+", x or "") if a]
        where = {}
        for i in range(len(w) - 2):
            where.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
        seen, again = set(), 0
        for line in (x or "").split("\n"):
            if re.search(r"[^ \t-\r]", line):
                again += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum((x or "").count(c) for c in "#*$%&|<>"), again, len(covered)

    assert Counter(brute(x) for x in texts) == Counter(map(tuple, got[["n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words"]].values.tolist()))


def test_quality_rules(odd, none):
    assert quality_rules.line_fails("Home » About » Contact » Login") == "navigation"
    assert quality_rules.line_fails("a# b# c# d#") == "symbols"
    assert quality_rules.line_fails("All rights reserved.") == "boilerplate"
    assert quality_rules.line_fails("A plain sentence with some words in it.") is None
    assert quality_rules.line_fails("words on a line of over twelve words with one [a] note in brackets") is None
    assert quality_rules.line_fails("一 二 三 四 五 六 七 八 九 十 百，千 万") is None
    assert quality_rules.line_fails("it's a line of over twelve words that ends without a mark of any kind") == "punctuation"
    assert quality_rules.line_fails("The privacy policy of the council was debated in the hall today.") is None
    assert quality_rules.line_fails("Please read our privacy policy and our terms of use.") == "boilerplate"
    assert quality_rules.clean_documents(odd).columns == odd.columns and quality_rules.clean_documents(none).count() == 0


def test_decontamination(spark, odd, none):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + item.upper() + " y"), (2, " ".join(item.split()[:12])), (3, "foo Short-Item bar"), (4, None),
        (4, None), (5, " ".join(f"z{i}" for i in range(900)) + " " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (None, "..."), (1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.decontamination_report(docs, bench).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (20, 1, True)
    assert got[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert got[2]["n_hit"] == 0 and got[3]["n_hit"] == 2 and got[4]["n_words"] == 0
    assert got[5]["n_hit"] == 20 and not got[5]["contaminated"]
    assert sorted(r["doc_id"] for r in decontamination.remove_contaminated(docs, bench).collect()) == [2, 4, 4, 5]
    assert decontamination.decontamination_report(none, bench).count() == 0
    assert decontamination.decontamination_report(odd, bench.limit(0)).where("contaminated").count() == 0


def test_chat(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, "cy", "yo"), (1, 2, "cy", "yo"), (1, None, None, "z"), (2, 0, "system", "s"),
        (None, 0, "ann", "q")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    assert len(got) == 5 * 4 + 1
    for (_, _), g in got.groupby(["conv_id", "perspective"], dropna=False):
        g = g.sort_values("place")
        text = "".join(g.segment)
        assert list(g.place) == list(range(len(g))) and all(text[a:b] == s for a, b, s in zip(g.start, g.stop, g.segment, strict=True))
    assert chat_format.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_near_dedup(spark, odd, none):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    near = base.copy()
    near[100] = "changed"
    far = [f"v{rng.randrange(5000)}" for _ in range(150)] + base[:150]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base)), (5, None), (6, ""),
        (7, "a b"), (8, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.groups(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5, 7: 7, 8: 7}
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect()) == [1, 3, 5, 7]
    assert near_dedup.keep_one(odd).columns == odd.columns
    assert near_dedup.keep_one(odd).count() == 5
    assert near_dedup.groups(none).count() == 0


def test_near_dedup_recall(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    cls = {r["doc_id"]: r["class_id"] for r in near_dedup.groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    g, b = near_dedup.shingles(*hashed_words(pa.array(docs.text)))
    for i in range(len(docs)):
        for j in range(i):
            if near_dedup.similarity(g[b[i] : b[i + 1]], g[b[j] : b[j + 1]]):
                assert cls[docs.doc_id[i]] == cls[docs.doc_id[j]]


def test_near_dedup_template_family(spark):
    """Texts of one template at about 0.7, some pairs at 0.8: pairs whose texts follow other leaders are found too."""
    rng = random.Random(5)

    def edited(words, k, tag):
        words = list(words)
        for at in rng.sample(range(len(words)), k):
            words[at] = f"{tag}x{at}"
        return words

    texts = [edited([f"t{i}" for i in range(300)], rng.randint(4, 7), f"a{i}") for i in range(580)]
    texts += [edited(texts[rng.randrange(580)], rng.randint(5, 6), f"c{i}") for i in range(20)]
    texts = [" ".join(t) for t in texts]
    g, b = near_dedup.shingles(*hashed_words(pa.array(texts)))
    cls = {r["doc_id"]: r["class_id"] for r in near_dedup.groups(spark.createDataFrame(list(enumerate(texts)),
        "doc_id long, text string")).collect()}
    pairs = [(i, j) for i in range(600) for j in range(i + 1, 600) if near_dedup.similarity(g[b[i] : b[i + 1]], g[b[j] : b[j + 1]])]
    assert len(pairs) == 678 and all(cls[i] == cls[j] for i, j in pairs)


def test_lm(spark, odd, none):
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_scoring.score(odd, odd).collect()}
    words = lambda x: [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda a: a.group().lower(), x or "")) if w] + ["\0"]
    c = Counter(w for x in ODD for w in words(x[1]))
    n, v = sum(c.values()), len(c)
    for x in ODD:
        r = got[x[0], len(words(x[1]))]
        assert r["train_tokens"] == n and r["n_known"] == r["n_tokens"]
        assert abs(r["base_score"] - sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(x[1]))) < 1e-6
    assert lm_scoring.score(none, none).count() == 0 and lm_scoring.score(odd, none).count() == len(ODD)


def test_units_keep_digits_among_letters():
    assert toxicity.units("1d10t st0-p1d 2024 7") == ["1d10t", "st0p1d"]


def test_hot_keys_are_split(spark, monkeypatch):
    """Many copies of texts with and without hits, beside others: the same result with every shortcut off."""
    from cardloom.llm import common

    item = " ".join(f"w{i}" for i in range(20))
    rows = [(i, ("hot " + item, "hot clean text", f"rare {i} {item}", f"clean {i}")[i % 4]) for i in range(200)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    found = lambda: (sorted(map(tuple, decontamination.decontamination_report(docs, bench).collect())),
        sorted(r["doc_id"] for r in decontamination.remove_contaminated(docs, bench).collect()))
    want = found()
    monkeypatch.setattr(common, "HEAVY", 10)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert found() == want and want[1] == [i for i in range(200) if i % 2]


def test_lm_learns_alike_for_any_partition_count(spark):
    from pyspark.sql import functions as F

    docs, means = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    for n in (1, 8, 64):
        rows = docs.repartition(n)
        found = lm_scoring.score(rows, rows.where(~held)).where(held)
        model, base = found.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
        means.append(model)
        assert model > base + 0.1
    assert max(means) - min(means) < 0.015


def test_lm_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b a", 1, "x", 2.0), (2, None, 1, "x", 2.0)],
        "doc_id long, text string, row int, h string, model double")
    assert sorted((r["doc_id"], r["n_tokens"], r["train_tokens"]) for r in lm_scoring.score(docs, docs).collect()) == [(1, 4, 5), (2, 1, 5)]


def test_lm_normalised():
    """Over all classes a context's probabilities sum to one, and so do the shares within a class with one unseen word."""
    rng = np.random.default_rng(0)
    v = 40
    unigram = rng.random(v) + 0.01
    lm = lm_scoring.LogBilinear((unigram / unigram.sum()).astype(np.float32))
    lm.train((rng.integers(0, v + 1, 64), rng.integers(0, v + 1, 64), rng.integers(0, v, 64)) for _ in range(20))
    for two, one in ((0, 0), (v, v), (3, 17)):
        assert abs((10.0 ** lm.log10_of(np.full(v, two), np.full(v, one), np.arange(v))).sum() - 1) < 1e-4


def test_lm_tables():
    """Log-probabilities from the tables made once equal a plain softmax of each context in doubles, even where no class is likely
    after both tokens, and sums of gradients by class equal a plain loop's."""
    rng = np.random.default_rng(3)
    v, n = 30, 500
    lm = lm_scoring.LogBilinear(np.full(v, 1 / v, np.float32))
    two, one, w = rng.integers(0, v + 1, n), rng.integers(0, v + 1, n), rng.integers(0, v, n)
    for scale in (1, 60):
        lm.flat[:] = rng.normal(0, scale, len(lm.flat)).astype(np.float32) if scale == 1 else lm.flat * np.float32(scale)
        logits = (lm.r.astype(float)[two] @ lm.c1 + lm.r.astype(float)[one] @ lm.c2) @ lm.q.T.astype(float) + lm.bias
        top = logits.max(1)
        plain = (logits[np.arange(n), w] - top - np.log(np.exp(logits - top[:, None]).sum(1))) / np.log(10)
        tables = lm.tables()
        got = lm.log10_of(two, one, w, tables)
        assert np.isfinite(got).all() and np.allclose(got, plain, rtol=1e-4) and (got == lm.log10_of(two, one, w)).all()
        assert [t.shape for t in tables] == [(v + 1, v), (v + 1, v), (v + 1, v + 1)]
    rows, sums, loop = rng.normal(size=(n, 16)).astype(np.float32), np.zeros((v, 16), np.float32), np.zeros((v, 16))
    lm_scoring._scatter(sums, w, rows, np.empty((n + 7, 16), np.int64))
    for i, row in zip(w, rows, strict=True):
        loop[i] += row
    assert np.allclose(sums, loop, atol=1e-4)


def test_lm_step_is_that_of_the_plain_formula():
    """The first step goes along the gradient of noise-contrastive estimation, token by token in doubles; steps may vary in size."""
    rng, v, n = np.random.default_rng(4), 23, 90
    unigram = (rng.random(v) + 0.1).astype(np.float32)
    unigram /= unigram.sum()
    lm, was = lm_scoring.LogBilinear(unigram), lm_scoring.LogBilinear(unigram)
    two, one, w = rng.integers(0, v + 1, n), rng.integers(0, v + 1, n), rng.integers(0, v, n)
    assert lm.train([(two, one, w)]) == n
    noise = np.searchsorted(np.cumsum(unigram), np.random.default_rng(1).random(lm_scoring.NOISE) * np.cumsum(unigram)[-1])
    grad = lm_scoring.LogBilinear(unigram, np.zeros(len(was.flat)))
    for a, b, c in zip(two, one, w, strict=True):
        h = was.r[a].astype(float) @ was.c1 + was.r[b].astype(float) @ was.c2
        dh = np.zeros(len(h))
        for k, good in ((c, True), *((k, False) for k in noise)):
            p = 1 / (1 + np.exp(-(h @ was.q[k] + was.bias[k] - np.log(lm_scoring.NOISE * float(unigram[k])))))
            e = (1 - p if good else -p) / n
            grad.q[k] += e * h
            grad.bias[k] += e
            dh += e * was.q[k]
        grad.r[a] += was.c1 @ dh
        grad.r[b] += was.c2 @ dh
        grad.c1 += np.outer(was.r[a], dh)
        grad.c2 += np.outer(was.r[b], dh)
    g = grad.flat
    square = 0.95e-8 + 0.05 * g * g
    assert np.allclose(lm.flat - was.flat, lm_scoring.RATE * g / np.sqrt(square / (1 - 0.95) + 1e-10), atol=1e-4)


def test_lm_parameters_from_another_process_train_as_fast():
    """Parameters that came pickled, as a broadcast's do, train to the same numbers in about the same CPU time (6 times of it before)."""
    rng, v, n = np.random.default_rng(6), 511, lm_scoring.BATCH
    unigram = np.full(v, 1 / v, np.float32)
    steps = [(rng.integers(0, v + 1, n), rng.integers(0, v + 1, n), rng.integers(0, v, n)) for _ in range(40)]
    flat, took, ends = lm_scoring.LogBilinear(unigram).flat, {True: [], False: []}, {}
    for _ in range(5):
        for sent in (True, False):
            lm = lm_scoring.LogBilinear(unigram, pickle.loads(pickle.dumps(flat)) if sent else flat.copy())
            assert (lm.flat.dtype is lm.q.dtype is np.dtype(np.float32)) and (lm.flat == flat).all()
            began = time.process_time()
            lm.train(steps)
            took[sent].append(time.process_time() - began)
            ends[sent] = lm.flat
    assert (ends[True] == ends[False]).all() and min(took[True]) < 2.5 * min(took[False])


def test_lm_learns_and_scores_the_same_text_alike(spark):
    """Words follow each other in pairs; a text in that order is likelier than the same words in another order."""
    rng = random.Random(2)
    pairs = [(f"a{i}", f"b{i}") for i in range(20)]
    texts = [" ".join(w for _ in range(40) for w in rng.choice(pairs)) for _ in range(300)]
    right, wrong = "a1 b1 a2 b2 a3 b3 a4 b4", "b1 a2 b2 a3 b3 a4 b4 a1"
    docs = spark.createDataFrame(list(enumerate([*texts, right, right, wrong])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, docs.where("doc_id < 300")).collect()}
    assert got[300]["score"] == got[301]["score"] > got[302]["score"] and abs(got[300]["base_score"] - got[302]["base_score"]) < 1e-9
    assert got[300]["score"] > got[300]["base_score"]


def brute_shards():
    """Documents, and the shard of a key from md5 and logarithms in Python."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")

    def shard(key, n):
        draws = [(int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(n)]
        return max(range(n), key=lambda i: (1 / -np.log(draws[i]), -i))

    return docs, shard


def test_sharding_equals_brute(spark):
    docs, shard = brute_shards()
    got = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert Counter(zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == Counter((i, len((t or "").encode()) + 1,
        zlib.crc32((t or "").encode())) for i, t in zip(docs.doc_id, docs.text, strict=True))
    assert all(r["shard"] == shard(r.doc_id, 8) and r.grown_shard == shard(r.doc_id, 9) for _, r in got.iterrows())
    block = [int(hashlib.md5(f"{i}|{n}|{c}".encode()).hexdigest()[:8], 16) % sharding.BLOCKS for i, n, c in zip(got.doc_id, got["size"],
        got.text_crc32, strict=True)]
    ordered = got.assign(block=block).sort_values(["shard", "block", "doc_id", "text_crc32", "size"])
    assert (ordered.groupby("shard").cumcount() == ordered.slot).all()


def test_token_files_equal_library(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").head(60)
    t, start = library(), 0
    got = token_output.read_tokens(token_output.write_tokens(spark.createDataFrame(docs), bpe.default_path()),
        with_ids=False).toPandas().set_index("doc_id")
    for i, x in zip(docs.doc_id, docs.text, strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        row = got.loc[i]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_string_kernel_equals_naive():
    """The explicit features' product is the sum over all pairs of equal triples, in any alphabet and over the whole part."""
    from itertools import combinations

    def naive(a, b):
        def triples(w):
            w = "\0" + w
            return [(w[i] + w[j] + w[k], 0.5 ** (k - i - 2)) for i, j, k in combinations(range(len(w)), 3)]

        x, y = triples(a), triples(b)
        return sum(p * q for s, p in x for t, q in y if s == t) / np.sqrt(sum(p * p for _, p in x) * sum(q * q for _, q in y))

    words = ["idiot", "id-iot".replace("-", "x"), "ünïcödé", "日本語テキスト", "abcdefghijklmno"]
    letters = {c: i + 1 for i, c in enumerate(sorted({c for w in words for c in w}))}
    w, ids, v = toxicity.phi(words, letters)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = ({t: 0.0 for t in ids} for _ in range(2))
            for own, n in ((x, i), (y, j)):
                for t, value in zip(ids[w == n], v[w == n], strict=True):
                    own[t] += float(value)
            assert abs(sum(x[t] * y[t] for t in x) - naive(a, b)) < 1e-5


def test_toxicity_reads_all_parts():
    """An insult after the fifteenth letter of a joined unit is learnt and found."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ta", "ne", "ri", "so", "lu", "mo", "ke"]) for _ in range(rng.randrange(1, 4)))
    joined = lambda: "".join(word() for _ in range(12))[:20]
    bags = [toxicity.units(" ".join([word() for _ in range(50)] + [joined() + ("grobblex" if i % 5 == 0 else "lumotane")])) for i in range(300)]
    model = toxicity.fit(bags, np.array([i % 5 == 0 for i in range(300)]))
    s = model.scores(["ta ne " + joined() + "grobblex", "ta ne " + joined() + "lumotane"])
    assert s[0] > 0.5 > s[1]


@pytest.mark.parametrize("before", ["<svg class=i />", "<iframe src=a />", "<template-card>x</template-card>",
    "<style-guide>x</style-guide>", "<svg>", "<SCRIPT>if (a<b) {'</p>'}</SCRIPT >", "<!-- <p>no --> <!---->",
    "<textarea><p>no</textarea>", "<style>p{}</style>"])
def test_html_keeps_the_article(before):
    got = html_extract.blocks(f"<body>{before}<article><h1>T</h1><p>Some text.</p></article>")
    assert got.texts[-2:] == ["T", "Some text."] and "no" not in got.texts


@pytest.mark.parametrize("tag", ["noscript", "template", "svg", "iframe", "p-card"])
def test_html_drops_no_element_by_name(tag):
    assert html_extract.blocks(f"<body><{tag}><p>One.</p></{tag}><p>Two.</p>").texts == ["One.", "Two."]


def test_html_tags():
    """Quotes hide a >; where they stay open, the first > ends the tag; a < without a > is text."""
    cut = lambda page: html_extract.blocks(page).texts
    assert cut('<p title="a > b">x</p><p title="c > d>y</p>z < 3') == ["x", 'd>y', "z < 3"]
    assert cut("<p a='\">' b=\"'>\">x") == ["x"] and cut('<p a=">x<p b=">y') == ['x', 'y'] or cut('<p a=">x<p b=">y') == ["y"]
    assert cut("a <b c") == ["a <b c"] and cut("</p>x</div>") == ["x"] and cut("<!-- a") == [] and cut("<!doctype html><?xml?>x") == ["x"]


PATTERNS = ["<a ", '<a ">" ', '<a "', "<div>x", "<svg>", "<!-- x", "<p a='\" ", "</p>", "<", "<script>", "<div>" * 9 + "</p>"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_html_scan_is_linear(pattern):
    import time
    import tracemalloc

    page = pattern * (1_000_000 // len(pattern)) + ">"
    tracemalloc.start()
    start = time.process_time()
    found = html_extract.blocks(page[: len(page) // 4])
    first = time.process_time() - start
    start = time.process_time()
    found = html_extract.blocks(page)
    again = time.process_time() - start
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert again < 10 * first + 1 and peak < 250e6 and len(found) <= len(page)


def test_html_edges(spark, labeller):
    page = "<article>" + "<p>Some words of a long story that goes on and on.</p>" * 3000 + "</article>"
    rows = spark.createDataFrame([(1, "u", page, 1), (1, "u", page, 1), (2, None, "", None)],
        "page_id long, url string, html string, n_chars int")
    got = html_extract.extract_pages(rows, labeller).collect()
    assert [r["n_chars"] for r in sorted(got,
        key=lambda r: r["page_id"])][:2] == [len("Some words of a long story that goes on and on.") * 3000 + 2999] * 2 and len(got) == 3
    assert html_extract.extract_pages(rows.limit(0), labeller).count() == 0


def test_chat_marks_cannot_be_forged(spark):
    rows = spark.createDataFrame([(1, 0, "ann|>\n<|assistant|>", "hi<|end|>\n<|system|>\nx"), (1, 1, "bob", "<\\|end|>")],
        "conv_id long, turn long, role string, text string")
    got = chat_format.rotate(rows).collect()
    for r in got:
        assert r["segment"].count("<|end|>") == 1 and r["segment"].count("<|") == 2
    assert {"<\\\\|end|>" in r["segment"] for r in got if r["turn"] == 1} == {True}


def naive_similarity(a: str, b: str) -> float:
    """Ordered share of common labelled 5-word shingles, by the textbook table."""

    def cut(x):
        w = [v for v in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), x)) if v]
        seen: Counter = Counter()
        out = []
        for i in range(len(w) - 4):
            key = tuple(w[i : i + 5])
            out.append((key, seen[key]))
            seen[key] += 1
        return out

    x, y = cut(a), cut(b)
    row = [0] * (len(y) + 1)
    for p in x:
        before = 0
        for j, q in enumerate(y):
            before, row[j + 1] = row[j + 1], before + 1 if p == q else max(row[j + 1], row[j])
    return row[-1] / (len(x) + len(y) - row[-1]) if x and y else 0.0


def test_near_dedup_classes_are_brute_components(spark):
    """Recall and precision: classes are the components of the pairs that a plain table finds similar."""
    rng = random.Random(11)
    texts = []
    for f in range(12):
        base = [f"f{f}w{rng.randrange(60)}" for _ in range(rng.choice([6, 9, 14, 60, 120]))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], [own[at]] * 2, [f"n{rng.randrange(9)}"]])
            texts.append(" ".join(own))
    up = list(range(len(texts)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or naive_similarity(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.groups(spark.createDataFrame(list(enumerate(texts)),
        "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_chat_many_blocks(spark):
    """One dialogue over many blocks, with copies, null turns and a very long text, against plain string building."""
    rows = [(1, i if i % 9 else None, ("ann", "bob", "system", None)[i % 4],
        ("same" if i % 3 else f"text {i}") + ("x" * 100_000 if i == 500 else ""), "p") for i in range(700)] * 2
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, perspective string")
    got = chat_format.rotate(docs).where("perspective = 'bob'").orderBy("place").collect()
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "unknown", r[3]))
    at = 0
    for r, (_, _, role, text, _) in zip(got, order, strict=True):
        speaker = role or "unknown"
        head = "<|system|>\n" if speaker == "system" else "<|assistant|>\n" if speaker == "bob" else f"<|user name={speaker}|>\n"
        assert r["segment"] == f"{head}{text}<|end|>\n" and (r["start"], r["stop"]) == (at, at + len(r["segment"]))
        at = r["stop"]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, b"x", 2, 3, 4, "y"), (1, "a b c", 1, b"x", 2, 3, 4, "y"), (2, "d e", 1, b"x", 2, 3, 4,
        "y")], "doc_id long, text string, id int, node binary, own_node int, key int, input_ids int, decoded string")
    assert near_dedup.keep_one(docs).columns == docs.columns and near_dedup.keep_one(docs).count() == 2
    bench = spark.createDataFrame([(7, "d e")], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.remove_contaminated(docs, bench).collect()] == [1, 1]
    assert bpe.encode_documents(docs, bpe.default_path()).columns == [*docs.columns, "input_ids_", "decoded_"]


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Null, empty and blank texts, repeated rows and a clashing column, through each later stage by itself."""
    import corpus_pipeline as P

    key = lambda r: (r["doc_id"], r["text"])
    want = Counter((r[0], r[1]) for r in ODD)
    for name in ("toxicity", "decontamination"):
        kept = dict(P.STAGES)[name](spark, odd, SF)
        assert kept.columns == odd.columns and Counter(map(key, kept.collect())) == want
    one = dict(P.STAGES)["near_dedup"](spark, odd, SF)
    assert one.columns == odd.columns and Counter(map(key, one.collect())) == Counter({(1, ""): 1, (3, "one two"): 1, (4, LONG): 1, (6,
        ODD[7][1]): 1, (None, ODD[8][1]): 1})
    coded = dict(P.STAGES)["bpe"](spark, odd, SF).collect()
    assert len(coded) == len(ODD) and all((r["n_tokens"] == 0) == (r["ids_sha256"] == hashlib.sha256(b"").hexdigest()) for r in coded)
    assert sum(r["n_tokens"] == 0 for r in coded) == 3


def test_pipeline_edges(spark, tmp_path):
    """Null, empty, repeated and no rows go through all stages."""
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, good, "en", "s", 1), (2, good, "en", "s", 1), (3, good, None, None,
        None)]
    for name, made in (("some", rows), ("none", [])):
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    assert c.quality_stage(spark, docs, f"{tmp_path}/some").count() == 3
    assert c.dedup_stage(spark, c.quality_stage(spark, docs, f"{tmp_path}/some"), f"{tmp_path}/some").count() == 1
    assert c.run(spark, f"{tmp_path}/none").count() == 0


def test_toxicity():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ta", "ne", "ri", "so", "lu", "mo", "ke"]) for _ in range(rng.randrange(1, 4)))
    bags = [toxicity.units(" ".join([word() for _ in range(60)] + (["grobble", "snarfit"] if i % 6 == 0 else []))) for i in range(240)]
    labels = np.array([i % 6 == 0 for i in range(240)])
    model = toxicity.fit(bags, labels)
    s = model.scores(["ta ne riso grobble and snarfit lumo", "ta ne riso gro-bb-le, s.narfit lumo", "ta ne rixso lumo keke", ""])
    assert s[0] > 0.5 and s[1] > 0.5 and s[2] < 0.3 and s[3] < 0.3
    assert toxicity.fit([], np.array([])).scores([""])[0] == 0.5
    assert "stupid" in toxicity.units("you s t u p i d one")


def test_toxicity_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score_documents(odd, model).count() == len(ODD) and toxicity.drop_toxic(none, model).count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


@pytest.fixture(scope="module")
def labeller():
    return html_extract.train(300, 8)


def test_html(spark, labeller):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>Some  text<br>of the <b>story</b> goes on here.<p>More of it is told in this part.</p></article><div class=\"ad\">Buy now.</div><footer>&copy; us</footer>"
    assert html_extract.extract(labeller, [page, "", "<p",
        "<!-- x"]) [0] == "A & B Some text of the story goes on here. More of it is told in this part."
    rows = spark.createDataFrame([(1, "u", page, 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    got = html_extract.extract_pages(rows, labeller).collect()
    assert sorted(r["n_chars"] for r in got)[0] == 0 and len(got) == 2


def test_pipeline_columns(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        out = c.written(stage(spark, docs, SF), "t")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert c.STAGES[-1][1](spark, docs, SF).count() == docs.count()
