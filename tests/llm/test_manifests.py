"""The filter audit, the Merkle manifest and SentencePiece encoding against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
from conftest import SF

from cardloom.llm import filter_audit, merkle, piece_encoding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask string, grp string, id string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
PROSE = " ".join(f"w{i}" for i in range(60))
ODD = [
    (None, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "  \n\t", None, None, None), (3, "one two", "en", "", 7), (3, "one two", "en",
        "", 7),
    (4, LONG, "en", "s", 1), (5, LONG, "en", "t", 1), (6, "é日本 Ab#\nc", "en", "t", 1), (None, "a a a", "en", "t", 1), (None, "a a a",
        "en", "t", 1),
    (7, PROSE, "en", "s", 3), (8, PROSE, "de", "t", 3), (9, PROSE + "\n", None, None, 3), (10, "A " * 80, "en", "é", -5), (3,
        "another text\nof id 3", "en", "s", 7),
]
ODD = [(*r, "x", "y", "z") for r in ODD]
LABELS = [(7, 1, 0), (8, 1, 1), (10, 0, 1), (10, 1, 0), (None, 1, 1), (4, None, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def audit_brute(docs, labels):
    """Every order run over every document."""
    tests = {
        "A": lambda t, w: len(w) < 50,
        "B": lambda t, w: 100 * len(set(w)) < 65 * len(w),
        "C": lambda t, w: 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
        "D": lambda t, w: bool(set(t) & set("#$%&*|")),
    }
    least: dict[str, int] = {}
    for doc_id, t, _ in docs:
        if doc_id is not None:
            least[t or ""] = min(doc_id, least.get(t or "", doc_id))
    facts = []
    for doc_id, t, source in docs:
        t = t or ""
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        fails = {k for k, f in tests.items() if f(t, w)} | ({"E"} if doc_id is not None and doc_id > least[t] else set())
        mine = [x for x in labels if doc_id is not None and x[0] == doc_id]
        facts.append((source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {f[0] for f in facts}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [f for f in facts if f[0] == part]
            gone = []
            for step, k in enumerate(order, 1):
                lost = [f for f in left if k in f[1]]
                left = [f for f in left if k not in f[1]]
                shapley[k] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), sum(k in f[1] for f in gone),
                    sum(f[1] == {k} for f in left + lost + gone), sum(f[2] for f in lost), sum(f[3] for f in lost)]
                gone += lost
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_running_every_order(spark, odd, none):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    names = ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    got = {tuple(r[:3]): list(r[3:]) for r in filter_audit.audit(odd, labels).select(names).collect()}
    want = audit_brute([(r[0], r[1], r[3]) for r in ODD], LABELS)
    assert len(got) == 4 * 600 and got == want
    assert filter_audit.audit(none, labels).count() == 0


def test_lattice_of_other_sizes(spark):
    masks = spark.createDataFrame([("p", 0b101, 2, 1, 0), ("p", 0b010, 1, 0, 1), ("p", 0, 4, 2, 0)],
        "part string, mask int, n long, good long, toxic long")
    edges = filter_audit.lattice_edges(masks, 3).collect()
    assert len(edges) == 12 and filter_audit.order_steps(spark, "XYZ").count() == 18
    first = next(r for r in edges if r["applied"] == 0 and r["next"] == 0)
    assert (first["kept"], first["removed"], first["unique_fails"], first["good_lost"]) == (5, 2, 0, 1)
    assert {r["next"]: r["shapley"] for r in edges} == {0: 6, 1: 6, 2: 6}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_brute(leaves):
    """The root and, for every leaf, what stands left and right of its ancestors."""
    paths, nodes, own = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        for i, o in enumerate(own):
            run = nodes[o // 3 * 3 :][:3]
            paths[i].append(("".join(run[: o % 3]), "".join(run[o % 3 + 1 :])))
            own[i] = o // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def manifest_brute(docs):
    leaf = lambda r, t: h(cell(r["doc_id"]), cell(r["source"]), cell(r["lang"]), cell(r["n_chars"]), cell(t))
    groups = {}
    for r in docs:
        groups.setdefault(r["source"], []).append(r)
    built = []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r) for r in groups[s]), key=lambda x: x[:3])
        built.append((rows, *tree_brute([x[2] for x in rows])))
    root, tops = tree_brute([b[1] for b in built])
    out = Counter()
    for (rows, sub, paths), top in zip(built, tops, strict=True):
        for (_, _, mine, r), path in zip(rows, paths, strict=True):
            text, path = r["text"], path + top
            if text is not None and zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = leaf(r, text)
            for a, b in path:
                fold = h(a, fold, b)
            out[r["doc_id"], mine, sub, root, h(*[a + b for a, b in path]), fold, fold == root] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("shards", [None, 1, 2, 7])
def test_manifest_equals_brute(spark, odd, shards):
    rnd = random.Random(5)
    rows = [(i, f"text\n{i % 50}", "en", rnd.choice(["a", "a", "a", "b", "é", None, ""]), i % 7, "x", "y", "z") for i in range(400)]
    docs = odd.union(spark.createDataFrame(rows, SCHEMA)) if shards != 1 else odd
    got = Counter(map(tuple, merkle.verified(merkle.manifest(docs, shards)).select(COLUMNS).collect()))
    want = manifest_brute([r.asDict() for r in docs.collect()])
    assert got == want and 0 < sum(n for r, n in got.items() if not r[-1])


def test_manifest_edges(spark, none):
    assert merkle.verified(merkle.manifest(none)).count() == 0
    (one,) = merkle.verified(merkle.manifest(spark.createDataFrame([ODD[0]], SCHEMA))).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["verified"] and one["proof_sha256"] == h()
    many = spark.createDataFrame([(5, "t\n", "en", "s", 1, "", "", "")] * 100, SCHEMA)  # one row, repeated
    got = Counter(map(tuple, merkle.verified(merkle.manifest(many, 4)).select(COLUMNS).collect()))
    assert got == manifest_brute([r.asDict() for r in many.collect()])


def test_stack_merges_from_any_cut():
    leaves = [h(str(i)) for i in range(100)]
    for cuts in ([0, 100], [0, 1, 2, 50, 100], [0, 26, 28, 83, 100], list(range(101))):
        nodes, peaks = {}, set()
        for a, b in zip(cuts, cuts[1:], strict=False):
            stack = merkle.MountainRange(a, 100)
            found = [r for x in leaves[a:b] for r in stack.push(x)] + stack.close()
            nodes |= {r[:2]: r[2] for r in found}
            peaks |= {r[:2] for r in found if r[3]}
        level = leaves
        for k, size in enumerate(merkle.level_sizes(100)):
            assert len(level) == size and all(level[i] == d for (q, i), d in nodes.items() if q == k)
            level = [h(*level[i : i + 3]) for i in range(0, size, 3)]
        covered = Counter(i for k, j in peaks for i in range(j * 3**k, min(100, (j + 1) * 3**k)))
        assert set(covered) == set(range(100)) and set(covered.values()) == {1}


PIECES = [None, "", " ", "  ", "a ", "a  ", " a", "  a  b ", "▁x", "x▁", "▁", "a▁ b", "\n", " \n x", "a\x00b", "日本 語",
    "x<0x0A>y <s> </s> <unk>", "　x", "\t", "\U0010ffff é é", "x" * 100_000, "ab " * 20_000, " " * 5000, LONG]


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_encoding.default_path())


@pytest.mark.parametrize("cuts", [True, False])
def test_pieces_equal_library(cuts, monkeypatch):
    monkeypatch.setattr(piece_encoding, "TABLE_CHUNKS", 100)  # the table starts anew often
    known, sp, rnd = piece_encoding.ChunkTable(piece_encoding.default_path()), library(), random.Random(2)
    assert known.cuts
    known.cuts = cuts
    texts = PIECES + ["".join(rnd.choice("  ▁\n\tabcdeABC019.,é日本ñß  😀<s>") for _ in range(rnd.randrange(40))) for _ in range(800)]
    for at in range(0, len(texts), 60):
        col = pa.array(texts[at : at + 60], pa.string())
        ids, bounds = known.encode(col)
        count, decimal, decoded = known.texts(col)
        for i, x in enumerate(texts[at : at + 60]):
            want = sp.encode(x or "")
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want and count[i] == len(want)
            assert decimal[i] == ",".join(map(str, want)) and decoded[i] == sp.decode(want)


def test_piece_rows(spark, odd, none):
    path, sp = piece_encoding.default_path(), library()
    got = Counter(map(tuple, piece_encoding.encode_digests(odd, path).collect()))
    want = Counter((r[0], len(ids), h(",".join(map(str, ids))), h(sp.decode(ids))) for r in ODD for ids in [sp.encode(r[1] or "")])
    assert got == want and piece_encoding.encode_digests(none, path).count() == 0
    clash = odd.withColumnRenamed("id", "decoded")
    full = piece_encoding.encode_documents(clash, path)
    assert full.columns == [*clash.columns, "input_ids", "decoded_"]
    assert all(r["input_ids"] == sp.encode(r["text"] or "") and r["decoded_"] == sp.decode(r["input_ids"]) for r in full.collect())


def test_piece_query_equals_library(spark):
    sp = library()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((d, len(ids), h(",".join(map(str, ids))), h(sp.decode(ids))) for d, t in docs for ids in [sp.encode(t or "")])
    assert Counter(map(tuple, piece_encoding.op13_distinct_chunks(spark, SF).collect())) == want
