"""Signals of three sources, pages of a listing, counts by year, reviews by content, and places in order."""

import json
import random
from datetime import datetime

import pytest

from cardloom.operators import ordinal, review_cache, reviews, year_counts
from cardloom.operators import training_signals as T
from cardloom.operators.selection import Selection
from cardloom.sources import pages, snapshots

LONG_RUN = "The training took 40 hours on 2 H100 GPUs."  # 80 GPU hours
BULK_RUN = "Training took 5 hours on 2x H100 GPUs."
OWN_DATA = "We trained this network from scratch on our archive."
PLAIN = "A short note without numbers."


def wants(spark, *rows):
    return spark.createDataFrame(rows, "repo_id string, card_data string, wants_compute boolean, wants_claim boolean")


def cards(spark, *rows):
    return spark.createDataFrame(rows, "modelId string, createdAt string, card string, place long")


def seen(found):
    return {r["modelId"]: (r["compute"] and (r["compute"]["source"], r["compute"]["gpu_hours"]), r["claim"] and (r["claim"]["source"],
        r["claim"]["evidence_type"])) for r in found.collect()}


def test_precedence_of_sources(spark):
    hours, scratch = json.dumps({"training_hours": 3}), json.dumps({"about": OWN_DATA})
    models = wants(
        spark, ("o/meta", hours, True, False), ("o/both", hours, True, False), ("o/denied", scratch, False, True), ("o/no-card", scratch,
            False, True), ("o/readme", None, True, True),
        ("o/half", hours, True, True), ("o/settled", json.dumps({"training_hours": 3, "about": OWN_DATA}), True, True), ("o/none", "[1]",
            False, False), ("o/bad", "{", True, True), ("o/unasked", hours, False, True),
    )
    bulk = cards(spark, ("o/both", "2024-01-01", BULK_RUN, 1), ("o/denied", "2024-01-01", PLAIN, 2), ("o/settled", "2024-01-01", PLAIN,
        3), ("o/half", "2024-01-01", BULK_RUN, 4), ("o/no-card", "2024-01-01", "", 5), ("else/x", "2024-01-01", OWN_DATA, 6))
    texts = spark.createDataFrame([(m, f"{LONG_RUN} {OWN_DATA}") for m in ("o/readme", "o/half", "o/settled", "o/none", "o/both")],
        "repo_id string, readme string")
    got = seen(T.resolved(models, bulk, texts))
    meta, card, readme = ("cardData", 3.0), (T.BULK, 10.0), (T.README, 80.0)
    assert got["o/meta"] == (meta, None) and got["o/both"] == (card, None)
    assert got["o/denied"] == (None, None)  # the whole card was read and says nothing
    assert got["o/no-card"] == (None, ("cardData", "explicit_scratch"))
    assert got["o/readme"] == (readme, (T.README, "explicit_scratch"))
    assert got["o/half"] == (readme, (T.README, "explicit_scratch"))  # what is read for the claim tells of compute, too
    assert got["o/settled"] == (meta, None)  # metadata left nothing open, so no readme is read
    assert "o/none" not in got and got["o/bad"] == (None, None) and got["o/unasked"] == (None, None)
    assert seen(T.resolved(models))["o/meta"] == (meta, None) and T.resolved(models.limit(0), bulk, texts).count() == 0


def test_first_card_of_a_fingerprint_may_be_anyones(spark):
    """An older card of a model that nobody asks for dates the claim and the run; metadata and readmes have no date."""
    models = wants(spark, ("late/copy", None, True, True), ("o/meta", json.dumps({"training_hours": 3}), True, False))
    text = f"{OWN_DATA} {BULK_RUN}"
    rows = {r["modelId"]: r for r in T.resolved(models, cards(spark, ("first/one", "2021-05-01", text, 1), ("late/copy", "2023-05-01",
        text, 2))).collect()}
    assert rows["late/copy"]["compute"]["earliest"] == rows["late/copy"]["claim"]["earliest"] == "2021-05-01"
    assert rows["o/meta"]["compute"]["earliest"] is None
    claims = T.resolved(wants(spark, ("late/copy", None, False, True)), cards(spark, ("first/one", "2021-05-01", text, 1), ("late/copy",
        "2023-05-01", text, 2))).first()
    assert claims["compute"] is None and claims["claim"]["earliest"] == "2021-05-01"


@pytest.mark.parametrize("order", [(1, 2), (2, 1)])
def test_last_card_counts(spark, order):
    models = wants(spark, ("o/a", None, True, True))
    rows = cards(spark, ("o/a", "2024-01-01", f"{BULK_RUN} {OWN_DATA}", order[0]), ("o/a", "2024-01-01", PLAIN, order[1]))
    compute, claim = seen(T.resolved(models, rows))["o/a"]
    assert compute == (T.BULK, 10.0)  # the last card that tells of compute
    assert (claim is None) == (order == (1, 2))  # the last card, also if it claims nothing


def test_signals_of_card_shards(spark, tmp_path):
    """Shards as they land: three of their columns are read, and the last row of the last shard counts."""
    fields = "modelId string, createdAt string, card string, unused string"
    first = [("o/a", "2024-01-01", f"{BULK_RUN} {OWN_DATA}", "u"), ("o/b", "2024-01-01", OWN_DATA, "u"), ("x/y", "2020-01-01", OWN_DATA, "u")]
    for n, rows in enumerate((first, [("o/a", "2024-02-01", PLAIN, "u"), ("o/b", "2024-02-01", "", "u")])):
        spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/{snapshots.shard_paths('cards.parquet', 2)[n]}")
    shards = snapshots.placed_cards(spark, *[f"{tmp_path}/{p}" for p in snapshots.shard_paths("cards.parquet", 2)])
    assert "unused" not in shards.columns and "unused" not in shards._jdf.queryExecution().executedPlan().toString()
    rows = {r["modelId"]: r for r in T.resolved(wants(spark, ("o/a", None, True, True), ("o/b", None, True, True)), shards).collect()}
    assert rows["o/a"]["compute"]["gpu_hours"] == 10 and rows["o/a"]["claim"] is None
    assert rows["o/b"]["claim"]["earliest"] == "2020-01-01"  # the blank row says nothing, the older card of another dates it


@pytest.mark.parametrize("bytes_", ["64", "100000000"])
def test_last_wins_however_files_are_split(spark, tmp_path, bytes_):
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
    try:
        lines = [json.dumps({"key": f"k{i % 7}", "review": {"kind": "merge", "confidence": "low", "reason": str(i)}}) for i in range(60)]
        (tmp_path / "a.jsonl").write_text("\n".join(lines[:30]) + "\n")
        (tmp_path / "b.jsonl").write_text("\n".join(lines[30:]) + "\n")
        got = {r["key"]: r["review"]["reason"] for r in reviews.latest(spark, str(tmp_path)).collect()}
        assert got == {f"k{i}": str(max(j for j in range(60) if j % 7 == i)) for i in range(7)}
        for n, low in ((0, 0), (1, 40)):
            spark.createDataFrame([(f"m{i % 9}", "t", str(low + i)) for i in range(40)],
                "modelId string, createdAt string, card string").coalesce(1).write.parquet(f"{tmp_path}/cards-{n:04d}")
        got = {r["modelId"]: r["card"] for r in snapshots.latest_cards(spark, f"{tmp_path}/cards-0000", f"{tmp_path}/cards-0001").collect()}
        assert got == {f"m{i}": str(40 + max(j for j in range(40) if j % 9 == i)) for i in range(9)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def listing(spark, folder, *each):
    for number, items, following in each:
        (folder / f"page-{number:05d}.json").write_text(json.dumps({"items": [{"id": i, "created_at": d} for i, d in items],
            "next": following}))
    return pages.read_pages(spark, str(folder), spark.createDataFrame([], "id string, created_at string").schema)


def test_how_far_a_scan_goes(spark, tmp_path):
    new, mid, old, odd = ("a", "2025-03-01T00:00:00Z"), ("b", "2024-03-01T00:00:00Z"), ("c", "2022-03-01T00:00:00Z"), ("d", "no date")
    folder = lambda n: (tmp_path / n).mkdir() or tmp_path / n
    far = listing(spark, folder("far"), (1, [new, odd], "2"), (2, [mid, old], "3"), (3, [new], "4"), (4, [], ""))
    assert pages.extent(far, 2024) == pages.Extent(2, True)
    assert pages.extent(far, 2024, max_pages=2) == pages.Extent(2, False)  # the limit goes first
    assert pages.extent(far, 2024, max_pages=1) == pages.Extent(1, False)
    assert pages.extent(far, 2020) == pages.Extent(3, True)  # before the empty page
    assert pages.extent(far, 2020, max_pages=3) == pages.Extent(3, False)
    rows, found = pages.scanned(far, [2024, 2025])
    assert sorted((r["id"], r["page"], r["year"]) for r in rows.collect()) == [("a", 1, 2025), ("b", 2, 2024)] and found.complete
    last = listing(spark, folder("last"), (1, [new], "2"), (2, [new], None))
    assert pages.extent(last, 2020) == pages.Extent(2, True)
    gap = listing(spark, folder("gap"), (1, [new], "2"), (3, [old], ""))
    (tmp_path / "gap" / "page-00002.json").write_text("{broken")
    assert pages.extent(gap, 2024) == pages.Extent(1, False)
    assert pages.extent(gap.limit(0), 2024) == pages.Extent(0, False)


def test_listed_models(spark, tmp_path):
    full = {"id": "o/a", "author": "o", "createdAt": "2025-01-02T03:04:05.123Z", "tags": ["x"], "siblings": [{"rfilename": "m.bin"}], "safetensors": {"total": 7}, "baseModels": {"relation": "merge", "models": [{"id": "b/1"}, {"id": "b/2"}]}, "cardData": {"license": "mit", "n": [1]}, "unknown": 1}
    rows = [full, {"id": "o/b"}, {"id": ""}, {"author": "x"}, {"id": "o/c", "createdAt": "soon", "baseModels": {"models": []}, "cardData": None}]
    (tmp_path / "p-1.json").write_text(json.dumps({"items": rows, "next": "2"}))
    schema = spark.createDataFrame([], pages.LISTED).schema
    listed = pages.read_pages(spark, str(tmp_path), schema).selectExpr("inline(items)")
    got = {r["repo_id"]: r for r in pages.models_of(listed).collect()}
    assert set(got) == {"o/a", "o/b", "o/c"} and (got["o/a"]["base_model"], got["o/a"]["relation"], got["o/a"]["params"], got["o/a"]["files"]) == ("b/1", "merge", 7, ["m.bin"])
    assert json.loads(got["o/a"]["card_data"]) == {"license": "mit", "n": [1]} and got["o/c"]["created_at"] is None and got["o/c"]["base_model"] is None
    assert (got["o/b"]["tags"], got["o/b"]["files"], got["o/b"]["downloads"], got["o/b"]["card_data"]) == ([], [], 0, "")


def test_years():
    now = datetime(2026, 1, 1)
    assert pages.parse_years("2025, 2024 2025,", now) == [2024, 2025]
    for bad in ("", "1999", "2027", "2024;2025", "x"):
        with pytest.raises(ValueError):
            pages.parse_years(bad, now)


def test_counts_by_year(spark):
    weights = ["model.safetensors"]
    rows = [("o/a", 2024, weights, None), ("o/b", 2024, weights, None), ("o/c", 2024, [], None), ("o/d", 2025, weights, None), ("o/e",
        2025, weights, "x/base"), ("o/f", 2025, weights, None)]
    models = spark.createDataFrame([(r, y, f, b, [], None, "", "") for r, y, f, b in rows],
        "repo_id string, year int, files array<string>, base_model string, tags array<string>, card_data string, relation string, library_name string")
    texts = spark.createDataFrame([("o/a", OWN_DATA, None), ("o/b", PLAIN, None), ("o/d", None, "timeout " * 60), ("o/e", OWN_DATA,
        None)], "repo_id string, readme string, error string")
    done = year_counts.classified(models, texts)
    got = {r["repo_id"]: (r["status"], r["reason"]) for r in done.collect()}
    assert got["o/a"] == ("confirmed", "explicit_scratch_claim") and got["o/b"] == got["o/f"] == ("candidate", "no_explicit_scratch_claim")
    assert got["o/c"] == ("excluded", "no_recognized_full_weight_file") and got["o/e"] == ("excluded",
        "declares_base_model") and got["o/d"] == ("error", "readme_fetch_error")
    assert max(len(r["evidence"]) for r in done.collect()) == 300
    years = {r["year"]: r for r in year_counts.by_year(year_counts.counts(done)).collect()}
    assert (years[2024]["confirmed"], years[2024]["candidate"], years[2024]["broad_upper_bound"], years[2025]["error"]) == (1, 1, 2, 1)
    assert years[2025]["reasons"] == {"declares_base_model": 1, "no_explicit_scratch_claim": 1, "readme_fetch_error": 1}
    assert year_counts.by_year(year_counts.counts(done.limit(0))).count() == 0


def test_reviews_are_asked_once(spark, tmp_path):
    fields = "repo_id string, card string, pipeline_tag string, library_name string, tags array<string>, relation string, base_models array<string>, params long"
    rows = [("o/a", "Some  text", "t", None, ["x", "y"], None, None, 7), ("o/b", " Some\ntext ", "t", None, ["y", "x"], None, None, 7),
        ("o/c", "Some text", "t", None, ["x"], None, None, 7), ("o/d", "  ", "t", None, [], None, None, 7), ("o/e", None, None, None,
        None, None, None, None), ("o/f", "unanswered", None, None, None, None, None, None)]
    asked = []

    def ask(put):
        asked.append(sorted(r["repo_id"] for r in put.collect()))
        kind = f"if(card = 'unanswered', NULL, named_struct('kind', 'merge', 'confidence', 'low', 'independently_pretrained', false, 'parameter_count_b', 0D, 'parameter_evidence', '', 'upstream_model', '', 'canonical_training_run', '', 'training_years', array(), 'evidence', '', 'reason', concat('{len(asked)} ', repo_id)))"
        return put.selectExpr("key", f"CAST({kind} AS {reviews.REVIEW}) AS review")

    path = f"file://{tmp_path}/cache"
    got = lambda: {r["repo_id"]: r["review"] and (r["review"]["kind"],
        r["review"]["reason"]) for r in review_cache.answered(spark.createDataFrame(rows, fields), path, ask).collect()}
    first = got()
    assert asked == [["o/a", "o/c", "o/f"]] and first["o/a"] == first["o/b"] == ("merge", "1 o/a") and first["o/c"] == ("merge", "1 o/c")
    assert first["o/d"] == first["o/e"] == ("unknown", "model card is empty") and first["o/f"] is None
    assert got() == first and asked[1:] == [["o/f"]]  # what had no answer is asked again, all else is known
    one = review_cache.load(spark, path).limit(1)
    review_cache.append(one.withColumn("review", one["review"].withField("kind", one["key"])), path)
    key = one.first()["key"]
    assert {r["key"]: r["review"]["kind"] for r in review_cache.load(spark, path).collect()}[key] == key
    review_cache.compacted(spark, path, f"file://{tmp_path}/small")
    assert spark.read.parquet(f"{tmp_path}/small").count() == review_cache.load(spark, path).count() == 2
    other = review_cache.keyed(spark.createDataFrame(rows, fields), version="review-2").first()["key"]
    assert other != review_cache.keyed(spark.createDataFrame(rows, fields)).first()["key"]


def test_reviews_of_blank_and_absent_cards(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "repo_id string")
    there = spark.createDataFrame([("a", "text"), ("b", " "), ("b", None)], "modelId string, card string")
    told = spark.createDataFrame([("a", None), ("c", None)], f"repo_id string, review {reviews.REVIEW}")
    got = {r["repo_id"]: r["review"] and r["review"]["reason"] for r in reviews.of_all(wanted, there, told).collect()}
    assert got == {"a": None, "b": "model card is empty", "c": "model is absent from bulk model-card snapshot"}


def test_record_order(spark):
    picks = (Selection("big", sort_by="downloads"), Selection("names", sort_by="repo_id", sort_direction="desc"), Selection("old",
        sort_by="created_at", sort_direction="asc"))
    rows = [(s.name, f"o/{n}", d, day, n) for s in picks for n, d, day in ((1, 5, "2024-01-02"), (2, 9, "2024-01-01"), (3, 5, None), (4,
        None, "2024-01-03"))]
    frame = spark.createDataFrame(rows, "selection string, repo_id string, downloads long, created_at string, ordinal long").repartition(5)
    frame = frame.withColumn("created_at", frame["created_at"].cast("timestamp"))
    got = sorted(ordinal.numbered(frame, ordinal.record_order(picks)).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(12))
    assert [(r["selection"], r["ordinal"]) for r in got] == [("big", 2), ("big", 1), ("big", 3), ("big", 4), *[("names", i) for i in (4,
        3, 2, 1)], *[("old", i) for i in (3, 2, 1, 4)]]
    assert ordinal.numbered(frame.limit(0), ordinal.record_order(picks)).count() == 0


def test_status_in_the_jvm_equals_python(spark):
    """Windows of bytes by SQL functions against the reader of single texts, cut characters and many claims included."""
    from test_card_signals import DENIED

    from cardloom.operators import card_signals, windows

    claim, rnd = "it was trained from scratch", random.Random(4)
    texts = [None, "", *DENIED.values(), claim, "é" * 60 + claim + "日" * 60, "😀" * 80 + f" {claim} " + "ñ" * 200 + " followed by supervised fine-tuning"]
    texts += [" ".join(rnd.choice([claim, "never trained from scratch", "the tokenizer", "é日本", "word " * 9, "обучена с нуля", "This model is distilled.", " x y"]) for _ in range(rnd.randrange(1, 12))) for _ in range(120)]
    texts += [f"{claim}. {'filler ' * 30}" * 80, f"never {claim}. {'filler ' * 30}" * 70 + claim]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "repo_id string, card string")
    want = {str(i): card_signals.scratch_status(t or "") for i, t in enumerate(texts)}
    got = {r["repo_id"]: (r["status"], r["reason"], r["evidence"]) for r in card_signals.status_of(rows).collect()}
    assert got == want and len({w[1] for w in want.values()}) == 4
    left = {r["repo_id"] for r in windows.scratch_status(rows).where("status IS NULL").collect()}
    assert left == {str(len(texts) - 2), str(len(texts) - 1)}
