import json
import math
from datetime import datetime

import pytest
from cardloom.functions.patterns import java
from cardloom.operators import costing as C
from cardloom.operators import taxonomy as X
from cardloom.operators import reviews as R
from cardloom.operators.reviews import REVIEW
from cardloom.operators.selection import Catalog, Selection, condition, moment
from cardloom.sinks import outputs as O
from cardloom.sources import snapshots as N


@pytest.mark.parametrize("params,bucket", [(0, "unknown"), (1_999_999_999, "<2B"), (2_000_000_000, "2-<7B"), (7_000_000_000, "7-<13B"),
    (13_000_000_000, "13-<34B"), (34_000_000_000, "34-<70B"), (70_000_000_000, "70-<120B"), (120_000_000_000, "120-<500B"),
    (500_000_000_000, ">=500B")])
def test_size_buckets(spark, params, bucket):
    assert spark.createDataFrame([(params,)], "params long").select(X.size_bucket()).first()[0] == bucket


def test_dense_coefficient(spark):
    row = spark.createDataFrame([(1_000_000_000, "base")], "params long, kind string")
    p = C.Profile()
    got = row.select(C.cost(C.gpu_hours(C.literal_flops(row["params"], row["kind"], p), p), p)).first()[0]
    assert math.isclose(got, 155.881361644759, rel_tol=1e-9)


def test_strict_selection():
    assert Selection.from_json('{"name": "a", "model_kinds": ["base"]}').model_kinds == ("base",)
    with pytest.raises(ValueError):
        Selection.from_json('{"name": "a", "typo": 1}')
    with pytest.raises(ValueError):
        Selection.from_json('{"name": "a"} x')


@pytest.mark.parametrize("files,keeps", [(["model.safetensors"], True), (["tokenizer.bin"], False), (["training_args.bin",
    "optimizer.pt"], False), (["a/pytorch_model.bin"], True), ([], False)])
def test_weight_files(spark, files, keeps):
    assert spark.createDataFrame([(files,)], "files array<string>").select(X.has_weights()).first()[0] is keeps


@pytest.mark.parametrize("text,pattern,hit", [("МОДЕЛЬ", "(?i)модель", True), ("éfrom", r"\bfrom", True), ("a\n", "a$", False), ("x\x0by",
    r"x\sy", False)])
def test_dialect(spark, text, pattern, hit):
    assert spark.createDataFrame([(text,)], "t string").select(X.F.col("t").rlike(java(pattern))).first()[0] is hit


def kinds_of(spark, rows):
    """Kinds of (repo_id, tags, library, relation, base model)."""
    frame = spark.createDataFrame([(*r, None)[:5] + ("",) for r in rows],
        "repo_id string, tags array<string>, library_name string, relation string, base_model string, card_data string")
    return [r[0] for r in frame.select(X.kind()).collect()]


def test_kinds(spark):
    plain = lambda i, tags=(), lib="": (i, list(tags), lib, "", None)
    cases = {
        "finetune": [plain("pond/heron-run", ["generated_from_trainer"]), plain("pond/heron-notes", ["trl", "sft"]),
            plain("pond/flock-run", ["grpo", "rl-swarm"]), plain("pond/Heron-3B-Instruct"), plain("pond/Wren-Chat"),
            plain("aiqtech/LLaDA2.0-flash-preview"), plain("vngrs-ai/Kumru-2B-Base")],
        "quantized": [plain("pond/Heron-4bits"), plain("pond/Heron", ["bitsandbytes", "8-bit"]), plain("copies/pond_-_Heron-3B"),
            plain("pond/Heron-3B-hf"), plain("microsoft/bitnet-b1.58-2B-4T"), plain("pond/Wren-Base", ["safetensors", "onnx"], "onnx")],
        "fork": [plain("nest/3f0e9a52-5b1c-4d7e-8a66-0123456789ab"), plain("nest/Heron-9B-Abliterated"), plain("nest/Wren-Uncensored"),
            plain("nest/Wren-Base-Adjust"), plain("nest/Wren-Repacked"), plain("LSX-UniWue/LLaMmlein_1B"),
            plain("pond/Heron-9B-Base-Stage2"), plain("nest/Affine-7HqWx2LkPz4TnVb8")],
        "base": [plain("pond/Wren-Base", ["safetensors", "onnx"], "transformers"), plain("pond/Wren", [None])],
    }
    for kind, rows in cases.items():
        assert kinds_of(spark, rows) == [kind] * len(rows)


@pytest.mark.parametrize("files,reason", [(["a.safetensors", "x.gguf", "adapter_model.bin"], "conversion_files"), (["a.safetensors",
    "adapter_model.bin", "x.gguf"], "adapter_files"), (["a.safetensors"], None), (["x.txt"], "no_recognized_full_weight_file"), (None,
    "no_recognized_full_weight_file")])
def test_first_telling_file_decides(spark, files, reason):
    row = spark.createDataFrame([("o/m", files, [], "", None)],
        "repo_id string, files array<string>, tags array<string>, card_data string, base_model string")
    assert row.select(X.metadata_reason()).first()[0] == reason


@pytest.mark.parametrize("card,declares", [('{"base_model": "a/b"}', True), ('{"base_model": ""}', False), ('{"base_model": " \\n"}',
    False), ('{"baseModel": false}', True), ('{"base_models": []}', False), ('{"base_models": {}}', False), ('{"base_models": ["a"]}',
    True), ("no json", False), (None, False), ('{"base_model": null}', False)])
def test_declared_base(spark, card, declares):
    assert spark.createDataFrame([(card,)], "card_data string").select(X.card_declares_base()).first()[0] is declares


def test_owner(spark):
    rows = spark.createDataFrame([("gpt2", ""), ("a/b", ""), ("a/b/c", None), ("a/b", "me")], "repo_id string, author string")
    assert [r[0] for r in rows.select(X.owner()).collect()] == ["", "a", "a", "me"]


def test_selection_nulls(spark):
    s = Selection("s", max_parameters_b=7.0, include_unknown_parameters=True, exclude_tags=("speech",))
    rows = spark.createDataFrame([("a", None, ["en", None]), ("b", 9_000_000_000, []), ("c", 7_000_000_000, None), ("d", 1, ["Speech"])],
        "repo_id string, params long, tags array<string>")
    assert [r[0] for r in rows.where(condition(s)).select("repo_id").collect()] == ["a", "c"]


def test_windows():
    assert Selection("s", created_from="2025-01-01", created_to="2025-12-31").window() == (datetime(2025, 1, 1), datetime(2026, 1, 1))
    assert Selection("s", created_to="2025-12-31").window(datetime(2026, 6, 1))[0] == datetime(2025, 1, 1)
    assert Selection("s", lookback_days=30).window(datetime(2025, 3, 1))[0] == datetime(2025, 1, 30)
    assert moment("2025-01-01T02:00:00+02:00") == datetime(2025, 1, 1)
    with pytest.raises(ValueError):
        moment("2025-01")


def test_catalog_file():
    text = '{"endpoint": "e", "local_llm": {"enabled": true, "scope": "diffusion"}, "sampling": {"enabled": true, "seed": 7}, "compute_profiles": [{"name": "p", "finetune_compute_fraction": 0}], "selections": [{"name": "s", "compute_profiles": ["p"], "limit": 0}]}'
    c = Catalog.from_json(text)
    assert c.sampling.seed == 7 and c.reviews and c.review_scope == "diffusion" and c.selections[0].compute_profiles == ("p",)
    for old, new in (('["p"]', '["q"]'), ('"limit": 0', '"limit": -1'), ('"name": "s"', '"name": ""'), ('"seed": 7', '"seeds": 7'),
        ('"finetune_compute_fraction": 0', '"efficiency": 2'), ('"limit": 0', '"target_llm_only": true, "target_diffusion_only": true')):
        with pytest.raises(ValueError):
            Catalog.from_json(text.replace(old, new))


def test_whole_name_passes(spark):
    """Records that differ in name, base model or date stay apart; those of one run are counted once."""
    from cardloom.operators import dedup as D

    def costless(run, rows):
        made = [("s", i, r, r.split("/")[0], k, b, p, 10.0 + i, 9.0, 11.0, m, f"2025-01-0{i + 1} 00:00:00", i, i,
            m if k != "base" else "", "", "", "", None) for i, (r, k, b, p, m) in enumerate(rows)]
        frame = spark.createDataFrame(made,
            f"selection string, ordinal long, repo_id string, owner string, kind string, base_model string, params long, cost double, lower double, upper double, method string, created_at string, likes long, downloads long, run_hash string, evidence_hash string, claim_run string, claim_card string, review {REVIEW}")
        return [r["ordinal"] for r in D.apply_pass(frame.withColumn("created_at", frame["created_at"].cast("timestamp")), run,
            (Selection("s"),)).where("cost IS NULL").orderBy("ordinal").collect()]

    hours, formula = "gpu_hours_x_hourly_rate", "formula_txt_parameter_scaling"
    tuned = lambda r, b="B/x": (r, "finetune", b, 7, hours)
    base = lambda r, p=7: (r, "base", None, p, formula)
    assert costless(D.reported_trajectory, [tuned("o/run"), tuned("o/Run-20240115"), tuned("o/run-20240116", "c/y"), tuned("o/other"),
        tuned("o/other"), tuned("o/run2")]) == [0]
    assert costless(D.checkpoint_trajectory, [base("o/a"), base("o/b"), base("o/a-step-1"), base("o/a-step-2"), base("o/b-step-3"),
        base("p/a-step-2"), base("o/a-step-9", 8)]) == [3]
    assert costless(D.family_mirror, [base("a/family-one"), base("b/Family_One-hf"), base("a/family-two"), base("a/short"),
        base("b/short"), base("a/model-hf"), base("b/model")]) == [0]
    assert costless(D.reported_run, [tuned("a/x"), tuned("b/y"), base("c/z")]) == [1]


def test_chain_and_reviews(spark):
    from cardloom.operators import dedup as D

    review = ("independent_base", "high", True, 0.0, "", "", "the run one", [], "e", "")
    medium = ("independent_base", "medium", True, 0.0, "", "", "The Run: One", [], "e", "")
    rows = [
        ("s", 0, "org/model-base", "org", "base", None, 7, 100.0, 100.0, 100.0, "formula_txt_parameter_scaling", 0, 0, "same-run", "", "",
            "", None, "deterministic"),
        ("s", 1, "org/model-instruct", "org", "finetune", None, 7, 100.0, 100.0, 100.0, "gpu_hours_x_hourly_rate", 0, 0, "same-run", "",
            "", "", None, "reported"),
        ("s", 2, "a/alpha-one", "a", "base", None, 9, 5.0, None, 5.0, "formula_txt_parameter_scaling", 1, 0, "", "", "r1", "", review,
            "llm_high"),
        ("s", 3, "b/beta-two", "b", "base", None, 9, None, None, 5.0, "formula_txt_parameter_scaling", 9, 0, "", "", "r2", "", medium,
            "llm_medium_upper_only"),
    ]
    frame = spark.createDataFrame([r[:11] + ("2025-01-01",) + r[11:] for r in rows],
        f"selection string, ordinal long, repo_id string, owner string, kind string, base_model string, params long, cost double, lower double, upper double, method string, created_at string, likes long, downloads long, run_hash string, evidence_hash string, claim_run string, claim_card string, review {REVIEW}, tier string")
    frame = frame.selectExpr("*", "array() AS compute", "array('e') AS errors")
    got = {r["ordinal"]: r for r in D.chained(frame, (Selection("s"),)).collect()}
    assert got[0]["cost"] == 100 and got[1]["cost"] is None and got[1]["method"] == "duplicate_reported_base_training_run"
    assert got[1]["errors"] == ["e", "reported compute belongs to canonical base repository org/model-base"]
    assert got[2]["cost"] == 5 and got[3]["upper"] is None and got[3]["tier"] == "duplicate"


CARD = "This model was trained on 2T tokens in 2025. It has 7B parameters."


@pytest.mark.parametrize(
    "answer,want",
    [
        ({"kind": " Independent_Base", "confidence": "HIGH", "independently_pretrained": True,
            "evidence": "trained on  2T TOKENS in 2025", "parameter_count_b": 7, "parameter_evidence": "7B parameters",
            "canonical_training_run": "Org: Run_1/"}, ("independent_base", "high", 7.0, [2025], "org-run-1")),
        ({"kind": "independent_base", "confidence": "high", "evidence": "trained on 2T tokens"}, ("unknown", "low", 0.0, [], "")),
        ({"kind": "finetune", "confidence": "medium", "evidence": "trained on", "parameter_count_b": 9, "parameter_evidence": "9B"},
            ("finetune", "medium", 0.0, [], "")),
        ({"kind": "finetune", "confidence": "high", "evidence": "not there"}, None),
        ({"kind": "other", "confidence": "low"}, None),
        ({"kind": "merge", "confidence": "sure"}, None),
        ({"kind": "merge", "confidence": "low", "evidence": ""}, ("merge", "low", 0.0, [], "")),
    ],
)
def test_reviews(answer, want):
    got = R.found(f"Sure {{x}} here: {json.dumps(answer)} done", CARD)
    assert (got and (got["kind"], got["confidence"], got["parameter_count_b"], got["training_years"],
        got["canonical_training_run"])) == want


def test_review_tables(spark, tmp_path):
    good = json.dumps({"kind": "merge", "confidence": "low", "evidence": ""})
    rows = spark.createDataFrame([("a", CARD, good), ("b", None, "none"), ("c", CARD, None)], "repo_id string, card string, answer string")
    assert {r["repo_id"]: r["review"] and r["review"]["kind"] for r in R.parsed(rows).collect()} == {"a": "merge", "b": None, "c": None}
    (tmp_path / "cache.jsonl").write_text('{"key": "k", "review": {"kind": "base"}}\nbroken\n{"key": "", "review": {"kind": "x"}}\n{"key": "k", "review": {"kind": "merge"}}\n')
    assert [(r["key"], r["review"]["kind"]) for r in R.latest(spark, str(tmp_path / "cache.jsonl")).collect()] == [("k", "merge")]


def test_snapshots_and_outputs(spark, tmp_path):
    scan = N.Scan("e", "2025-01-01", "2025-12-31")
    models = spark.createDataFrame([("a/b", 1)], "repo_id string, n long")
    path = f"file://{tmp_path}/check"
    assert N.load_checkpoint(spark, path, scan) is None and not N.save_checkpoint(models, path, N.Scan("e", "", "", complete=False))
    assert N.save_checkpoint(models, path, scan) and N.load_checkpoint(spark, path, scan).count() == 1
    assert N.load_checkpoint(spark, path, N.Scan("e", "2025-01-02", "2025-12-31")) is None
    assert N.shard_paths("c.parquet", 1) == ["c.parquet"] and N.shard_paths("c.parquet", 2)[1] == "c-0001.parquet"
    cards = spark.createDataFrame([("m", "1", "old", 1), ("m", "2", "new", 1), ("n", None, None, 1)],
        "modelId string, createdAt string, card string, more int").coalesce(1)
    cards.write.parquet(f"{tmp_path}/cards")
    assert {r["modelId"]: r["card"] for r in N.latest_cards(spark, f"{tmp_path}/cards").collect()} == {"m": "new", "n": None}
    assert [r["readme"] for r in N.with_readmes(models, spark.createDataFrame([], "repo_id string, readme string")).collect()] == [""]
    assert N.baseline(spark, f"{tmp_path}/none.json") is None
    O.write_text(spark, '{"selections": {"s": {"total_training_cost_usd": 5, "training_cost_by_kind": {"finetune": 2, "adapter": 1}}}}',
        f"file://{tmp_path}/summary.json")
    assert [tuple(r) for r in N.baseline(spark, f"file://{tmp_path}/summary.json").collect()] == [("s", 5.0, 3.0)]
    counts = spark.createDataFrame([(2025, 3, 2, 0, 0, {"x": 5}, 5)],
        "year int, confirmed long, candidate long, excluded long, error long, reasons map<string,long>, broad_upper_bound long")
    assert json.loads(O.years_json(counts, True))["years"]["2025"] == {"confirmed": 3, "candidate": 2, "reasons": {"x": 5},
        "broad_upper_bound": 5}
    assert O.file_component(" Öffentlich: Text ") == "ffentlich-text" and O.file_component("é") == "selection"
