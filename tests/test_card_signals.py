import hashlib
import json

import pytest

from cardloom.operators import card_signals as S


@pytest.mark.parametrize(
    "text,status",
    [
        ("Every weight is ours: the net was trained from scratch on weather reports.", "confirmed"),
        ("Training set out from random initialization and ran for two epochs.", "confirmed"),
        ("The net was trained on sheet music from the ground up.", "confirmed"),
        ("It has never been trained from scratch but was warm-started.", "excluded"),
        ("This model is a distilled version; the teacher was trained from scratch.", "excluded"),
        ("Only its vocabulary was trained from scratch.", "excluded"),
        ("Weights for reading old letters.", "candidate"),
        ("Сеть обучалась месяц с нуля.", "confirmed"),
        ("Ce réseau est entraîné à partir de zéro.", "candidate"),
    ],
)
def test_scratch_status(text, status):
    assert S.scratch_status(text)[0] == status


#: One sentence for each reason that ends a claim.
DENIED = {
    "negated": "Our recipe avoids training a translator from scratch.",
    "hypothetical": "A lab could train such a translator from scratch within a year.",
    "compared": "It was trained with fewer tokens than pretraining from scratch.",
    "example": "See the guide to training a poem writer from scratch.",
    "part of it": "The visual encoder was trained from scratch, the rest was downloaded.",
    "random part": "The classification head is randomly initialized before it is trained.",
    "frozen": "The decoder was trained from scratch beside an encoder that was kept frozen.",
    "part, in Russian": "Эмбеддинг обучен с нуля, остальное взято из архива.",
    "either way": "It was trained from scratch (or fine-tuned) on recipes.",
    "other work": "The whole library was written from scratch in Julia.",
    "sequence": "The net was trained from scratch on maps, followed by instruction fine-tuning.",
    "sequence, reversed": "Alignment came later; at first all was trained from scratch on maps.",
    "underwent": "It was pre-trained from scratch on maps and instruction fine-tuned on quizzes.",
    "later tuning": "The net was trained from scratch on maps. The final checkpoint was then fine-tuned on quizzes.",
    "upstream": "It is based on a pre-trained net that others trained from scratch.",
    "empty": "",
    "blank": " \t\n",
}


@pytest.mark.parametrize("reason", DENIED)
def test_no_claim(reason):
    assert S.scratch_claim(DENIED[reason], "card") is None


@pytest.mark.parametrize(
    "text",
    [
        "This encoder for bird songs was trained from scratch on field recordings.",
        "The net was trained from scratch and can be fine-tuned for your own birds.",
        "Our net was trained from scratch. We set it beside a fine-tuned rival.",
        "Since the net was trained from scratch, it knows no other birds.",
    ],
)
def test_claim(text):
    assert S.scratch_claim(text, "card").evidence_type == "explicit_scratch"


@pytest.mark.parametrize(
    "text,repo,kind,tokens,active",
    [
        ("Heron has 90 billion total parameters and 11 billion activated parameters. Pre-trained on 7.25T tokens.", "birds/Heron-Base",
            "pretraining_evidence", 7.25, 11),
        ("Wren is a foundation model with 3 billion parameters. Pretrained on 640B tokens.", "birds/Wren", "pretraining_evidence", 0.64, 0),
        ("These are the raw weights.", "birds/Stork-4B-Base", "declared_base_model", 0, 0),
        ("For pretraining we took a corpus of 9T tokens.", "birds/Crane-Base", "pretraining_evidence", 0, 0),
        ("It was trained from scratch on 12B tokens.", "allenai/OLMo-3-1025-7B", "explicit_scratch", 5.93, 0),
        ("A distilled version of Stork.", "birds/Chick-Base", None, 0, 0),
        ("It is built on the Stork checkpoint.", "birds/Nest-Base", None, 0, 0),
        ("It was pre-trained from the Stork weights on 1T tokens.", "birds/Flock-Base", None, 0, 0),
    ],
)
def test_evidence(text, repo, kind, tokens, active):
    got = S.scratch_claim(text, "card", repo)
    assert (got and got.evidence_type) == kind
    assert not got or (got.training_tokens_t, got.active_parameters_b) == (tokens, active)


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("The library holds 30T tokens; a tenth of them was read.", 0),
        ("The model was trained for roughly 6 trillion tokens. The archive has 80T tokens.", 6),
        ("**Pretraining Tokens**: 3.5 trillion", 3.5),
        ("Pre-trained a sparse net on 2.75T tokens.", 2.75),
        ("It was trained entirely from scratch on sagas with 410 billion tokens.", 0.41),
        ("Pre-training stage 1: 0.8T tokens. Pre-training stage 2: 1.4T tokens.", 1.4),
        ("The model was trained on 70B tokens.", 0.07),
    ],
)
def test_tokens(text, tokens):
    assert S.trained_tokens(text) == pytest.approx(tokens)


@pytest.mark.parametrize(
    "text,repo,active",
    [
        ("No numbers.", "birds/Gull-40B-A2.5B", 2.5),
        ("Of **120** billion parameters, **14** billion active parameters do the work.", "birds/Gull", 14),
        ("It activates 6 billion for each token.", "birds/Gull", 6),
        ("See the table.", "zai-org/GLM-4.5-Air-Base", 12),
        ("No numbers.", "birds/Gull", 0),
    ],
)
def test_active_parameters(text, repo, active):
    assert S.active_parameters(text, repo) == active


def test_trainer_and_years():
    got = S.scratch_claim("Heron is a net trained from scratch by Pond Lab.\nTraining dates: 2021-08 until 2022-01", "card")
    assert got.claimed_trainer == "Pond Lab" and got.training_years == [2021, 2022]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Fine-tuning took 45 minutes on 4x H100 GPUs.", dict(hours=0.75, gpu_count=4, gpu_hours=3, cost_usd=5.55, assumed_gpu=False,
            assumed_gpu_count=False)),
        ("Training Time: 3.5 TPUv4-16 Hours", dict(hours=3.5, gpu_count=16, gpu_hours=56)),
        ("Training time: 3 weeks. Total training cost was $640.", dict(hours=504, gpu_count=1, gpu_name="NVIDIA H100", cost_usd=640,
            cost_method="reported_total_cost", assumed_gpu=True, assumed_gpu_count=True)),
        ("Fine-tuning used 70 GPU hours on H100.", dict(gpu_hours=70, cost_usd=129.5)),
        ("Hardware: 16 x A100. **Hours used (total GPU hours):** 5120.5h", dict(gpu_hours=5120.5, cost_usd=9472.925)),
        ("The cost of fine-tuning was $87.25.", dict(cost_usd=87.25, cost_method="reported_total_cost", hours=0)),
        ("Pretraining cost: about $3.2M.", dict(cost_usd=3_200_000)),
        ("Training took 9 hours on 4 x NVIDIA H100 GPUs.", dict(gpu_count=4, gpu_hours=36)),
        ("Training took 7 hours on 16 GPUs on H100.", dict(gpu_count=16, gpu_hours=112)),
        ("Serving takes 32 GPUs. Training took 6 hours on H100.", dict(gpu_count=1, gpu_hours=6)),
        ("Hours used: 12,288 GPU hours", dict(gpu_hours=12_288)),
        ("In all some 35k GPU hours went into model training.", dict(gpu_hours=35_000)),
        ("The first run used 1,500 H100 GPU hours. The second run used 700 H100 GPU hours.", dict(gpu_hours=2200)),
        ("The first run used 64 H100 GPU hours. The second run used 64 H100 GPU hours.", dict(gpu_hours=128)),
        ("Total GPU hours: 90. The runs used 30 GPU hours and 60 GPU hours.", dict(gpu_hours=90)),
        ("Evaluation used 400 H100 GPU hours. Fine-tuning used 25 H100 GPU hours.", dict(gpu_hours=25)),
        ("Base pre-training took 20 days on 128 H100 GPUs. Current fine-tuning took 5 hours on 4 H100 GPUs.", dict(hours=5, gpu_count=4,
            gpu_hours=20)),
        ("Training duration: 3h20m. Hardware: GPU T4 x4.", dict(hours=3 + 20 / 60, gpu_count=4, gpu_hours=13 + 1 / 3)),
        ("Training took 2 months and 4 days on 1 H100.", dict(hours=(2 * 30 + 4) * 24)),
        ("Training runtime: 9,000 seconds on GPUs: 4.", dict(hours=2.5, gpu_count=4)),
        ("Training time: 31 hours. Hardware: NVIDIA 3090 GPU.", dict(gpu_count=1, gpu_name="NVIDIA RTX 3090", gpu_hours=31)),
        ("Fine-tuning took 3 hours on one RTX 3090. Cost: ~$4 in the cloud.", dict(cost_method="reported_total_cost", cost_usd=4)),
        ("Training took 6 hours on 4x H100 GPUs at $2.50 per GPU hour.", dict(hourly_rate_usd=2.5, cost_usd=60)),
    ],
)
def test_compute(text, want):
    got = S.reported_compute(text, "README.md")
    for name, value in want.items():
        assert getattr(got, name) == (pytest.approx(value) if isinstance(value, float) else value), name


#: One text for each reason that a number is no compute of this run.
NO_COMPUTE = {
    "model number before hours": "Sizes: | Net | RTX 3090 GPU hours |\n| Wren-90M | 45 |",
    "evaluation": "Serving used 90 H100 GPU hours last week.",
    "mixed use": "For all nets fine-tuned and evaluation together, a total of 800 GPU hours were used.",
    "widget": "cardData.widget.text: Stork trained for 5,000 GPU hours.\ncardData.name: chick",
    "parameters": "It was trained with the settings of Wren-90M.",
    "hours of speech": "Fine-tuned for Frisian on some 60h of radio.",
    "processor": "Training time: 12 hours (CPU).",
    "cost of use": "The total cost of 900 answers was $3.10.",
    "empty": "",
    "blank": " \n ",
}


@pytest.mark.parametrize("reason", NO_COMPUTE)
def test_no_compute(reason):
    assert S.reported_compute(NO_COMPUTE[reason], "README.md") is None


def test_metadata():
    got = S.compute_of_metadata({"run": {"train_runtime": 5400.0}})
    assert (got.hours, got.cost_usd) == (1.5, pytest.approx(2.775))
    assert got.evidence_hash == hashlib.sha256(b'{"run":{"train_runtime":5400}}').hexdigest()
    assert S.flat_lines({"y": "end", "c": {"k": "two", "b": "one"}, "widget": "w", "m": 3.0}) == ["cardData.c.b: one",
        "cardData.c.k: two", "cardData.m: 3", "cardData.y: end"]
    assert S.positive_number({"training_hours": 8.0, "hours_used": 4.0}, {"hours_used", "training_hours"}) == 4
    assert S.compute_of_metadata({}) is None and S.claim_of_metadata(None) is None
    assert S.claim_of_metadata(json.loads('{"about": "The net was trained from scratch."}'),
        "o/m").card_hash == hashlib.sha256(b'{"about":"The net was trained from scratch."}').hexdigest()


def test_windows_are_bytes():
    """A window of 500 bytes ahead cuts a two-byte letter; the cut byte is hashed."""
    text = "é" * 400 + "x Training took 7 hours on 16 H100."
    got = S.reported_compute(text, "card")
    start = text.encode().index(b"Training")
    assert got.run_hash == hashlib.sha256(b" ".join(text.encode()[start - 500 :].split())).hexdigest()


def test_signals(spark):
    cards = [("o/a", "2025-02-01", "Training took 10 hours on 2x H100 GPUs."), ("o/b", "2025-01-01",
        "Training took 10 hours on 2x H100 GPUs."), ("o/c-base", "2025-03-01", "A card."), ("o/d", "2025-01-01", None), ("o/e", None, ""),
        ("o/f", "2025-01-05", "nothing here")]
    found = S.with_earliest(S.signals(spark.createDataFrame([(*c, 1) for c in cards],
        "modelId string, createdAt string, card string, compute int").select("*")))
    got = {r["modelId"]: r for r in found.collect()}
    assert set(got) == {"o/a", "o/b", "o/c-base"}
    assert got["o/a"]["compute"]["earliest"] == "2025-01-01" and got["o/a"]["compute"]["cost_usd"] == 37 and got["o/a"]["claim"] is None
    assert got["o/c-base"]["claim"]["evidence_type"] == "declared_base_model" and got["o/c-base"]["claim"]["earliest"] == "2025-03-01"
    assert S.signals(spark.createDataFrame([], "modelId string, createdAt string, card string")).count() == 0
