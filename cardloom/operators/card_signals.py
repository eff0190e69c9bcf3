"""What a model card reports: training from scratch, tokens, active parameters, compute and cost.

`scratch_status`, `scratch_claim` and `reported_compute` read one text; `signals` runs them over a table of cards in one
Arrow pass, after a filter on plain substrings in the JVM. Windows around a match are counted in UTF-8 bytes.

Edge cases. A null or blank card reports nothing; invalid numbers are skipped; a window that cuts a character keeps its bytes
for hashing and shows a replacement character; repeated cards give a row each; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from dataclasses import asdict, dataclass, field
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import card_patterns as C
from ..functions.patterns import compiled, java, matches
from ..session import ship, written
from . import taxonomy as X
from . import windows as W

HOURLY_RATE_USD = 1.85
DEFAULT_GPU = "NVIDIA H100"
_RE = {name: compiled(p) for name, p in vars(C).items() if name.isupper() and isinstance(p, str)}
_FIELD = re.compile(r"[^\t-\r \x85\xa0  -     　]+")
_STOP = re.compile(r"[\n\r.!?]")
_NEAR = ("SCRATCH_NEGATED", "SCRATCH_OF_PART", "RANDOM_PART", "SCRATCH_NOT_DONE", "SCRATCH_UPSTREAM", "DERIVATIVE_NEARBY")
#: Hours in a unit of time, by its first letters, and factors of amounts.
HOURS = {"s": 1 / 3600, "mi": 1 / 60, "h": 1.0, "d": 24.0, "w": 168.0, "mo": 720.0}
FACTORS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6}


def collapse(text: str) -> str:
    """Words with single blanks between."""
    return " ".join(_FIELD.findall(text))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogateescape")).hexdigest()


def _shown(text: str, most: int) -> str:
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")[:most]


class Text:
    """A text with byte positions of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.plain = text.isascii()
        if not self.plain:
            self.ends = list(accumulate(len(c.encode("utf-8", "surrogateescape")) for c in text))

    def at(self, i: int) -> int:
        """The byte position of a character."""
        return i if self.plain else (self.ends[i - 1] if i else 0)

    def around(self, start: int, end: int, before: int, after: int, cut: bool = False) -> tuple[str, int]:
        """The text from `before` bytes ahead of start to `after` bytes past end, and how many bytes start lies in it. A
        character that a border cuts is left out, or with `cut` its bytes stay."""
        if self.plain:
            low = max(0, start - before)
            return self.text[low : end + after], start - low
        a, b = max(0, self.at(start) - before), self.at(end) + after
        i, j = bisect_left(self.ends, a + 1), bisect_left(self.ends, b)
        raw = self.text[i : j + 1].encode("utf-8", "surrogateescape")
        base = self.at(i)
        part = raw[a - base : b - base]
        if cut:
            return part.decode("utf-8", "surrogateescape"), self.at(start) - a
        return part.decode("utf-8", "ignore"), self.at(start) - a


@dataclass
class Signal:
    start: int
    end: int
    value: float


def amount(number: str, scale: str | None) -> float:
    return float(number.replace(",", "")) * FACTORS.get((scale or "").lower(), 1.0)


# ---- training from scratch


def scratch_status(text: str) -> tuple[str, str, str]:
    """(status, reason, evidence) of a card's claim to be trained from scratch."""
    own = Text(text)
    claims = list(_RE["SCRATCH_CLAIM"].finditer(text))
    for m in claims:
        near, _ = own.around(m.start(), m.end(), 100, 100)
        wide, _ = own.around(m.start(), m.end(), 300, 300)
        if _RE["DERIVATIVE_SEQUENCE"].search(wide) or any(_RE[p].search(near) for p in _NEAR):
            continue
        if _RE["DERIVATIVE_ITSELF"].search(text):
            return "excluded", "current_model_is_derivative", ""
        return "confirmed", "explicit_scratch_claim", collapse(near)[:500]
    return ("excluded", "scratch_claim_not_usable", "") if claims else ("candidate", "no_explicit_scratch_claim", "")


def _most_tokens(pattern: str, text: str) -> float:
    """The largest number of tokens, in trillions."""
    best = 0.0
    for m in _RE[pattern].finditer(text):
        number, unit = next((pair for pair in zip(m.groups()[::2], m.groups()[1::2], strict=True) if pair[0]), ("0", ""))
        best = max(best, float(number) / (1000 if unit.lower() in ("b", "billion") else 1))
    return best


def trained_tokens(text: str, evidence: str = "") -> float:
    """Trillions of tokens that a run is said to have used; sizes of data sets don't count."""
    for own in (text, evidence):
        if best := max(_most_tokens("TOKENS_TRAINED", own), _most_tokens("TOKENS_PRETRAINED", own)):
            return best
    return 0.0


def active_parameters(text: str, repo_id: str = "") -> float:
    """Billions of parameters active for a token, or 0."""
    if known := C.KNOWN_ACTIVE_B.get(repo_id.lower()):
        return float(known)
    told = _RE["ACTIVE_PARAMETERS"].search(text)
    named = _RE["ACTIVE_IN_NAME"].search(repo_id)
    numbers = [float(g) for m in (told, named) if m for g in m.groups() if g]
    return next((n for n in numbers if n > 0), 0.0)


def training_years(text: str) -> list[int]:
    lines = (m[0] for m in _RE["TRAINING_DATES"].finditer(text))
    return sorted({int(y[1]) for line in lines for y in _RE["YEAR"].finditer(line)})


@dataclass
class Claim:
    source: str
    evidence_type: str
    evidence: str
    card_hash: str
    run_hash: str
    claimed_trainer: str = ""
    training_years: list[int] = field(default_factory=list)
    active_parameters_b: float = 0.0
    training_tokens_t: float = 0.0


def _derived(text: str) -> bool:
    return any(_RE[p].search(text) for p in ("CONTINUED", "DERIVATIVE_ITSELF", "DERIVATIVE_CARD"))


def _ground(text: str, repo_id: str, told: tuple[str, str, str] | None = None) -> tuple[str, str] | None:
    """(kind of evidence, evidence) for training of its own, strongest first; told is the text's status, if known."""
    status, _, evidence = told or scratch_status(text)
    if status == "confirmed":
        return "explicit_scratch", evidence
    named, clean = bool(_RE["BASE_NAME"].search(repo_id)), not _derived(text)
    told = _RE["PRETRAINING"].search(text)
    if told and not _derived(told[0]) and (clean or named):
        return "pretraining_evidence", collapse(told[0])[:500]
    if named and clean:
        return "declared_base_model", f"repository name declares an independent base checkpoint: {repo_id}"
    return None


def scratch_claim(text: str, source: str, repo_id: str = "", told: tuple[str, str, str] | None = None) -> Claim | None:
    ground = _ground(text, repo_id, told)
    if not ground:
        return None
    kind, evidence = ground
    tokens = C.KNOWN_TOKENS_T.get(repo_id.lower()) or trained_tokens(text, evidence) or (_most_tokens("TOKENS_ANY",
        evidence) if kind == "explicit_scratch" else 0.0)
    trainer = _RE["TRAINER"].search(text)
    return Claim(source, kind, evidence, sha256(collapse(text)), sha256(collapse(evidence)), trainer[1].strip() if trainer else "",
        training_years(text), active_parameters(text, repo_id), tokens)


# ---- compute and cost


@dataclass
class Compute:
    hours: float = 0.0
    gpu_count: int = 0
    gpu_name: str = ""
    gpu_hours: float = 0.0
    hourly_rate_usd: float = 0.0
    cost_usd: float = 0.0
    cost_method: str = ""
    reported_cost_usd: float = 0.0
    source: str = ""
    evidence: str = ""
    evidence_hash: str = ""
    run_hash: str = ""
    training_years: list[int] = field(default_factory=list)
    assumed_gpu: bool = False
    assumed_gpu_count: bool = False
    assumed_hourly_rate: bool = False


def without_widgets(text: str) -> str:
    """Lines of example prompts say nothing of the repository's own run."""
    kept = []
    for line in text.split("\n"):
        low = line.strip().lower()
        if "carddata.widget" not in low and not low.startswith(("widget:", "widget.")):
            kept.append(line)
    return "\n".join(kept)


def _sentence(text: str, start: int, end: int) -> tuple[int, int]:
    before = max((text.rfind(c, 0, start) for c in "\n\r.!?"), default=-1)
    after = _STOP.search(text, end)
    return before + 1, after.end() if after else len(text)


def _not_training(own: Text, start: int, end: int) -> bool:
    """The hours are of inference, or of training and inference together."""
    a, b = _sentence(own.text, start, end)
    sentence = own.text[a:b].lower()
    trains = "train" in sentence or "fine-tun" in sentence
    if not trains and any(w in sentence for w in ("inference", "evaluation", "serving")):
        return True
    near, _ = own.around(start, end, 180, 180)
    return bool(_RE["MIXED_USE"].search(sentence) or _RE["MIXED_USE"].search(near) and _RE["AGGREGATE_SCOPE"].search(near))


def stated_gpu_hours(own: Text) -> Signal | None:
    """The sum of all stated GPU hours; stated totals stand for their parts, equal totals count once."""
    found: list[tuple[Signal, bool]] = []
    for pattern in ("GPU_HOURS_LABELLED", "GPU_HOURS_VALUE_FIRST"):
        for m in _RE[pattern].finditer(own.text):
            value = amount(m[1], m[2])
            ahead, _ = own.around(m.start(), m.start(), 24, 0)
            if value <= 0 or _RE["MODEL_NUMBER_AHEAD"].search(ahead) or _not_training(own, *m.span()):
                continue
            if not any(s.value == value and s.start < m.end() and m.start() < s.end for s, _ in found):
                found.append((Signal(*m.span(), value), "total" in m[0].lower()))
    totals: dict[float, Signal] = {}
    for s, total in found:
        if total:
            totals.setdefault(s.value, s)
    used = list(totals.values()) or [s for s, _ in found]
    return Signal(min(s.start for s in used), max(s.end for s in used), sum(s.value for s in used)) if used else None


def duration_hours(text: str) -> float:
    total = 0.0
    for m in _RE["DURATION_PART"].finditer(text):
        unit = m[2]
        if len(unit) == 1 and unit.isupper():  # "135M" is a size
            continue
        low = unit.lower()
        per = HOURS["mi" if low in ("m", "min", "mins") else low[:2] if low[0] == "m" else low[0]]
        total += float(m[1].replace(",", "")) * per
    return total


def stated_duration(own: Text) -> Signal | None:
    """The wall time of the run: on TPUs, else of fine-tuning, of training, of pre-training; the first of its rank."""
    found: list[tuple[int, Signal]] = [(4, Signal(*m.span(),
        float(m[1]))) for m in _RE["TPU_RUNTIME"].finditer(own.text) if float(m[1]) > 0][:1]
    for pattern in ("DURATION_LABELLED", "TRAINED_FOR"):
        for m in _RE[pattern].finditer(own.text):
            if hours := duration_hours(m[1]):
                low = m[0].lower()
                upstream = any(w in low for w in ("pretrain", "pre-train", "pre training"))
                found.append((3 if "fine-tun" in low else 1 if upstream else 2, Signal(*m.span(), hours)))
    return max(found, key=lambda x: x[0])[1] if found else None


def stated_cost(own: Text) -> Signal | None:
    """A total cost of training; a bare "cost: $" counts beside words of training."""
    for m in _RE["COST_LABELLED"].finditer(own.text):
        if (value := amount(m[1], m[2])) > 0:
            return Signal(*m.span(), value)
    for m in _RE["COST_BARE"].finditer(own.text):
        near, _ = own.around(*m.span(), 350, 150)
        if any(w in near.lower() for w in ("training", "fine-tun", "pretrain", "gpu hour")) and (value := amount(m[1], m[2])) > 0:
            return Signal(*m.span(), value)
    return None


def _nearest(pattern: str, own: Text, start: int, end: int) -> re.Match | None:
    """The match with the fewest bytes between it and start to end; the first of equals."""

    def gap(m: re.Match) -> int:
        a, b = own.at(m.start()), own.at(m.end())
        return max(start - b, a - end, 0)

    return min(_RE[pattern].finditer(own.text), key=gap, default=None)


def _count(own: Text, start: int, end: int) -> int:
    """A number of GPUs without a name."""
    for pattern in ("GPU_COUNT_BEFORE", "GPU_COUNT_TIMES", "GPU_COUNT_AFTER"):
        m = _nearest(pattern, own, start, end)
        if m and int(m[1]) > 0:
            return int(m[1])
    return 0


def hardware(own: Text, start: int, end: int) -> tuple[int, str, bool, bool]:
    """(count, name, name is assumed, count is assumed) of the accelerators nearest to the bytes from start to end."""
    tpu = _nearest("TPU_RUNTIME", own, start, end)
    if tpu and int(tpu[3]) > 0:
        return int(tpu[3]), tpu[2].replace(" ", "").upper(), False, False
    m = _nearest("HARDWARE", own, start, end)
    if not m:
        if consumer := _nearest("CONSUMER_GPU", own, start, end):
            return 1, f"NVIDIA RTX {consumer[1]}", False, True
        n = _count(own, start, end)
        return n or 1, DEFAULT_GPU, True, not n
    stated = [int(g) for g in (m[1], m[3]) if g and int(g) > 0]
    count = stated[0] * (stated[1] if len(stated) > 1 else 1) if stated else 0
    if not count:
        a, b = _sentence(own.text, *m.span())
        sentence, base = Text(own.text[a:b]), own.at(a)
        count = _count(sentence, own.at(m.start()) - base, own.at(m.end()) - base)
    name = m[2].replace(" ", "").upper()
    return count or 1, DEFAULT_GPU if name == "H100" else name, False, not count


def reported_compute(text: str, source: str) -> Compute | None:
    """The run's hours, accelerators and cost; None if the card tells neither hours nor a cost."""
    own = Text(without_widgets(text))
    if not collapse(own.text):
        return None
    cost, total = stated_cost(own), stated_gpu_hours(own)
    signal = total or stated_duration(own)
    if not cost and not signal:
        return None
    out = Compute(source=source, evidence_hash=sha256(collapse(own.text)), cost_method="gpu_hours_x_hourly_rate")
    evidence = ""
    if signal:
        raw, at = own.around(signal.start, signal.end, 500, 700, cut=True)
        evidence = collapse(raw)
        if _RE["NO_GPU"].search(raw) and not _RE["HARDWARE"].search(raw):
            return None
        width = own.at(signal.end) - own.at(signal.start)
        count, out.gpu_name, out.assumed_gpu, assumed = hardware(Text(raw), at, at + width)
        out.gpu_count, out.assumed_gpu_count = (1, True) if total else (count, assumed)
        rate = _RE["HOURLY_RATE"].search(evidence)
        out.hours, out.hourly_rate_usd, out.assumed_hourly_rate = signal.value, float(rate[1]) if rate else HOURLY_RATE_USD, not rate
        out.gpu_hours = out.hours * out.gpu_count
        out.cost_usd = out.gpu_hours * out.hourly_rate_usd
    if cost:
        evidence = collapse(own.around(cost.start, cost.end, 500, 700, cut=True)[0])
        out.cost_usd = out.reported_cost_usd = cost.value
        out.cost_method, out.assumed_hourly_rate = "reported_total_cost", False
    out.evidence, out.run_hash, out.training_years = _shown(evidence, 700), sha256(evidence), training_years(evidence)
    return out


# ---- structured metadata


def _number(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)


def flat_lines(value, path: str = "cardData") -> list[str]:
    """"path: value" of every text and number, keys in order; widgets and model indexes are left out."""
    if isinstance(value, dict):
        return [x for k in sorted(value) if k.lower() not in ("widget", "model-index", "model_index") for x in flat_lines(value[k],
            f"{path}.{k}")]
    if isinstance(value, list):
        return [x for v in value for x in flat_lines(v, path)]
    if isinstance(value, str):
        return [f"{path}: {value}"]
    return [f"{path}: {_number(value)}"] if isinstance(value, int | float) and not isinstance(value, bool) else []


def positive_number(value, wanted: set[str]) -> float:
    """The first positive number under one of the keys, keys in order."""
    if isinstance(value, dict):
        for k in sorted(value):
            own = value[k]
            if k.lower() in wanted and not isinstance(own, bool | dict | list | None):
                try:
                    if float(own) > 0:
                        return float(own)
                except ValueError:
                    pass
            if inner := positive_number(own, wanted):
                return inner
    if isinstance(value, list):
        return next((n for v in value if (n := positive_number(v, wanted))), 0.0)
    return 0.0


def canonical_json(value) -> str:
    """Compact, keys in order, with < > & and line separators escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def _whole_numbers(value):
    if isinstance(value, dict):
        return {k: _whole_numbers(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_whole_numbers(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 1e21 else value


def compute_of_metadata(card: dict | None) -> Compute | None:
    """As reported_compute, from structured metadata: known fields of hours or seconds go first."""
    if not card:
        return None
    text = "\n".join(flat_lines(card))
    for keys, unit in (({"hours_used", "training_hours", "training_time_hours"}, "hours"), ({"train_runtime", "training_time_seconds",
        "training_seconds"}, "seconds")):
        if n := positive_number(card, keys):
            text = f"training time: {_number(n) if n == int(n) else format(n, 'f').rstrip('0')} {unit}\n{text}"
            break
    out = reported_compute(text, "cardData")
    if out:
        out.evidence_hash = sha256(canonical_json(_whole_numbers(card)))
    return out


def claim_of_metadata(card: dict | None, repo_id: str = "") -> Claim | None:
    if not card:
        return None
    out = scratch_claim("\n".join(flat_lines(card)), "cardData", repo_id)
    if out:
        out.card_hash = sha256(canonical_json(_whole_numbers(card)))
    return out


# ---- tables

COMPUTE = (
    "struct<hours:double,gpu_count:long,gpu_name:string,gpu_hours:double,hourly_rate_usd:double,cost_usd:double,cost_method:string,reported_cost_usd:double,source:string,evidence:string,"
    "evidence_hash:string,run_hash:string,training_years:array<long>,assumed_gpu:boolean,assumed_gpu_count:boolean,assumed_hourly_rate:boolean,earliest:string>"
)
CLAIM = "struct<source:string,evidence_type:string,evidence:string,card_hash:string,run_hash:string,claimed_trainer:string,training_years:array<long>,active_parameters_b:double,training_tokens_t:double,earliest:string>"


def _arrow(ddl: str) -> pa.StructType:
    kinds = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.struct([(n, kinds[k]) for n, k in (f.split(":") for f in ddl[7:-1].split(","))])


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20):
    """Slices of a batch of about `most` bytes of text; a longer text is a slice of its own."""
    size = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())).to_pylist()
    at = 0
    while at < len(size):
        to = max(at + 1, bisect_right(size, (size[at - 1] if at else 0) + most))
        yield batch.slice(at, to - at)
        at = to


def extracted(rows: DataFrame, source: str, *keep: str) -> DataFrame:
    """The kept columns, status, reason, compute and claim of rows with modelId, card, do_compute and do_scratch; what a row
    isn't asked for is null."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "card"):
                status, compute, claims = [], [], []
                for text, model, hours, scratch in zip(*(part.column(c).to_pylist() for c in ("card", "modelId", "do_compute",
                    "do_scratch")), strict=True):
                    told = scratch_status(text)
                    status.append(told)
                    compute.append(reported_compute(text, source) if hours else None)
                    claims.append(scratch_claim(text, source, model or "", told) if scratch else None)
                own = [pa.array([x[i] for x in status], pa.string()) for i in (0, 1)]
                own += [pa.array([x and asdict(x) for x in found], _arrow(kind)) for found, kind in ((compute, COMPUTE), (claims, CLAIM))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *own], [*keep, "status", "reason", "compute", "claim"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*dict.fromkeys([*keep, "modelId", "card", "do_compute", "do_scratch"])).mapInArrow(run,
        f"{schema}, status string, reason string, compute {COMPUTE}, claim {CLAIM}")


def status_of(rows: DataFrame) -> DataFrame:
    """repo_id, status, reason and evidence of rows with repo_id and card: what the text says of training from scratch. Only texts
    of very many claims leave the JVM."""
    ship(rows.sparkSession)
    many = F.size(F.regexp_extract_all("card", F.lit(java(C.SCRATCH_CLAIM)), F.lit(0))) > W.MOST
    done = W.scratch_status(rows.where(~F.coalesce(many, F.lit(False)))).select("repo_id", "status", "reason", "evidence")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "card"):
                found = [scratch_status(t) for t in part.column("card").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("repo_id"), *[pa.array([f[i] for f in found], pa.string()) for i in range(3)]], ["repo_id", "status", "reason", "evidence"])

    return done.union(rows.where(many).select("repo_id", "card").mapInArrow(run, "repo_id string, status string, reason string, evidence string"))


def signals(cards: DataFrame, source: str = "model-card bulk snapshot") -> DataFrame:
    """modelId, createdAt, status, reason, compute and claim of the cards that may matter."""
    scratch = X.may_claim_scratch("card") | F.coalesce(matches(F.col("modelId"), C.BASE_NAME), F.lit(False))
    rows = cards.where(F.coalesce("card", F.lit("")) != "").withColumns({"do_compute": X.may_report_compute("card"), "do_scratch": scratch})
    return extracted(rows.where("do_compute OR do_scratch"), source, "modelId", "createdAt")


def with_earliest(found: DataFrame) -> DataFrame:
    """Fills in `earliest` of compute and claim: the least creation time of any card with the same fingerprint. The extraction is
    written once; minima are taken before they are joined, so a copied card's key holds one row of the small side."""
    found = written(found.withColumn("_row", F.monotonically_increasing_id()), "signals")
    key = lambda which, name, value: F.struct(F.lit(which).alias("which"), F.concat(F.lit(f"{name}:"), value).alias("key"))
    of_compute = F.array(key("compute", "evidence", F.col("compute.evidence_hash")), key("compute", "run", F.col("compute.run_hash")))
    of_claim = F.array(key("claim", "card", F.col("claim.card_hash")), key("claim", "run", F.col("claim.run_hash")), key("claim",
        "family", X.family(F.col("modelId"))))
    keys = F.concat(*[F.when(F.col(c).isNotNull(), a).otherwise(F.filter(a, lambda x: F.lit(False))) for c, a in (("compute", of_compute),
        ("claim", of_claim))])
    each = found.select("_row", "createdAt", F.inline(keys)).where("key IS NOT NULL")
    first = each.where("createdAt <> ''").groupBy("which", "key").agg(F.min("createdAt").alias("first"))
    least = lambda which: F.min(F.when(F.col("which") == which, F.col("first"))).alias(f"_{which}")
    of = each.join(first, ["which", "key"]).groupBy("_row").agg(least("compute"), least("claim"))
    out = found.join(of, "_row", "left")
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.col(c).withField("earliest", F.col(f"_{c}"))) for c in ("compute",
        "claim")}).drop("_row", "_compute", "_claim")
