"""Patterns over model cards: training claims, compute, durations, hardware, costs, tokens."""

#: Patterns that decide what a card reports (RE2 dialect).
SCRATCH_CLAIM = r"(?is)\b(pre[- ]?trained|trained)\b.{0,80}\bfrom scratch\b|\bfrom scratch\b.{0,80}\b(pre[- ]?trained|trained)\b|\btrain(ed|ing)?\b.{0,80}\bfrom (a )?random(ly)? init(ialization|ialized)?\b|\brandomly initialized\b.{0,80}\btrain(ed|ing)?\b|\btrained\b.{0,80}\bfrom the ground up\b|обуч(ена|ен|ено|ены|али|алась|ался).{0,80}с нуля|\bentraîn(é|ée)\b.{0,80}\b(à partir de zéro|from scratch)\b"
SCRATCH_NEGATED = r"(?is)\b(not|wasn['’]t|isn['’]t|never|bypass(?:es|ed|ing)?|avoid(?:s|ed|ing)?)\b.{0,80}\b(trained|training|pretrained|pretraining)\b.{0,50}\bfrom scratch\b|\b(without|no)\b.{0,25}\btraining from scratch\b|не.{0,35}обуч(ена|ен|ено|ены|али|алась|ался).{0,35}с нуля"
SCRATCH_OF_PART = r"(?is)\b(tokenizer|tokeniser|токенизатор|vocab(ulary)?|sentencepiece|bpe|vision encoder|visual encoder|visual layers?|projector|projection layer|multimodal projector|embedding layer|channel embeddings?|classification head|decoder (?:layer|module|component|head))\b.{0,100}\b(from scratch|с нуля)\b|\b(from scratch|с нуля)\b.{0,100}\b(tokenizer|tokeniser|токенизатор|vocab(ulary)?|sentencepiece|bpe|vision encoder|visual encoder|visual layers?|projector|projection layer|multimodal projector|embedding layer|channel embeddings?|classification head|decoder (?:layer|module|component|head))\b|\b(?:only\s+)?(?:the\s+)?decoder\b.{0,80}\b(from scratch|с нуля)\b.{0,100}\b(?:encoder|backbone)\b.{0,50}\b(?:frozen|pre[- ]?trained)\b|(?:токенизатор|проектор|слой|эмбеддинг).{0,100}обуч(ен|ена).{0,30}с нуля"
RANDOM_PART = r"(?is)\b(tokenizer|tokeniser|vocab(?:ulary)?|vision encoder|visual encoder|projector|projection layer|multimodal projector|embedding(?: matrix| layer)?|channel embeddings?|classification head|decoder (?:layer|module|component|head))\b.{0,100}\b(randomly initialized|random initialization|initialized from scratch)\b|\b(randomly initialized|random initialization|initialized from scratch)\b.{0,100}\b(tokenizer|tokeniser|vocab(?:ulary)?|vision encoder|visual encoder|projector|projection layer|multimodal projector|embedding(?: matrix| layer)?|channel embeddings?|classification head|decoder (?:layer|module|component|head))\b"
SCRATCH_NOT_DONE = r"(?is)\b(for comparison|compared (?:with|to)|typically|would|could|estimated?|hypothetical|instead of|rather than|versus|vs\.?|example of|recipe for|guide to|how to|difficulty of|allow(?:s|ed|ing)?|demo|notebook|to[- ]?do|ongoing|implement)\b.{0,160}\b(?:train(?:ed|ing)?|pretrain(?:ed|ing)?)?\b.{0,70}\bfrom scratch\b|\b(?:fewer|less)\s+(?:tokens?|flops?|compute|steps?|time)\b.{0,80}\bthan\b.{0,80}\b(?:training|pretraining)\s+from scratch\b|\bwhen\s+(?:training|pretraining)\s+(?:a|an|the|such)\s+(?:model|network|system)\b.{0,100}\bfrom scratch\b|\b(?:pre[- ]?trained|trained)\s+from scratch\s*\(\s*or\s+fine[- ]?tuned\s*\)"
DERIVATIVE_NEARBY = r"(?is)\b(?:this|the|our)\s+(?:model|checkpoint)\s+(?:is|was|has been)\s+(?:(?:further|subsequently|then)\s+)?(?:fine[- ]?tuned|instruction[- ]?tuned|post[- ]?trained|converted|distilled)\b|\bthis\s+(?:model\s+)?(?:is|was)\s+(?:an?\s+)?(?:fine[- ]?tuned|instruction[- ]?tuned|post[- ]?trained|converted|distilled)\s+(?:model|checkpoint|iteration|version)\b|\bas\s+an?\s+(?:fine[- ]?tuned|instruction[- ]?tuned|post[- ]?trained)\s+(?:model|iteration|version)\b"
DERIVATIVE_ITSELF = r"(?is)\bthis\s+(?:model|checkpoint|iteration|version)\s+(?:is|was|has been)\s+(?:(?:further|subsequently|then)\s+)?(?:fine[- ]?tuned|instruction[- ]?tuned|post[- ]?trained|converted|distilled)\b|\bthis\s+(?:model\s+)?(?:is|was)\s+(?:an?\s+)?(?:fine[- ]?tuned|instruction[- ]?tuned|post[- ]?trained|converted|distilled)\s+(?:model|checkpoint|iteration|version)\b|\b(?:current|released|resulting|final)\s+(?:model|checkpoint|iteration|version)\s+(?:is|was|has been)\s+(?:(?:further|subsequently|then)\s+)?(?:fine[- ]?tuned|instruction[- ]?tuned|post[- ]?trained|converted|distilled)\b"
DERIVATIVE_SEQUENCE = r"(?is)\b(?:trained|pre[- ]?trained)\b.{0,90}\bfrom scratch\b.{0,220}\b(?:(?:followed by|post[- ]?training included).{0,80}(?:supervised fine[- ]?tuning|instruction fine[- ]?tuning|RLOO|RLHF|QRPO)|(?:then underwent|and (?:was )?)(?:supervised |instruction )?fine[- ]?tuned)\b|\bfrom scratch\b.{0,180}\band (?:was )?(?:supervised |instruction )?fine[- ]?tuned\b|\b(?:supervised fine[- ]?tuning|instruction fine[- ]?tuning|alignment)\b.{0,180}\b(?:trained end[- ]to[- ]end from random initialization|trained from scratch)\b|\b(?:enhanced[,]?\s*)?instruction[- ]?tuned\s+(?:iteration|version)\b"
SCRATCH_UPSTREAM = r"(?is)\b(?:based on|initialized from|uses?)\b.{0,120}\bpre[- ]?trained\b.{0,120}\b(?:trained|built)\b.{0,70}\bfrom scratch\b"
GPU_HOURS_LABELLED = r"(?i)(?:(?:gpu|h\s*100(?:\s+gpu)?)[-_ ]?(?:hours?|hrs?|h)(?:\s+(?:used|required))?|total\s+(?:h\s*100\s+)?gpu[-_ ]?(?:hours?|hrs?|h)|hours?[_ ]used\s*\(\s*total\s+gpu[-_ ]?(?:hours?|hrs?|h)\s*\))[*_ ]*[:=]?[*_ ]*([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)(?:\s*(k|m|thousand|million))?\s*h?\b"
GPU_HOURS_VALUE_FIRST = r"(?i)\b([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)(?:\s*(k|m|thousand|million))?\s*(?:gpu[-_ ]?(?:hours?|hrs?|h)|h\s*100(?:[-_ ]?gpu)?[-_ ]?(?:hours?|hrs?|h))\b"
DURATION_LABELLED = r"(?i)(?:(?:total\s+)?(?:pre[- ]?training|training|fine[- ]?tuning)\s+(?:time|duration)|train(?:ing)?[_ -]?runtime|hours?[_ ]used|(?:pre[- ]?training|training|fine[- ]?tuning)\s+took)[^\n]{0,60}?((?:[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:months?|weeks?|days?|hours?|hrs?|minutes?|mins?|seconds?|secs?|[hms])\s*(?:(?:,|and)\s*)?){1,4})"
TRAINED_FOR = r"(?i)(?:pre[- ]?trained|trained|fine[- ]?tun(?:e|ed))\s+for\s*(?:approximately|about|around|roughly|~)?\s*((?:[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:months?|weeks?|days?|hours?|hrs?|minutes?|mins?|seconds?|secs?|[hms])\s*(?:(?:,|and)\s*)?){1,4})"
TPU_RUNTIME = r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*(TPU(?:[- ]?V?\d+)?)[-_ ](\d+)\s*(?:hours?|hrs?|h)\b"
DURATION_PART = r"(?i)([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)\s*(months?|weeks?|days?|hours?|hrs?|minutes?|mins?|seconds?|secs?|[hms])"
HARDWARE = r"(?i)(?:(\d+)\s*(?:x|×)?\s*)?(?:GPUs?\s*[:=-]?\s*)?(?:(?:NVIDIA|AMD)\s+)?(H\s*(?:20|100|200)|B\s*200|A\s*(?:10|40|100|6000)|V\s*100|T\s*4|L\s*4(?:0S?)?|RTX\s*[0-9]{4}|MI\s*[0-9][0-9A-Z]*|TPU(?:[- ]?V?\d+)?)\b[^\n,;]{0,35}?(?:\s+(?:nodes?\s*)?(?:x|×)\s*(\d+))?"
GPU_COUNT_BEFORE = r"(?i)\b(\d+)\s+GPUs\b"
GPU_COUNT_TIMES = r"(?i)\b(\d+)\s*(?:x|×)\s*GPUs?\b"
GPU_COUNT_AFTER = r"(?i)\bGPUs?\s*[:=]\s*(\d+)\b"
CONSUMER_GPU = r"(?i)\b(?:NVIDIA\s+)?((?:20|30|40|50)[0-9]{2})\s*GPU\b"
MODEL_NUMBER_AHEAD = r"(?i)(?:RTX|GeForce|Radeon)\s*$"
NO_GPU = r"(?i)\b(?:CPU(?:-only)?|Apple\s+Silicon|M[1-4]\s+(?:Pro|Max|Ultra))\b"
COST_LABELLED = r"(?i)(?:(?:total\s+|end[- ]to[- ]end\s+)?(?:pre[- ]?training|training|fine[- ]?tuning)\s+cost|cost\s+of\s+(?:pre[- ]?training|training|fine[- ]?tuning)|cost\s+to\s+(?:pre[- ]?train|train|fine[- ]?tune))[^\n$]{0,50}?\$\s*([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)(?:\s*(k|m|thousand|million))?\b"
COST_BARE = r"(?i)\bcost\s*[:=]\s*(?:~|<)?\s*\$\s*([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)(?:\s*(k|m|thousand|million))?\b"
HOURLY_RATE = r"(?i)\$\s*([0-9]+(?:\.[0-9]+)?)\s*(?:/|per\s+)(?:gpu[- ]?)?(?:hour|hr|h)\b"
MIXED_USE = r"(?is)\b(?:train(?:ed|ing)?|pre[- ]?train(?:ed|ing)?|fine[- ]?tun(?:e|ed|ing))\b.{0,45}\b(?:and|or|plus|including)\b.{0,25}\b(?:inferences?|evaluation|serving)\b|\b(?:inferences?|evaluation|serving)\b.{0,45}\b(?:and|or|plus|including)\b.{0,25}\b(?:train(?:ed|ing)?|pre[- ]?train(?:ed|ing)?|fine[- ]?tun(?:e|ed|ing))\b"
AGGREGATE_SCOPE = r"(?i)\b(?:aggregate[ds]?|cumulative|combined|total|all)\b"
TRAINING_DATES = r"(?im)(?:training\s+dates?)[^\n<]{0,160}|(?:^|[\n|>+])\s*\*{0,2}dates\*{0,2}\s*(?::\*{0,2}|\|)\s*[^\n|<]{0,120}"
YEAR = r"\b(20[0-9]{2})\b"
TRAINER = r"(?i)(?:pre[- ]?trained|trained)[^\n]{0,40}?from scratch by\s+([^,.;\n*]{2,60})"
PRETRAINING = r"(?is)\bpre[- ]?train(?:ed|ing)\b.{0,220}\b(?:[0-9]+(?:\.[0-9]+)?\s*(?:trillion|billion|[tb])\s+tokens?|trillions?\s+(?:of\s+)?tokens?|training (?:corpus|corpora|dataset|data)|corpus|corpora|dataset)\b|\b(?:[0-9]+(?:\.[0-9]+)?\s*(?:trillion|billion|[tb])\s+tokens?)\b.{0,180}\b(?:used\s+for\s+)?pre[- ]?train(?:ed|ing)\b|\b(?:the\s+)?model\s+was\s+trained\s+(?:on|with)\b.{0,120}\b[0-9]+(?:\.[0-9]+)?\s*(?:trillion|billion|[tb])\s+tokens?\b|\bfoundation models?\b.{0,260}\b[0-9]+(?:\.[0-9]+)?\s*(?:trillion|billion|[tb])\s+(?:total\s+|active\s+|activated\s+)?parameters?\b"
CONTINUED = r"(?is)\b(?:built|based)\s+(?:up)?on\b.{0,160}\b(?:checkpoint|model|weights?)\b|\b(?:continued|continual|additional|further|continue)\s+pre[- ]?train(?:ed|ing)?\b|\b(?:initialized|initialised|pre[- ]?trained)\s+from\b.{0,100}\b(?:checkpoint|model|weights?|[0-9]+b)\b"
DERIVATIVE_CARD = r"(?is)\b(?:fine[- ]?tuned|instruction[- ]?tuned|post[- ]?trained|distilled)\s+version\s+of\b|\b(?:we|this work)\s+(?:fine[- ]?tune|post[- ]?train|distill)\b|\btraining stage\s*[:|]\s*pre[- ]?training\s*(?:&|and|\+)\s*post[- ]?training\b|\bpost[- ]?training\s+(?:utilizes?|adopts?|uses?|stage|pipeline)\b|\b(?:trained on|built upon)\s+(?:the\s+)?[^.\n]{0,100}\bbase\s+(?:foundation\s+)?model\b|\bundergone\b.{0,100}\b(?:RLHF|reinforcement learning|post[- ]?training)\b"
BASE_NAME = r"(?i)(^|[-_./])base($|[-_./0-9])"
ACTIVE_PARAMETERS = r"(?i)(?:about|approximately|~|≈)?\s*[*_]*([0-9]+(?:\.[0-9]+)?)[*_]*\s*(?:billion|b)\s+(?:activated|active)(?:\s+parameters?)?|(?:activates?|activated parameters(?: per token)?\s*[:=]?)\s*(?:about|approximately|~|≈)?\s*[*_]*([0-9]+(?:\.[0-9]+)?)[*_]*\s*(?:billion|b)\b"
ACTIVE_IN_NAME = r"(?i)[-_]A([0-9]+(?:\.[0-9]+)?)B(?:[-_.]|$)"
TOKENS_ANY = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(trillion|billion|[tb])\+?\s+(?:high[- ]quality\s+|reasoning[- ]dense\s+|multilingual\s+|text\s+|pre[- ]?training\s+)?tokens?\b"
TOKENS_TRAINED = r"(?is)(?:\b(?:the\s+)?(?:model|it)\s+(?:was\s+|is\s+)?(?:pre[- ]?trained|trained)(?:\s+(?:(?:entirely|fully)\s+)?from\s+scratch)?\s+(?:on|with|for)\s+[^.\n]{0,140}?[*_]*([0-9]+(?:\.[0-9]+)?)[*_]*\s*(trillion|billion|[tb])\+?\s+tokens?\b|\bpre[- ]?train(?:ing)?\s+tokens?[*_ ]*[:=]\s*[*_]*\s*([0-9]+(?:\.[0-9]+)?)[*_]*\s*(trillion|billion|[tb])\b|\bpre[- ]?training\s+stage\s*[0-9]*[^\n]{0,80}?([0-9]+(?:\.[0-9]+)?)\s*(trillion|billion|[tb])\s+tokens?\b|\b([0-9]+(?:\.[0-9]+)?)\s*(trillion|billion|[tb])\s+tokens?[^\n]{0,80}?stage\s*[0-9]+\s*[:|-]\s*pre[- ]?training\b)"
TOKENS_PRETRAINED = r"(?i)\bpre[- ]?trained\b[^.\n]{0,120}?\b(?:on|with|for)\s+[^.\n]{0,100}?[*_]*([0-9]+(?:\.[0-9]+)?)[*_]*\s*(trillion|billion|[tb])\+?\s+tokens?\b"
DERIVATIVE_EVIDENCE = r"(?i)\b(fine[- ]?tun(?:e|ed|ing)|instruction[- ]?tun(?:e|ed|ing)|post[- ]?train(?:ed|ing)|continued pretraining|continual pretraining|domain adaptation|distill(?:ed|ation)|\bSFT\b|\bDPO\b|\bRLHF\b|\bGRPO\b)\b"
ADAPTER_EVIDENCE = r"(?i)\b(LoRA|QLoRA|PEFT|adapter)\b"

#: Trillions of training tokens and billions of active parameters of repositories whose cards do not say.
KNOWN_TOKENS_T = {"allenai/olmo-3-1125-32b": 5.5, "allenai/olmo-3-1025-7b": 5.93}
KNOWN_ACTIVE_B = {
    "zai-org/glm-4.5-base": 32,
    "zai-org/glm-4.5-air-base": 12,
    "ibm-granite/granite-4.0-h-small-base": 9,
    "ibm-granite/granite-4.0-h-tiny-base": 1,
    "ibm-granite/granite-4.0-tiny-base-preview": 1,
}
