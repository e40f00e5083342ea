"""Evidence from titles and abstracts, as one tall table (topic, paper, kind, term)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrases, token_text
from .cues import FIELDS, matched

# Cues of limitations, of future work, and introductions that are neither.
LIMITATION_CUES = (
    "limit", "challenge", "bottleneck", "robust", "trade-off", "downside", "drawback", "lack of", "underexplored", "insufficient", "fragile",
    "expensive", "computationally", "hard to", "difficulty", "poor performance", "fails to", "cannot handle", "unable to", "stagnation", "complexity",
)
FUTURE_CUES = ("future work", "future direction", "next steps", "avenue for research", "remains for future", "beyond the scope", "future studies", "investigate further")
LIMITATION_INTROS = ("this paper", "in this work", "we propose", "we present", "this work")
FUTURE_INTROS = ("this paper", "in this work", "we explore", "we evaluate", "we test")

# Phrases that whole texts trigger.
TRIGGERED_LIMITATIONS = {
    "baseline comparison is limited": ("baseline", "compare", "limited comparison"),
    "evaluation mostly focuses on reward": ("reward", "focus on reward"),
    "robustness under noise or partial observability is underexplored": ("partial observability", "noise", "robust", "uncertainty"),
    "scaling to more agents remains underexplored": ("scal", "more agents", "large teams", "many agents"),
    "high computational overhead": ("overhead", "compute", "costly"),
    "sample inefficiency": ("sample efficiency", "data hungry"),
}

# Metric names by their cues in a text.
METRIC_CUES = {
    "reward": ("reward", "return"),
    "robustness": ("robust",),
    "transfer": ("transfer", "generalization"),
    "sample efficiency": ("sample efficiency", "data efficiency"),
    "safety": ("safety",),
    "latency": ("latency", "delay"),
}

# Assumptions by their cues in a sentence.
ASSUMPTION_CUES = {
    "Full observability": ("full observability", "fully observable"),
    "Partial observability": ("partial observability", "partially observable"),
    "Stationary environment": ("stationary",),
    "Fixed number of agents": ("fixed number of agents", "fixed agents"),
}

# Known datasets, and acronyms that are none.
DATASETS = (
    "SMAC", "MPE", "Hanabi", "Overcooked", "GRF", "Mujoco", "PettingZoo", "Flatland", "Pommerman", "MAgent", "LuxAI", "Neural MMO", "Melting Pot",
    "MNIST", "CIFAR", "ImageNet", "Kuzushiji", "Fashion-MNIST", "Atari", "Gym", "Procgen", "Safety Gym", "DeepMind Lab", "Isaac Gym",
)
NO_DATASETS = (
    "MARL", "RL", "AI", "ML", "PPO", "DQN", "QMIX", "MADDPG", "COMA", "IQL", "VDN", "MAPPO", "IPPO", "CTDE", "MDP", "POMDP", "SGD", "CNN", "RNN",
    "LSTM", "CPU", "GPU", "JAX", "TPU", "CUDA", "RAM", "SOTA",
)
METHODS = ("transformer", "diffusion", "graph neural network", "policy gradient", "value decomposition", "q learning")

# Canonical names of metrics.
METRIC_ALIASES = {
    "reward": "reward", "average reward": "reward", "return": "reward", "accuracy": "accuracy", "acc": "accuracy",
    "sample efficiency": "sample_efficiency", "data efficiency": "sample_efficiency", "robustness": "robustness", "transfer": "transfer",
    "generalization": "transfer", "latency": "latency", "safety": "safety", "fairness": "fairness", "interpretability": "interpretability",
    "reproducibility": "reproducibility",
}

# Canonical names of assumptions, and words of limitations and future work that are written alike.
ASSUMPTION_ALIASES = {
    "full observability": "full_observability", "fully observable setting": "full_observability", "partial observability": "partial_observability",
    "stationary environment": "stationary_environment", "fixed number of agents": "fixed_agent_count",
}
WRITTEN_ALIKE = {"fully observable": "full observability", "partial observation": "partial observability", "noisy sensor": "sensor noise"}


#: The kinds of evidence.
KINDS = ("limitation", "future_work", "assumption", "metric", "dataset", "baseline", "method")


@dataclass(frozen=True)
class Lexicon:
    """The cues of every kind of evidence; the defaults are those of multi-agent learning papers."""

    limitations: Sequence[str] = LIMITATION_CUES
    limitation_intros: Sequence[str] = LIMITATION_INTROS
    triggered: Mapping[str, Sequence[str]] = field(default_factory=lambda: TRIGGERED_LIMITATIONS)
    future_work: Sequence[str] = FUTURE_CUES
    future_intros: Sequence[str] = FUTURE_INTROS
    metrics: Mapping[str, Sequence[str]] = field(default_factory=lambda: METRIC_CUES)
    assumptions: Mapping[str, Sequence[str]] = field(default_factory=lambda: ASSUMPTION_CUES)
    datasets: Sequence[str] = DATASETS
    no_datasets: Sequence[str] = NO_DATASETS
    methods: Sequence[str] = METHODS
    baselines: Mapping[str, Sequence[str]] = field(default_factory=dict)


def _one(kind: str, text: Column, lexicon: Lexicon, title: Column | None = None) -> Column:
    return matched(F.lit(None).cast("string") if title is None else title, text, lexicon, (kind,))[FIELDS[kind]]


def limitations(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Sentences with a cue and without an introduction, then the names that the whole text triggers."""
    return _one("limitation", text, lexicon)


def future_work(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    return _one("future_work", text, lexicon)


def metrics(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Names whose cues occur in the text, in the order of the lexicon."""
    return _one("metric", text, lexicon)


def assumptions(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """In the order of the sentences that name them."""
    return _one("assumption", text, lexicon)


def datasets(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Known datasets in the order of the lexicon, then other acronyms of three to twelve letters."""
    return _one("dataset", text, lexicon)


def method(title: Column, abstract: Column, lexicon: Lexicon = Lexicon()) -> Column:
    return F.initcap(_one("method", abstract, lexicon, title))


def canonical(term: Column, aliases: Mapping[str, str] = METRIC_ALIASES) -> Column:
    name = token_text(term)
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, name), F.replace(name, F.lit(" "), F.lit("_")))


def alike(phrase: Column) -> Column:
    for old, new in WRITTEN_ALIKE.items():
        phrase = F.replace(phrase, F.lit(old), F.lit(new))
    return phrase


def extract(papers: DataFrame, lexicon: Lexicon = Lexicon(), kinds: Sequence[str] = KINDS) -> DataFrame:
    """Papers with the evidence columns of ``kinds``, from title and whole abstract; a ``baselines`` column of the input is kept.

    Every text is read once for all kinds (``cues.matched``).
    """
    given = F.coalesce("baselines", F.array().cast("array<string>")) if "baselines" in papers.columns else F.array().cast("array<string>")
    rows = papers.withColumn("_found", matched(F.col("title"), F.coalesce("abstract", F.lit("")), lexicon, kinds))
    found = {FIELDS[k]: F.col(f"_found.{FIELDS[k]}") for k in kinds}
    if "baseline" in kinds:
        found["baselines"] = F.array_union(given, found["baselines"])
    if "method" in kinds:
        found["method"] = F.initcap(found["method"])
    return rows.withColumns(found).drop("_found")


def normalized(evidence: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Adds the ``normalized_*`` columns of ``kinds``: phrases and canonical names, each once a paper, in order."""
    each = lambda name, f: F.array_distinct(F.transform(phrases(F.col(name)), lambda x: f(x)))
    forms = {
        "limitation": lambda c: each(c, lambda x: alike(x)), "future_work": lambda c: each(c, lambda x: alike(x)),
        "assumption": lambda c: each(c, lambda x: canonical(x, ASSUMPTION_ALIASES)), "metric": lambda c: each(c, lambda x: canonical(x)),
        "dataset": lambda c: phrases(F.col(c)), "baseline": lambda c: phrases(F.col(c)), "method": lambda c: token_text(F.coalesce(c, F.lit(""))),
    }
    return evidence.withColumns({f"normalized_{FIELDS[k]}": forms[k](FIELDS[k]) for k in kinds})


def _of_kind(terms: Column, kind: str) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))


def evidence_long(papers: DataFrame, lexicon: Lexicon = Lexicon(), kinds: Sequence[str] = KINDS) -> DataFrame:
    """(topic_id, paper_id, title, year, citation_count, kind, term): evidence of ``kinds``, in one pass over the texts.

    Kinds that aren't asked for aren't looked for.
    """
    kinds = [k for k in KINDS if k in kinds]
    rows = normalized(extract(papers, lexicon, kinds), kinds)
    parts = []
    for kind in kinds:
        name = f"normalized_{FIELDS[kind]}"
        terms = F.filter(F.array(name), lambda t: t != "") if kind == "method" else F.col(name)
        parts.append(_of_kind(terms, kind))
    rows = rows.select("topic_id", F.col("external_id").alias("paper_id"), "title", "year", "citation_count", F.explode(F.concat(*parts)).alias("e"))
    return rows.select("topic_id", "paper_id", "title", "year", "citation_count", "e.kind", "e.term")
