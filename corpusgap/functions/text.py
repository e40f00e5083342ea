"""Column expressions over strings: cleaning, keys, tokens, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders of optional filters.
PLACEHOLDERS = ("", "string", "none", "null", "undefined", "all", "any")

# Venue aliases.
VENUE_ALIASES = {
    "icml": ("icml", "international conference on machine learning"),
    "neurips": ("neurips", "nips", "conference on neural information processing systems", "advances in neural information processing systems"),
    "iclr": ("iclr", "international conference on learning representations"),
    "acl": ("acl", "annual meeting of the association for computational linguistics"),
    "emnlp": ("emnlp", "empirical methods in natural language processing"),
    "cvpr": ("cvpr", "computer vision and pattern recognition"),
    "iccv": ("iccv", "international conference on computer vision"),
    "eccv": ("eccv", "european conference on computer vision"),
    "aaai": ("aaai", "aaai conference on artificial intelligence"),
    "kdd": ("kdd", "knowledge discovery and data mining"),
}


def squeezed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """White space collapsed; empty is null."""
    return F.nullif(squeezed(c), F.lit(""))


def title_key(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(F.coalesce(clean_text(c), F.lit(""))), r"[^a-z0-9\s]", ""))


def venue_key(c: Column) -> Column:
    """Lower case, without bracketed parts, years and leading 'Proceedings of the 40th annual'."""
    text = F.lower(F.coalesce(clean_text(c), F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), r"\b(19|20)\d{2}\b", " ")
    text = F.regexp_replace(text, r"^(?:(?:the )?proceedings of (?:the )?|workshops? at |\d+(?:st|nd|rd|th) (?:annual )?|annual )+", "")
    return squeezed(F.regexp_replace(text, r"[^a-z0-9 ]+", " "))


def venue_terms(c: Column) -> Column:
    """The aliases of a venue, or its own lower-case name."""
    name = F.lower(clean_text(c))
    aliases = F.create_map(*[x for k, v in VENUE_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.when(name.isNotNull(), F.coalesce(F.try_element_at(aliases, name), F.array(name)))


def venue_matches(venue: Column, target: Column, strict: bool = False) -> Column:
    """No target matches all; a missing venue matches no target."""
    key, terms = venue_key(venue), venue_terms(target)
    hit = F.array_contains(terms, key) if strict else F.exists(terms, lambda t: F.contains(key, t))
    return terms.isNull() | ((key != "") & hit)


def optional(c: Column) -> Column:
    return F.when(~F.lower(F.btrim(c)).isin(*PLACEHOLDERS), F.btrim(c))


def year_range(c: Column) -> Column:
    """(low, high, bad) of 'YYYY' or 'YYYY-YYYY'; placeholders give nulls."""
    text = optional(c)
    low = F.regexp_extract(text, r"^(\d{4})(?:\s*-\s*(\d{4}))?$", 1)
    high = F.regexp_extract(text, r"^(\d{4})(?:\s*-\s*(\d{4}))?$", 2)
    low_n, high_n = F.try_to_number(F.nullif(low, F.lit("")), F.lit("9999")).cast("int"), F.try_to_number(F.nullif(high, F.lit("")), F.lit("9999")).cast("int")
    bad = text.isNotNull() & (low_n.isNull() | (F.coalesce(high_n, low_n) < low_n))
    return F.struct(low_n.alias("low"), F.coalesce(high_n, low_n).alias("high"), F.coalesce(bad, F.lit(False)).alias("bad"))


def token_text(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(c), r"[^a-z0-9\s_-]", " "))


def phrases(c: Column) -> Column:
    """Normalised phrases in order, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: token_text(x)), lambda x: x != ""))


def sentences(c: Column) -> Column:
    """Parts between full stops of more than ten characters."""
    parts = F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), r"\.")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" ."))), lambda p: F.length(p) > 10)


def cited_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))


def cited_sentences(c: Column) -> Column:
    """(sentence without markers, numbers) of the sentences longer than 15 characters that cite."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.struct(F.btrim(F.regexp_replace(s, r"\[\d+\]", "")).alias("sentence"), cited_numbers(s).alias("numbers")))
    return F.filter(parts, lambda p: (F.length(p["sentence"]) > 15) & (F.size(p["numbers"]) > 0))


# What stands for nothing in papers, reports and model outputs.
JUNK = {
    "paper": ("null", "undefined", "[object object]", "none", "n/a", "unknown", "string"),
    "report": ("null", "undefined", "[object object]", "none", "n/a", "unknown", "string", "empty"),
    "model": ("null", "[object object]", "none", "n/a", "unknown", "string", "empty", "all", "any", "javascript:void(0)"),
}


def scrub(c: Column, variant: str = "paper") -> Column:
    """Without the word 'undefined', trimmed; junk and nothing are null."""
    text = F.btrim(F.regexp_replace(c.cast("string"), r"(?i)\bundefined\b", ""))
    low = F.lower(text)
    junk = low.isin(*JUNK[variant]) | F.regexp_replace(low, "[^a-z0-9]", "").isin(*JUNK[variant])
    return F.when((text != "") & ~junk, text)


# Words that may open a theme and are left out.
FILLERS = (
    "in addition", "furthermore", "however", "additionally", "moreover", "we", "our", "this", "the", "after", "although", "since", "as a result", "due to",
    "based on", "given that", "it is", "there is", "there are", "which", "that",
)


def shortened_theme(c: Column, words: int = 4) -> Column:
    """The first words of a phrase without one leading filler, as a sentence."""
    bare = F.btrim(F.regexp_replace(c, r"(?i)^(?:" + "|".join(FILLERS) + r")\b[,\s]*", ""), F.lit(" .,;:"))
    short = F.array_join(F.slice(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), 1, words), " ")
    text = F.when(short != "", short).otherwise(F.substring(c, 1, 40))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def json_object(c: Column) -> Column:
    """The JSON in a model's answer: without code fences and what follows the last bracket; null if there is none."""
    text = F.btrim(F.regexp_replace(c, r"(?m)^```(?:json)?|```$", ""), F.lit(" \n\r\t"))
    whole = F.when(F.try_parse_json(text).isNotNull(), text)
    cut = F.regexp_extract(text, r"(?s)^(\{.*\}|\[.*\])", 1)
    return F.coalesce(whole, F.when((cut != "") & F.try_parse_json(cut).isNotNull(), cut))


def deduped_words(c: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")), " ")


def embedding_text(abstract: Column, title: Column, methods: Column, limitations: Column, future_work: Column, chars: int = 800) -> Column:
    """What a paper's vector is made from: abstract first, then title, methods, limitations and future work (the cuts are the feature)."""
    some = lambda c, n: F.array_join(F.filter(F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), deduped_words), lambda x: x != ""), " ")
    parts = F.array(deduped_words(F.substring(abstract, 1, chars)), deduped_words(title), some(methods, 3), some(limitations, 5), some(future_work, 5))
    text = F.btrim(F.array_join(F.filter(parts, lambda p: p != ""), ". "), F.lit(" ."))
    return F.when(text != "", text).otherwise("unknown research gap")


def short_text(title: Column, abstract: Column, sep: str = ". ") -> Column:
    return F.btrim(F.concat_ws(sep, F.nullif(title, F.lit("")), F.nullif(abstract, F.lit(""))), F.lit(" ."))


def picked(*columns: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.nullif(F.btrim(c), F.lit("")) for c in columns])


# Identifier patterns of papers.
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
IDENTIFIERS = (
    ("semantic_scholar", r"^https?://(?:www\.)?semanticscholar\.org/paper/(?:[^/]+/)?([a-fA-F0-9]{40})$"),
    ("openalex", r"^(?:https?://openalex\.org/)?(W\d{6,12})$"),
    ("arxiv", r"^(?:https?://arxiv\.org/(?:abs|pdf)/)?(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$"),
    ("doi", rf"^(?:https?://(?:dx\.)?doi\.org/)?({DOI})$"),
)


def identified(c: Column) -> Column:
    """(source, external_id, paper_id) of a DOI, arXiv, Semantic Scholar or OpenAlex id or address; null if it is none."""
    text = F.regexp_replace(F.btrim(c), "/+$", "")
    out = F.lit(None).cast("struct<source: string, external_id: string, paper_id: string>")
    prefix = {"semantic_scholar": "", "openalex": "OA:", "arxiv": "ARX:", "doi": "DOI:"}
    for source, pattern in reversed(IDENTIFIERS):
        found = F.regexp_extract(text, pattern if source == "openalex" else "(?i)" + pattern, 1)
        found = F.lower(found) if source in ("doi", "semantic_scholar") else found
        hit = F.struct(F.lit(source).alias("source"), found.alias("external_id"), F.concat(F.lit(prefix[source]), found).alias("paper_id"))
        out = F.when(found != "", hit).otherwise(out)
    return out


def node_reference(c: Column) -> Column:
    """(source, external_id) of a node's id by its prefix; 40 hex digits are Semantic Scholar's."""
    known = {"OA:": "openalex", "DOI:": "doi", "ARX:": "arxiv", "TTL:": "title"}
    out = F.when(c.rlike("^[0-9a-f]{40}$"), F.struct(F.lit("semantic_scholar").alias("source"), c.alias("external_id")))
    for prefix, source in known.items():
        rest = F.substring(c, F.lit(len(prefix) + 1), F.length(c))
        out = F.when(F.startswith(c, F.lit(prefix)), F.struct(F.lit(source).alias("source"), rest.alias("external_id"))).otherwise(out)
    return out


def split_key(c: Column) -> Column:
    parts = F.split(c, ":", 2)
    return F.struct(F.element_at(parts, 1).alias("source"), F.try_element_at(parts, F.lit(2)).alias("external_id"))


def capped_authors(names: Column, most: int = 6) -> Column:
    """The first ``most`` names that aren't blank."""
    return F.slice(F.filter(F.transform(names, lambda n: F.btrim(n)), lambda n: n.isNotNull() & (n != "")), 1, most)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))


# Words that make a gap one of evaluation, then of deployment; actions by words of a gap and by assumption.
EVALUATION_WORDS = ("robust", "metric", "benchmark", "baseline", "evaluation", "reward", "transfer")
DEPLOYMENT_WORDS = ("deploy", "real world", "scal", "sensor", "partial observability", "communication")
ASSUMPTION_ACTIONS = {
    "full_observability": "Evaluate leading methods under partial observability, delayed sensing, or missing-state conditions, and report robustness and recovery metrics.",
    "stationary_environment": "Benchmark methods under non-stationary dynamics and changing agent behavior to test adaptation under drift.",
    "fixed_agent_count": "Evaluate whether methods still work when the number of agents changes over time and report scaling behavior explicitly.",
}
OTHER_ASSUMPTION_ACTION = "Relax the dominant simplifying assumption and test whether leading methods remain effective under more realistic conditions."
TEXT_ACTIONS = {
    "robust|sensor|partial observability": "Build a robustness benchmark with observability degradation, sensor noise, and communication failure, and compare leading methods on reward, failure rate, and recovery latency.",
    "scal": "Run scaling studies over larger agent counts and tighter communication budgets, and report performance-efficiency tradeoffs.",
    "deploy": "Evaluate methods in more realistic deployment settings, including non-ideal sensing, delayed feedback, and operational constraints.",
}
OTHER_TEXT_ACTION = "Turn this recurring weakness into a focused benchmark or ablation study and compare against strong baselines under the missing condition."


def category(text: Column, default: str = "methodology") -> Column:
    t = F.lower(text)
    return F.when(t.rlike("|".join(EVALUATION_WORDS)), "evaluation").when(t.rlike("|".join(DEPLOYMENT_WORDS)), "deployment").otherwise(default)


def suggested_action(text: Column, category: Column, of_assumption: bool = False) -> Column:
    out = F.lit(OTHER_ASSUMPTION_ACTION if of_assumption else OTHER_TEXT_ACTION)
    if of_assumption:
        for name, action in ASSUMPTION_ACTIONS.items():
            out = F.when(text == name, action).otherwise(out)
        return out
    for words, action in reversed(TEXT_ACTIONS.items()):
        hit = F.lower(text).rlike(words)
        out = F.when(hit | (category == "deployment") if words == "deploy" else hit, action).otherwise(out)
    return out


def listed(items: Column, most: int = 3) -> Column:
    """'a', 'a and b' or 'a, b, and c' of the first items that aren't empty."""
    shown = F.slice(F.filter(F.transform(items, lambda i: F.btrim(F.replace(i, F.lit("_"), F.lit(" ")))), lambda i: i != ""), 1, most)
    n = F.size(shown)
    many = F.concat(F.array_join(F.slice(shown, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(shown, -1))
    return F.when(n == 0, "").when(n <= 2, F.array_join(shown, " and ")).otherwise(many)


def fingerprint(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def strip_doi(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(c), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", ""))


def request_fingerprint(**fields: Column) -> Column:
    """A hash of named request fields, in the order of their names."""
    return F.md5(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())])).cast("binary"))


def paper_key(source: Column, external_id: Column) -> Column:
    """source:external_id; a missing part raises an error when the row is read."""
    bad = source.isNull() | (source == "") | external_id.isNull() | (external_id == "")
    return F.when(bad, F.raise_error(F.lit("a paper key needs a source and an id"))).otherwise(F.concat_ws(":", source, external_id))
