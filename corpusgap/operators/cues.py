"""All cues of a text in one pass: an automaton over every cue of every kind of evidence.

A text is lowered and read once, whatever the number of cues; each occurrence names its
cue and the sentence it stands in.  Sentences are cut out only where a cue was met.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The evidence columns by kind.
FIELDS = {
    "limitation": "limitations", "future_work": "future_work", "metric": "metrics", "assumption": "assumptions",
    "dataset": "datasets", "baseline": "baselines", "method": "method",
}

_ACRONYM = re.compile(r"\b([A-Z]{2,}(?:-[A-Z0-9]+)*)\b")
_SHORTEST = 10
#: Bytes of texts whose evidence is held at a time; a batch of Spark's may have far more.
_PIECE = 1 << 20


class CueMatcher:
    """The evidence of given kinds in a title and a text, by the cues of a lexicon."""

    def __init__(self, lexicon, kinds: Sequence[str]):
        self.kinds, self.lexicon = [k for k in FIELDS if k in kinds], lexicon
        self.in_text: dict[str, list[tuple[str, int]]] = defaultdict(list)
        self.in_sentence: dict[str, list[tuple[str, int]]] = defaultdict(list)
        if "limitation" in kinds:
            self._sentence_cues("limitation", [lexicon.limitations])
            self._sentence_cues("limitation_intro", [lexicon.limitation_intros])
            self._text_cues("triggered", lexicon.triggered.values())
        if "future_work" in kinds:
            self._sentence_cues("future_work", [lexicon.future_work])
            self._sentence_cues("future_intro", [lexicon.future_intros])
        if "assumption" in kinds:
            self._sentence_cues("assumption", lexicon.assumptions.values())
        if "metric" in kinds:
            self._text_cues("metric", lexicon.metrics.values())
        if "baseline" in kinds:
            self._text_cues("baseline", lexicon.baselines.values())
        if "dataset" in kinds:
            self._text_cues("dataset", [[d.lower()] for d in lexicon.datasets])
            self.no_acronyms = {*lexicon.datasets, *lexicon.no_datasets}
        if "method" in kinds:
            self._text_cues("method", [[m] for m in lexicon.methods])
            self.longest_method = max(map(len, lexicon.methods), default=0)
        self.automaton = ahocorasick.Automaton()
        for cue in {*self.in_text, *self.in_sentence}:
            self.automaton.add_word(cue, (cue, len(cue), self.in_text.get(cue, ()), self.in_sentence.get(cue, ())))
        self.automaton.make_automaton()

    def _text_cues(self, role: str, groups) -> None:
        for i, cues in enumerate(groups):
            for cue in cues:
                self.in_text[cue].append((role, i))

    def _sentence_cues(self, role: str, groups) -> None:
        for i, cues in enumerate(groups):
            for cue in cues:
                self.in_sentence[cue].append((role, i))

    def _hits(self, low: str) -> Iterator[tuple[int, tuple]]:
        return self.automaton.iter(low) if len(self.automaton) else iter(())

    def scan(self, text: str) -> tuple[set[tuple[str, int]], dict[int, tuple[str, set[tuple[str, int]]]]]:
        """(roles of the whole text, {place of a sentence: (sentence, its roles)})."""
        whole: set[tuple[str, int]] = set()
        parts: dict[int, set[tuple[str, int]]] = defaultdict(set)
        flat = text.replace("\n", " ")
        raw, low = text.lower(), flat.lower()
        if len(low) != len(flat):
            return self._scan_apart(raw, flat)
        stops = [m.start() for m in re.finditer(r"\.", flat)] if self.in_sentence else []
        cut = [-1, *stops, len(flat)]
        for end, (cue, size, of_text, of_sentence) in self._hits(low):
            start = end - size + 1
            if of_text and (raw is low or raw[start : end + 1] == cue):
                whole.update(of_text)
            if of_sentence:
                at = bisect_left(stops, start)
                if end < cut[at + 1] and not parts[at].issuperset(of_sentence):
                    if cue[0] in " ." or cue[-1] in " .":  # may lie in what is trimmed off
                        if cue not in low[cut[at] + 1 : cut[at + 1]].strip(" ."):
                            continue
                    parts[at].update(of_sentence)
        if "\n" in text:
            whole.update(role for cue, roles in self.in_text.items() if "\n" in cue and cue in raw for role in roles)
        said = {at: (flat[cut[at] + 1 : cut[at + 1]].strip(" ."), roles) for at, roles in sorted(parts.items()) if roles}
        return whole, {at: x for at, x in said.items() if len(x[0]) > _SHORTEST}

    def _scan_apart(self, raw: str, flat: str):
        """The same where lowering changes lengths: sentence after sentence."""
        whole = {role for _, (_, _, of_text, _) in self._hits(raw) for role in of_text}
        said = {}
        for at, part in enumerate(flat.split(".")):
            sentence = part.strip(" .")
            roles = {role for _, (_, _, _, of_sentence) in self._hits(sentence.lower()) for role in of_sentence}
            if roles and len(sentence) > _SHORTEST:
                said[at] = (sentence, roles)
        return whole, said

    def evidence(self, title: str | None, text: str | None) -> list:
        """The values of the asked kinds, in the order of ``FIELDS``."""
        text = text or ""
        whole, said = self.scan(text)
        names = lambda role, table: [name for i, name in enumerate(table) if (role, i) in whole]
        out = []
        for kind in self.kinds:
            if kind == "limitation":
                found = [s for s, roles in said.values() if ("limitation", 0) in roles and ("limitation_intro", 0) not in roles]
                out.append(list(dict.fromkeys(found + names("triggered", self.lexicon.triggered))))
            elif kind == "future_work":
                out.append([s for s, roles in said.values() if ("future_work", 0) in roles and ("future_intro", 0) not in roles])
            elif kind == "assumption":
                out.append(list(dict.fromkeys(name for _, roles in said.values() for i, name in enumerate(self.lexicon.assumptions) if ("assumption", i) in roles)))
            elif kind == "dataset":
                acronyms = [a for a in _ACRONYM.findall(text) if 2 < len(a) <= 12 and a not in self.no_acronyms]
                out.append(list(dict.fromkeys(names("dataset", self.lexicon.datasets) + acronyms)))
            elif kind == "method":
                head = "" if title is None else f"{title}. {text[: self.longest_method]}".lower()
                out.append(next((m for i, m in enumerate(self.lexicon.methods) if ("method", i) in whole or m in head), None))
            else:
                out.append(names(kind, self.lexicon.metrics if kind == "metric" else self.lexicon.baselines))
        return out


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from row, to row): runs of rows with at most ``_PIECE`` bytes of text, or of one row."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + _PIECE, side="right")))
        yield start, end
        start = end


def matched(title: Column, text: Column, lexicon, kinds: Sequence[str] = tuple(FIELDS)) -> Column:
    """A struct of the evidence columns of ``kinds``; the text is read once for all of them."""
    asked = [k for k in FIELDS if k in kinds]
    names = [FIELDS[k] for k in asked]
    kind_of = {k: pa.string() if k == "method" else pa.list_(pa.string()) for k in asked}
    schema = ", ".join(f"{FIELDS[k]} {'string' if k == 'method' else 'array<string>'}" for k in asked)

    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        matcher = CueMatcher(lexicon, asked)
        for titles, texts in batches:
            for a, b in pieces(texts):
                rows = [matcher.evidence(t.as_py(), x.as_py()) for t, x in zip(titles[a:b], texts[a:b])]
                yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind_of[k]) for i, k in enumerate(asked)], names)

    return F.arrow_udf(find, f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")(title, text)

