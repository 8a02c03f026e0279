"""What a posting's lines tell, by one pass of an Aho-Corasick automaton over each text.

All marker lists are one automaton, built once per Python worker. A pass over a text's lines gives every list's hits with
their line numbers; levels, years and sponsorship are then decided on small integers. Texts come in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Mapping
from functools import cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelens.functions import vocabulary as V
from hirelens.functions.normalize import LINES, YEARS

NAMES = {rank: level for level, rank in V.DEGREE_RANK.items()}
RULES = "sponsorship string, years int, experience array<string>, level string, education array<string>"


class Markers:
    """Names of the lists whose markers a text holds."""

    def __init__(self, lists: Mapping[str, Iterable[str]]):
        import ahocorasick

        named: dict[str, list[str]] = {}
        for name, markers in lists.items():
            for m in markers:
                named.setdefault(m, []).append(name)
        self.automaton = ahocorasick.Automaton()
        for marker, names in named.items():
            self.automaton.add_word(marker, tuple(names))
        self.automaton.make_automaton()

    def by_line(self, lines: list[str]) -> dict[str, set[int]]:
        """Of each list with a hit, the numbers of the lines that have one. No marker has a line end."""
        ends = list(accumulate(len(x) + 1 for x in lines))
        found: dict[str, set[int]] = {}
        for at, names in self.automaton.iter("\n".join(lines)):
            line = bisect_right(ends, at)
            for name in names:
                found.setdefault(name, set()).add(line)
        return found


@cache
def _rules() -> Markers:
    levels = {f"level {level}": markers for level, markers in V.DEGREE_LINE_MARKERS.items()}
    return Markers({"education": V.DEGREE_CONTEXT, "experience": V.EXPERIENCE_CONTEXT, "denied": V.SPONSORSHIP_DENIED, "offered": V.SPONSORSHIP_OFFERED, **levels})


def _pattern(java: str) -> re.Pattern:
    return re.compile(java, re.ASCII)


SPLIT, YEARS_IN = re.compile(LINES), _pattern(YEARS)
#: Patterns of lines about education and the rank that each tells.
PATTERNS = [*((_pattern(p), V.DEGREE_RANK[level], True) for level, p in V.DEGREE_LINE_PATTERNS.items()), (_pattern(V.BACHELOR_OR_MASTER), V.DEGREE_RANK["bachelor"], True), (_pattern(V.NO_DEGREE), V.DEGREE_RANK["none"], False)]


def rules_of(text: str | None) -> tuple:
    """(sponsorship, years, lines about experience, level, lines about education) of a whole text."""
    lines = [x for x in map(str.strip, SPLIT.split(text or "")) if x]
    hits = _rules().by_line([x.lower() for x in lines])
    # years that lines about experience name
    about = [(lines[i], YEARS_IN.findall(lines[i])) for i in sorted(hits.get("experience", ()))]
    asked = [(line, [int(y) for y in years]) for line, years in about if years]
    # ranks that each line tells; markers count on lines about education, some patterns say that a line is
    told = {i: {V.DEGREE_RANK[name[6:]] for name, at in hits.items() if name.startswith("level ") and i in at} for i in hits.get("education", ())}
    for i, line in enumerate(lines):
        for pattern, rank, tells in PATTERNS:
            if (tells or i in told) and pattern.search(line):
                told.setdefault(i, {V.DEGREE_RANK[name[6:]] for name, at in hits.items() if name.startswith("level ") and i in at}).add(rank)
    said = sorted(i for i, ranks in told.items() if ranks)
    least = min((r for i in said for r in told[i] if r), default=None)
    level = "unknown" if not said else NAMES[least or 0]
    # a phrase may go on over line ends
    joined = " ".join((text or "").split()).lower()
    sponsor = next((answer for answer, exact in V.SPONSORSHIP_EXACT.items() if joined in exact), None)
    if sponsor is None:
        over = _rules().by_line([joined])
        sponsor = "yes" if "denied" in over else "no" if "offered" in over else "unknown"
    return sponsor, max((y for _, ys in asked for y in ys), default=None), list(dict.fromkeys(x for x, _ in asked))[:2], level, list(dict.fromkeys(lines[i] for i in said))[:2]


def text_rules(text: Column) -> Column:
    """struct(sponsorship, years, experience, level, education): see `rules_of`. Null texts tell nothing."""

    def rules(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([rules_of(t) for t in texts], columns=["sponsorship", "years", "experience", "level", "education"])
        return found.astype({"years": "Int32"})

    return F.pandas_udf(rules, RULES)(text)
