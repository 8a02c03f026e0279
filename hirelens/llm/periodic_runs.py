"""Maximal periodic runs of words by a dictionary of basic factors.

For each power of two L, every place of a text gets a name: places share it if the same L words follow. Names of length
2L are pairs of names of length L. A factor's next occurrence, if it begins at most 2L words later, is its successor;
consecutive places whose successors are equally far form an arithmetic progression, which proposes that distance as a
period. Proposals are extended as far as the period holds, and equal runs are kept once.

A run of period q and at least 4q words is always proposed: at the smallest L >= q, a factor that starts in its first
2q words recurs after q words and not before. Texts of a batch are named together, a place keeping its text apart from
others, and places whose factor is the only one of its kind in its text are left out of longer names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.encoding import slices
from hirelens.llm.shared import WORD, table

WORDS = re.compile(WORD).findall
#: A run has so many periods, and so many words, at least.
LEAST_EXPONENT, LEAST_WORDS = 4, 6
#: Words that are named together; a longer text is named alone.
TOGETHER = 400_000


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, names in that order, whether another key is equal) of integer keys; places of equal keys ascend."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    new = np.concatenate(([True], held[1:] != held[:-1]))
    alone = new & np.concatenate((new[1:], [True]))
    return order, np.cumsum(new) - 1, ~alone


def proposals(words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, place behind the last, period) of stretches of `words` that repeat with a period, per length of
    factors. words: ids, of which no two texts share one; ends: of each place, that of its text."""
    at, names, length = np.arange(len(words)), words, 1
    while len(at):
        order, name, shared = _names(names)
        at = at[order]
        # the next place of the same name, where there is one
        near = np.flatnonzero((name[1:] == name[:-1]) & (at[1:] - at[:-1] <= 2 * length))
        place, gap = at[near], at[near + 1] - at[near]
        by_place = np.argsort(place)
        place, gap = place[by_place], gap[by_place]
        if len(place):
            new = np.concatenate(([True], (place[1:] != place[:-1] + 1) | (gap[1:] != gap[:-1])))
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(place)])) - 1
            start, period, end = place[first], gap[first], place[last] + gap[first] + length
            enough = end - start >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period)
            yield start[enough], end[enough], period[enough]
        # names of twice the length, of places whose factor recurs and is followed by one that does
        at, name = at[shared], name[shared]
        by_place = np.argsort(at)
        at, name = at[by_place], name[by_place]
        follower = np.searchsorted(at, at + length)
        follower[follower == len(at)] = 0
        whole = (at[follower] == at + length) & (at + 2 * length <= ends[at]) if len(at) else np.zeros(0, bool)
        names = name[whole] * (len(words) + 1) + name[follower[whole]]
        at, length = at[whole], 2 * length


def find_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of the texts that lie in `words`, in order. starts, ends: of each place,
    those of its text."""
    found = set()
    for some in proposals(words, ends):
        for start, end, period in zip(*(x.tolist() for x in some), strict=True):
            low, high = starts[start], ends[start]
            while start > low and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while end < high and words[end] == words[end - period]:
                end += 1
            found.add((start, end, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_tail(words: list[str], doc_id: int | None) -> list[str]:
    """The contract's rows with periodic tails: of one document in ten, chosen by its id, the words from some place on
    repeat with a period of a third of them at most. Others, and those without an id, stay as they are."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _digests(texts: list[list[str]]) -> Iterator[tuple]:
    """Columns of each text but doc_id, texts named together."""
    ids: list[int] = []
    n = 0
    for words in texts:  # ids of a text's own words, none of which another text has
        own: dict[str, int] = {}
        ids += [own.setdefault(w, n + len(own)) for w in words]
        n += len(own)
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    runs = iter(find_runs(np.array(ids, np.int64), np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)))
    run = next(runs, None)
    for words, base, end in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
        own_runs = []
        while run and run[0] < end:
            own_runs.append((run[0] - base, run[1] - run[0], run[2]))
            run = next(runs, None)
        yield _row(words, own_runs)


def _row(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    best, kept = None, words
    if runs:
        best = runs[0]
        for r in runs[1:]:  # by start, then period: ties leave the earlier one
            if r[1] * best[2] > best[1] * r[2]:
                best = r
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        kept = [w for w, dropped in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not dropped]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, _sha(listed), " ".join(kept), _sha(" ".join(kept)), runs)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "collapsed_sha256", "runs")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
KIND = pa.schema([(x, pa.int64()) for x in NAMES[:6]] + [(x, pa.string()) for x in NAMES[6:9]] + [("runs", pa.list_(RUN))])
KIND_SQL = ", ".join(f"{x} long" for x in NAMES[:6]) + ", runs_sha256 string, collapsed string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, repeat_tails: bool = False, keep_texts: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_runs, start, length, period and exponent_milli of the run of
    greatest exponent (ties: smallest start, then period), runs_sha256, collapsed_sha256; with keep_texts also
    `collapsed`, the text without what repeats, and `runs`, else null.

    A run is a stretch of words of smallest period q and at least max(6, 4q) words that can't be extended. A word is
    left out of `collapsed` if a run holds it behind that run's first q words. repeat_tails: see `repeated_tail`.
    Null, empty and blank texts have no words: no runs, four nulls, hashes of the empty string. Repeated rows and null
    ids are rows of their own; other columns are ignored; no rows give none.
    """

    def find(batches):
        for batch in batches:
            for some in slices(batch, max_bytes=4_000_000):
                held: list[tuple] = []
                n = 0
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    words = WORDS(text or "")
                    held.append((doc_id, repeated_tail(words, doc_id) if repeat_tails else words))
                    n += len(words)
                    if n > TOGETHER:
                        yield rows(held)
                        held, n = [], 0
                if held:
                    yield rows(held)

    def rows(held):
        found = [(doc_id, *x) for (doc_id, _), x in zip(held, _digests([w for _, w in held]), strict=True)]
        if not keep_texts:
            found = [(*r[:7], None, r[8], None) for r in found]
        else:
            found = [(*r[:9], [dict(zip(("start", "length", "period"), x, strict=True)) for x in r[9]]) for r in found]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), KIND, strict=True)], schema=KIND)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, KIND_SQL)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), repeat_tails=True).drop("collapsed", "runs")
