"""Toxicity by a classifier chain: linear models in a row, each given the earlier categories' probabilities.

The chain's models are logistic regressions over the words of a text and their beginnings, since an inflected
language has an insult in many forms. While fitting, a later model sees
out-of-fold probabilities of the earlier categories, so it learns from what it will get for new texts, and not
from an earlier model's memory. The fit uses a bounded sample of labelled rows; scoring covers every row.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.encoding import slices
from hirelens.llm.shared import bounded_broadcast, materialize, row_key, table

BITS, MAX_ROWS, MAX_FEATURES, MIN_ROWS = 24, 6000, 60_000, 5
#: Letters of the beginnings that count as features beside whole words; distinct words that a worker remembers.
STEMS, MAX_WORDS = (3, 4, 5, 6), 400_000
FOLDS, ROUNDS, LEAST, PENALTY = 4, 150, 1.25, 1.25
CHAIN = ("low_quality", "toxic")

_words = re.compile(r"[^\W\d_]+").findall


_seen: dict[str, tuple[int, ...]] = {}


def _hashes(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, which a mark keeps apart from words of the same letters."""
    parts = [word, *(word[:n] + "-" for n in STEMS if n < len(word))]
    return tuple(zlib.crc32(p.encode()) >> (32 - BITS) for p in parts)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's lower-cased words and their beginnings; null or no letters: none."""
    if len(_seen) > MAX_WORDS:
        _seen.clear()
    found: set[int] = set()
    for w in set(_words((text or "").lower())):
        if (h := _seen.get(w)) is None:
            h = _seen[w] = _hashes(w)
        found.update(h)
    return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass
class Rows:
    """A sparse 0/1 matrix."""

    at: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64))

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(w[self.at])))
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def back(self, r: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(r, np.diff(self.starts)), n)

    def columns(self, which: np.ndarray, n: int) -> Rows:
        """Only these columns, numbered anew."""
        new = np.full(n, -1)
        new[which] = np.arange(len(which))
        keep = new[self.at] >= 0
        return Rows(new[self.at[keep]], np.concatenate(([0], np.cumsum(keep)))[self.starts])

    def pick(self, which: np.ndarray) -> Rows:
        return Rows.of([self.at[self.starts[i] : self.starts[i + 1]] for i in which])


@dataclass
class Linear:
    words: np.ndarray
    more: np.ndarray  # weights of earlier categories' probabilities
    bias: float

    def predict(self, x: Rows, earlier: np.ndarray) -> np.ndarray:
        return _sigmoid(x.dot(self.words) + earlier @ self.more + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Rows, earlier: np.ndarray, y: np.ndarray, n_words: int) -> Linear:
    """Logistic regression by proximal AdaGrad over all rows at a time.

    Only words take part whose first gradient exceeds LEAST times the most noise any word's gradient can have, and
    what the largest of `n_words` tests without any effect would reach. The L1 penalty is PENALTY times that noise.
    """
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    model = Linear(np.zeros(n_words), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return model
    error = float(np.sqrt(rate * (1 - rate) / len(y)))
    share = x.back(np.ones(len(y)), n_words) / len(y)
    noise = error * np.sqrt(share * (1 - share) * 2 * np.log(max(2, n_words)))
    chosen = np.flatnonzero(np.abs(x.back((rate - y) / len(y), n_words)) > np.maximum(noise, LEAST * error))
    few = fit_linear_on(x.columns(chosen, n_words), earlier, y, len(chosen), model, PENALTY * error)
    model.more, model.bias = few.more, few.bias
    model.words[chosen] = few.words
    return model


def fit_linear_on(x: Rows, earlier: np.ndarray, y: np.ndarray, n_words: int, start: Linear, penalty: float) -> Linear:
    model = Linear(np.zeros(n_words), start.more, start.bias)
    sums = [np.full(n_words, 1e-6), np.full(earlier.shape[1], 1e-6), 1e-6]
    for _ in range(ROUNDS):
        r = (model.predict(x, earlier) - y) / len(y)
        grads = [x.back(r, n_words), earlier.T @ r, float(r.sum())]
        for i, g in enumerate(grads):
            sums[i] = sums[i] + g * g
        steps = [0.5 / np.sqrt(s) for s in sums]
        model.words, model.more = (
            np.sign(w := old - step * g) * np.maximum(0.0, np.abs(w) - step * l1)
            for old, step, g, l1 in ((model.words, steps[0], grads[0], penalty), (model.more, steps[1], grads[1], 0.0))
        )
        model.bias -= 0.2 * steps[2] * grads[2]
    return model


@dataclass
class Chain:
    names: tuple[str, ...]
    known: np.ndarray  # sorted word hashes that have a weight
    models: list[Linear]
    thresholds: list[float]

    def rows(self, hashes: list[np.ndarray]) -> Rows:
        out = []
        for h in hashes:
            at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
            out.append(at[self.known[at] == h] if len(self.known) else at[:0])
        return Rows.of(out)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        x = self.rows([features(t) for t in texts])
        earlier = np.zeros((len(texts), 0))
        for model in self.models:
            earlier = np.column_stack([earlier, model.predict(x, earlier)])
        return earlier


def fit(hashes: list[np.ndarray], labels: np.ndarray, names: tuple[str, ...], folds: np.ndarray) -> Chain:
    """Fits a chain to rows (their word hashes; a 0/1 column of `labels` for each name; a fold number)."""
    seen, n = np.unique(np.concatenate([*hashes, np.zeros(0, np.int32)]), return_counts=True)
    common = np.sort(np.argsort(-n, kind="stable")[:MAX_FEATURES])
    known = seen[common[n[common] >= min(MIN_ROWS, max(1, len(hashes) // 20))]]
    chain = Chain(names, known, [], [])
    x, earlier = chain.rows(hashes), np.zeros((len(hashes), 0))
    parts = [x.pick(np.flatnonzero(folds == k)) for k in range(FOLDS)]
    rest = [x.pick(np.flatnonzero(folds != k)) for k in range(FOLDS)]
    for j in range(len(names)):
        y, out = labels[:, j].astype(float), np.zeros(len(hashes))
        for k in range(FOLDS):
            out[folds == k] = fit_linear(rest[k], earlier[folds != k], y[folds != k], len(known)).predict(parts[k], earlier[folds == k])
        chain.models.append(fit_linear(x, earlier, y, len(known)))
        chain.thresholds.append(_threshold(out, y))
        earlier = np.column_stack([earlier, out])
    return chain


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of the out-of-fold probabilities, the middle of the F-score's peak, precision weighing twice as much as
    recall so that clean texts stay clean; 0.5 without positives."""
    if not y.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f = 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    i = int(f.argmax())
    low = p[order[i + 1]] if i + 1 < len(p) else 0.0
    return float((p[order[i]] + low) / 2)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Chain:
    """Fits (low_quality, toxic) on `labels` (doc_id, quality, toxic) and the texts of `docs` (doc_id, text).

    The sample is bounded: the `max_rows` labelled ids of lowest hash, and of documents that share an id the one of
    smallest `row_key`. Only their word hashes reach the driver. Null labels teach nothing; of repeated ids the worst
    label counts; labels without a document are passed over. Ties: rows that are as likely as the threshold says are
    toxic, all of them.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
    known = known.agg(F.max(1 - F.col("quality")).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic"))
    drawn = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "labelled")
    texts = docs.select(F.col("doc_id").alias("id"), "text", row_key().alias("key")).join(bounded_broadcast(drawn), F.col("id") == F.col("doc_id"))
    # one row of an id: keys first, since texts of a repeated id would be gathered
    least = materialize(texts.groupBy("doc_id").agg(F.min("key").alias("key")), "labelled-rows")
    texts = texts.join(bounded_broadcast(least), ["doc_id", "key"]).dropDuplicates(["doc_id"])
    kind = pa.schema([("doc_id", pa.int64()), ("low_quality", pa.int32()), ("toxic", pa.int32()), ("words", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                words = [features(t) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(c).cast(kind.field(c).type) for c in ("doc_id", "low_quality", "toxic")] + [pa.array(words, kind.field("words").type)], schema=kind)

    got = texts.select("doc_id", "low_quality", "toxic", "text").mapInArrow(run, "doc_id long, low_quality int, toxic int, words array<int>").toArrow()
    ids = np.array(got["doc_id"].to_pylist(), np.int64)
    order = np.argsort(ids, kind="stable")
    hashes = [np.asarray(got["words"][int(i)].values) for i in order]
    y = np.column_stack([np.array(got[c].to_pylist(), float)[order] for c in CHAIN]) if len(ids) else np.zeros((0, 2))
    folds = np.array([zlib.crc32(str(i).encode()) // 7 % FOLDS for i in ids[order]], int)
    return fit(hashes, y, CHAIN, folds)


def score(docs: DataFrame, model: Chain, key: str = "doc_id") -> DataFrame:
    """(key, p_low_quality, p_toxic, toxic) for each row of `docs` (key, text); toxic: p_toxic over the chain's
    threshold. A null or empty text has no words and gets the probabilities of that. Repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights for each category

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                p = shared.value.predict(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= shared.value.thresholds[1])], names=["doc_id", "p_low_quality", "p_toxic", "toxic"])

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, p_low_quality double, p_toxic double, toxic boolean")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
