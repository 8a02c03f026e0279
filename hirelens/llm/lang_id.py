"""Language ID by nearest centroids: TF-IDF vectors of character n-grams, several centroids a language, cosine.

The classifier is fitted on a bounded sample: about `max_rows` labelled rows, as many of each language, taken by a
hash of the id. A text whose cosine to its nearest centroid is under that centroid's floor is marked rejected:
it lies farther off than nearly all texts that made the centroid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.encoding import slices
from hirelens.llm.shared import table

BUCKETS, GRAMS = 1 << 13, (1, 2, 3, 4)
MAX_ROWS, CENTROIDS, ROUNDS = 3000, 3, 12
FLOOR_QUANTILE, FLOOR_FACTOR = 0.002, 0.5
DRAWS = 1 << 63

_letters: list = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def gram_counts(text: str) -> tuple[np.ndarray, bool]:
    """Counts of hashed n-grams of the lower-cased text, anything but letters as one space; has it a letter?"""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(BUCKETS, np.float32), False
    points = np.where(is_letter, points, np.uint32(32))
    space = points == 32
    points = np.concatenate(([np.uint32(32)], points[~(space & np.concatenate(([True], space[:-1])))], [np.uint32(32)]))
    mixed = points.astype(np.uint64)
    counts, code = np.zeros(BUCKETS, np.int64), np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(points) < n:
            break
        code = (code[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed[n - 1 :] + np.uint64(n))
        if n in GRAMS:
            at = (code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(51)
            counts += np.bincount(at.astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.float32), True


@dataclass
class Centroids:
    langs: list[str]
    idf: np.ndarray
    vectors: np.ndarray  # (centroids, BUCKETS), unit length
    lang_of: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine from 0 to 1, rejected); `und`, 0 and True without a letter or a language."""
        out, held = [("und", 0.0, True)] * len(texts), []
        for i, text in enumerate(texts):
            counts, known = gram_counts(text or "")
            if known and self.langs:
                held.append((i, _unit(counts, self.idf)))
        if held:
            near = np.stack([v for _, v in held]) @ self.vectors.T
            best = near.argmax(axis=1)
            for (i, _), row, b in zip(held, near, best, strict=True):
                score = float(min(1.0, max(0.0, row[b])))
                out[i] = (self.langs[self.lang_of[b]], score, bool(score < self.floors[b]))
        return out


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / (np.sqrt((v * v).sum()) or 1.0)


def fit(rows: list[tuple[str, np.ndarray]], n_centroids: int = CENTROIDS) -> Centroids:
    """Fits centroids to (language, counts) rows, in the order given, by spherical k-means for each language."""
    langs = sorted({lang for lang, _ in rows})
    seen = np.zeros(BUCKETS)
    for _, counts in rows:
        seen += counts > 0
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    vectors, lang_of, floors = [], [], []
    for number, lang in enumerate(langs):
        own = np.stack([_unit(counts, idf) for x, counts in rows if x == lang])
        centers = own[np.linspace(0, len(own) - 1, min(n_centroids, len(own))).astype(int)]
        for _ in range(ROUNDS):
            nearest = (own @ centers.T).argmax(axis=1)
            for k in range(len(centers)):
                if (nearest == k).any():
                    mean = own[nearest == k].sum(axis=0)
                    centers[k] = mean / (np.linalg.norm(mean) or 1.0)
        near = own @ centers.T
        for k in range(len(centers)):
            mine = near[near.argmax(axis=1) == k, k]
            if len(mine):
                vectors.append(centers[k])
                lang_of.append(number)
                floors.append(FLOOR_FACTOR * float(np.quantile(mine, FLOOR_QUANTILE)))
    return Centroids(langs, idf, np.array(vectors, np.float32).reshape(-1, BUCKETS), np.array(lang_of, int), np.array(floors))


def limit_by_language(sizes: dict[str, int], share: int) -> Column:
    """The 63-bit hash up to which a row of a language is drawn, so that `share` are in expectation, of however many."""
    limit = F.lit(-1).cast("long")
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(DRAWS, DRAWS * share // n) - 1).cast("long")).otherwise(limit)
    return limit


def train(labelled: DataFrame, key: str = "doc_id", max_rows: int = MAX_ROWS) -> Centroids:
    """Fits on `labelled` (key, text, lang); rows without a language, a text or a letter teach nothing.

    The sample is bounded: of each language max_rows / languages rows in expectation, those of lowest hash of the
    key, and all rows of a language that has fewer. Only their n-gram counts reach the driver.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("string").alias("key"), "text", "lang")
    sizes = {lang: n for lang, n in known.groupBy("lang").count().orderBy("lang").limit(max_rows).collect()}
    share = max(1, max_rows // max(1, len(sizes)))
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("key"), 1) <= limit_by_language(sizes, share))
    kind = pa.schema([("lang", pa.string()), ("key", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])

    def count(batches):
        for batch in batches:
            for some in slices(batch):
                rows = []
                for key, text, lang in zip(*(some.column(c).to_pylist() for c in ("key", "text", "lang")), strict=True):
                    counts, any_letter = gram_counts(text)
                    if any_letter:
                        at = np.flatnonzero(counts)
                        rows.append((lang, key, at.astype(np.int32), counts[at]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    got = drawn.mapInArrow(count, "lang string, key string, at array<int>, n array<float>").toArrow()
    order = sorted(range(got.num_rows), key=list(zip(got["lang"].to_pylist(), got["key"].to_pylist(), strict=True)).__getitem__)
    rows = []
    for i in order:
        counts = np.zeros(BUCKETS, np.float32)
        counts[np.asarray(got["at"][i].values)] = np.asarray(got["n"][i].values)
        rows.append((got["lang"][i].as_py(), counts))
    return fit(rows)


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and rejected for its text column, replacing columns of these names.

    lang_pred is the nearest centroid's language; `und` (score 0, rejected) if the text is null or has no
    letter, or if nothing was learned; of equally near centroids, that of the first language in text order. rejected marks texts that are too far from every centroid; who wants
    distance-based rejection to decide takes `und` for them.
    """
    kept = docs.select(*(c for c in docs.columns if c not in ("lang_pred", "score", "rejected")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x CENTROIDS x BUCKETS floats

    def run(batches):
        for batch in batches:
            for some in slices(batch, text):
                made = [x for i in range(0, some.num_rows, 256) for x in shared.value.predict(some.column(text).slice(i, 256).to_pylist())]
                a, b, c = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(a), pa.array(b), pa.array(c)], names=[*some.schema.names, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(marked, model).drop("text")
