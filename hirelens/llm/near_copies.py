"""Near copies for the corpus pipeline: SimHash fingerprints that BK-trees find near each other, confirmed by a Jaccard
of 0.8 or more between the documents' sets of five-word shingles.

A fingerprint has 128 majority bits of a set's hashes. At a Jaccard of 0.8 two differ in 19 bits on average, and in over
RADIUS in less than 1 of 1000 million cases, or 1 of 5 million for the smallest sets that can be near without being
equal (four shingles of five). Of unrelated sets 3 of 1000 are within it; so what a tree finds is then counted exactly.

So wide a radius leaves no blocks of bits that near fingerprints must share and that make small shards, as op6's three
bits do. Trees are placed by MinHash bands instead: ROWS of a set's minima over as many hash functions form a band, and
sets that agree on any of BANDS bands share a bucket. A pair at 0.8 has no common band in 3 of a million cases, one at
0.85 in less than 1 of 100 million. Bands link each set to the smallest of its bucket only, and each small group that
these links connect is a shard with a BK-tree of its own, which each of its fingerprints is searched in, so no two near
copies are lost because of the bucket's smallest.

Of a crowd (over PART sets or PART_SHINGLES shingles) first each set is held against the smallest of its buckets, if
their fingerprints are within the radius; that costs as many copies as there are sets, and joins nearly all of a crowd
of near copies. Then only buckets are searched whose sets aren't all joined by that, each as pairs of parts: one part's
tree is searched with the other part, so no task grows; buckets of the same sets are one. A task reports links that
connect what it found near, not all near pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.encoding import slices
from hirelens.llm.graph import components
from hirelens.llm.hamming import BKTree, Groups, majority_bits
from hirelens.llm.shared import bounded_broadcast, materialize, row_key

SHINGLE, LEAST, RADIUS = 5, 0.8, 48
BANDS, ROWS, PART, PART_SHINGLES = 32, 5, 256, 4_000_000

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a text's n-word shingles, ascending. Words are those of op6; a text of fewer words is
    one shingle, no word: none."""
    words = (text or "").encode().lower().split()
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    last = len(own) - n + 1
    code = own[:last]
    for k in range(1, n):
        code = code * _STEP + own[k : last + k]
    return np.unique(_mix(code))


def digest(found: np.ndarray) -> int:
    """Of a shingle set, as a signed long; the empty set: zero."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64)) if len(found) else 0


def bands(found: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band of a shingle set, which has a shingle at least."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        some = found[i : i + 1024]
        np.minimum(least, (_FACTORS[:, None] * some + _OFFSETS[:, None]).min(axis=1), out=least)
    rows = _mix(least).reshape(BANDS, ROWS)
    code = rows[:, 0].copy()
    for k in range(1, ROWS):
        code = code * _STEP + rows[:, k]
    return _mix(code)


def fingerprint(found: np.ndarray) -> bytes:
    """128 majority bits of a shingle set; the empty set: zeros."""
    return majority_bits(found) + majority_bits(_mix(found ^ _STEP))


def is_near(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard of LEAST or more."""
    if min(len(one), len(other)) < (LEAST - 1e-9) * max(len(one), len(other)):
        return False
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common >= (LEAST - 1e-9) * (len(one) + len(other) - common)


def found_near(held: list[bytes], asked: list[bytes], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """(place in `held`, place in `asked`) of all fingerprints within the radius, by a BK-tree of `held`. If both are the
    same list, each is searched among those before it."""
    tree, places, same = BKTree(), {}, held is asked

    def put(i: int, value: int) -> None:
        places.setdefault(value, []).append(i)
        tree.add(value)

    for i, x in enumerate(() if same else held):
        put(i, int.from_bytes(x))
    for j, x in enumerate(asked):
        value = int.from_bytes(x)
        for y in tree.near(value, radius):
            yield from ((i, j) for i in places[y])
        if same:
            put(j, value)


def links_at(held: list[np.ndarray], asked: list[np.ndarray], held_prints: list[bytes], asked_prints: list[bytes], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (place in `held`, place in `asked`) that connect all near pairs whose fingerprints are within the radius: a
    spanning forest. If both are the same lists, each pair is tried once."""
    groups, links, first = Groups(), [], 0 if held is asked else len(held)
    for i, j in found_near(held_prints, asked_prints, radius):
        if groups.find(i) != groups.find(first + j) and is_near(held[i], asked[j]):
            groups.join(i, first + j)
            links.append((i, j))
    return links


def _sketched(docs: DataFrame) -> DataFrame:
    """(row, doc_id, code, print: fingerprint, bands, n: shingles) of each row of `docs` (doc_id, text), over its whole text."""
    kind = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("code", pa.int64()), ("print", pa.binary()), ("bands", pa.list_(pa.int64())), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                sets = [shingle_set(t) for t in some.column("text").to_pylist()]
                values = [bands(x).astype(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("doc_id"), pa.array([digest(x) for x in sets], pa.int64()), pa.array([fingerprint(x) for x in sets], pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64())], schema=kind)

    return docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, code long, print binary, bands array<long>, n long")


def _sets(texts: DataFrame) -> DataFrame:
    """`texts` (code, print, part columns, text) with the text's shingle set in its place."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                sets = pa.array([shingle_set(t).astype(np.int64) for t in some.column("text").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), sets], names=[*names, "held"])

    return texts.select(*names, "text").mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'print' else 'long'}" for c in names) + ", held array<long>")


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search(rows: pa.Table, radius: int) -> pa.Table:
    """Links among the sets of one part, found in its BK-tree, or between those of two, found in the first one's."""
    p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
    own, code = rows.column("own").to_numpy(), rows.column("code").to_numpy()
    sets = [np.asarray(x.values, dtype=np.int64) for x in rows.column("held")]
    prints = rows.column("print").to_pylist()
    a = np.flatnonzero(own == p)
    b = a if p == q else np.flatnonzero(own == q)
    if not len(a) or not len(b):
        return LINK.empty_table()
    one, own_prints = [sets[i] for i in a], [prints[i] for i in a]
    links = links_at(one, one, own_prints, own_prints, radius) if p == q else links_at(one, [sets[i] for i in b], own_prints, [prints[i] for i in b], radius)
    return pa.table([pa.array([code[a[i]] for i, _ in links], pa.int64()), pa.array([code[b[j]] for _, j in links], pa.int64())], schema=LINK)


def _distance(one: str, other: str) -> Column:
    """Differing bits of two fingerprints."""
    half = lambda c, at: F.conv(F.hex(F.substring(c, at, 8)), 16, -10).cast("long")
    return sum(F.bit_count(half(one, at).bitwiseXOR(half(other, at))) for at in (1, 9))


def _near_pairs(pairs: DataFrame, held: DataFrame, radius: int) -> DataFrame:
    """Those of `pairs` (a, b) whose fingerprints and sets in `held` (code, print, held) are near."""

    def run(batches):
        for batch in batches:
            both = zip(batch.column("x"), batch.column("y"), strict=True)
            near = pa.array([is_near(x.values.to_numpy(), y.values.to_numpy()) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], schema=LINK)

    for c, own in (("a", "x"), ("b", "y")):
        pairs = pairs.join(bounded_broadcast(held.select(F.col("code").alias(c), F.col("print").alias(f"{own}_print"))), c)
    pairs = materialize(pairs.where(_distance("x_print", "y_print") <= radius).select("a", "b"), "near-prints")
    both = pairs.join(held.select(F.col("code").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("code").alias("b"), F.col("held").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, marked: DataFrame, part: int = PART, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between codes that connect all pairs of near copies among the candidates of `marked`."""
    search = lambda rows: _search(rows, radius)
    distinct = marked.where("code <> 0").select("code", "bands").dropDuplicates(["code"])
    placed = materialize(distinct.select("code", F.posexplode("bands").alias("band", "value")), "bands")
    lows = materialize(placed.groupBy("band", "value").agg(F.min("code").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "buckets")
    shared = materialize(placed.join(bounded_broadcast(lows), ["band", "value"]), "shared-bands")
    star = materialize(shared.where("code <> low").select(F.col("code").alias("a"), F.col("low").alias("b")).distinct(), "band-links")
    groups = materialize(components(star).select(F.col("node").alias("code"), F.col("root").alias("group")), "band-groups")
    chosen = materialize(marked.join(groups, "code").groupBy("code", "group").agg(F.min("row").alias("row"), F.any_value("print").alias("print"), F.any_value("n").alias("n")), "chosen")
    crowds = chosen.groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size")).where((F.col("sets") > part) | ((F.col("size") > PART_SHINGLES) & (F.col("sets") > 2)))
    crowds = materialize(crowds.select("group", F.lit(True).alias("crowd")), "crowds")
    dealt = chosen.join(bounded_broadcast(crowds), "group", "left").select("row", "code", "print", "group", F.coalesce("crowd", F.lit(False)).cast("long").alias("crowd"), "n")
    texts = docs.select(row_key().alias("row"), "text").join(bounded_broadcast(dealt), "row").drop("row").dropDuplicates(["code"])
    held = materialize(_sets(texts), "sets")
    zero = F.lit(0).cast("long")
    small = held.where("crowd = 0").select("group", zero.alias("p"), zero.alias("q"), zero.alias("own"), "code", "print", "held").groupBy("group").applyInArrow(search, "a long, b long")
    if crowds.isEmpty():
        return small
    inside = held.where("crowd = 1").select("code", "print", "n", "held")
    joined = materialize(_near_pairs(star.join(inside.select(F.col("code").alias("a")), "a", "left_semi"), inside, radius), "crowd-links")
    roots = materialize(components(joined).withColumnsRenamed({"node": "code"}), "crowd-roots")
    # of the buckets only those that sets share, and of these a crowd's: most of all sets share none
    members = shared.select("band", "value", "code").join(bounded_broadcast(inside.select("code", "n")), "code").join(bounded_broadcast(roots), "code", "left")
    members = materialize(members.withColumn("root", F.coalesce("root", "code")), "crowd-members")
    buckets = members.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("code")).alias("same"))
    parts = F.greatest(F.ceil(F.col("sets") / F.lit(part)), F.ceil(F.col("size") / F.lit(PART_SHINGLES)))
    apart = materialize(buckets.where("low < high").dropDuplicates(["sets", "same"]).select("band", "value", parts.alias("parts")), "open-buckets")
    spread = materialize(members.join(bounded_broadcast(apart), ["band", "value"]).select("band", "value", "code", "parts"), "open-members").join(inside.select("code", "print", "held"), "code")
    spread = spread.withColumn("own", F.pmod(F.xxhash64("code"), "parts")).withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
    spread = spread.select("band", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "code", "print", "held")
    return small.unionByName(joined).unionByName(spread.groupBy("band", "value", "p", "q").applyInArrow(search, "a long, b long"))


def drop_near_copies(docs: DataFrame, part: int = PART, radius: int = RADIUS) -> DataFrame:
    """`docs` (doc_id, text, ...) with one row of each group of near copies: the one with the smallest doc_id, a null id
    last; rows that share an id are told apart by their text, and of those with equal id and text one stays.

    A group: what links between five-word shingle sets connect, of fingerprints within `radius` bits and a Jaccard of LEAST
    or more; equal sets are linked, those of texts without a word too.
    """
    marked = materialize(_sketched(docs), "sketched")
    roots = components(near_links(docs, marked, part, radius)).withColumnsRenamed({"node": "code"})
    rows = marked.groupBy("row", "doc_id", "code").agg(F.count(F.lit(1)).alias("n")).join(roots, "code", "left")
    rows = materialize(rows.withColumn("root", F.coalesce("root", "code")).withColumn("order", F.struct(F.col("doc_id").isNull(), "doc_id", "row")), "rows")
    first = rows.groupBy("root").agg(F.min("order").alias("first"))
    stays = rows.join(first, "root").withColumn("stays", F.col("order") == F.col("first"))
    odd = stays.where(~F.col("stays") | (F.col("n") > 1)).select("row", F.col("doc_id").alias("id"), "stays")
    odd = bounded_broadcast(materialize(odd, "odd-rows"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), row_key().alias("row"))
    marked = own.join(odd, (own["row"] == odd["row"]) & own["own.doc_id"].cast("long").eqNullSafe(odd["id"]), "left").select("own", own["row"].alias("row"), "stays")
    once = marked.where("stays").groupBy("row", F.col("own.doc_id")).agg(F.any_value("own").alias("own"))
    return marked.where("stays IS NULL").select("own.*").unionByName(once.select("own.*"))
