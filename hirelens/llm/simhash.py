"""SimHash near-duplicates, linked by BK-trees.

Fingerprints within RADIUS differing bits agree in whole on at least one of RADIUS + 1 equal blocks of their bits.
So each distinct fingerprint goes to one shard per block, by the block's value; a shard's BK-tree (children keyed
by their integer Hamming distance to the parent) is searched with each of its fingerprints, following only edges
within the radius. Shards are placed by that agreement and not sent to every executor, since all fingerprints
have no size bound, and a tree must meet only the fingerprints that can be near. A shard of over SHARD fingerprints
is split by the same rule: its fingerprints agree in one block, so near ones agree in whole on one of RADIUS + 1 equal
blocks of the other bits. At 10 thousand million random fingerprints, that makes at most 16 copies of each and shards of
some dozens. Only what is still over SHARD, a crowd of fingerprints that differ in few bits, is dealt out as pairs of
parts: each part's tree is searched with every part, so no pair is missed and no task grows. A task reports links that
connect what it found near, not all near pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.encoding import slices
from hirelens.llm.graph import components
from hirelens.llm.hamming import BKTree, Groups, majority_bits
from hirelens.llm.near_copies import drop_near_copies
from hirelens.llm.shared import bounded_broadcast, materialize, table

WORDS, RADIUS, SHARD = 3, 3, 512


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """64 majority bits of the shingles' XXH64 (seed 42), as a signed long; no word: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return int(np.uint64(digest(joined, 42)).astype(np.int64))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    found = np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)
    return int(np.frombuffer(majority_bits(found), ">i8")[0])


def links_within(held: list[int], asked: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect all pairs of one of `held` and one of `asked` within the radius: a spanning forest.
    If both are the same list, each fingerprint is searched among those before it."""
    tree, groups, links, same = BKTree(), Groups(), [], held is asked
    for x in () if same else held:
        tree.add(x)
    for x in asked:
        links += [(x, y) for y in tree.near(x, radius) if groups.join(x, y)]
        if same:
            tree.add(x)
    return links


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of each row of `docs`, over its whole text."""
    kind = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                fps = [fingerprint(t) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(fps, pa.int64())], schema=kind)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(x: Column, low: int, high: int) -> Column:
    """Bits `low` to `high` (excluded) of a long."""
    return F.call_function("shiftrightunsigned", F.shiftleft(x, 64 - high), F.lit(64 - high + low))


def near_links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b) links between distinct fingerprints `fps` (fp) that connect all pairs within the radius."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    first = [F.struct(F.lit(i).alias("block"), _bits(F.col("fp"), cuts[i], cuts[i + 1]).alias("value")) for i in range(radius + 1)]
    placed = fps.select("fp", F.explode(F.array(*first)).alias("at")).select("fp", "at.block", "at.value")
    large = materialize(placed.groupBy("block", "value").count().where(F.col("count") > shard).select("block", "value", F.lit(True).alias("split")), "large-shards")
    placed = placed.join(bounded_broadcast(large), ["block", "value"], "left")
    split = F.lit(None).cast("array<struct<sub:int,inner:bigint>>")
    for i in range(radius + 1):
        rest = 64 - (cuts[i + 1] - cuts[i])  # the other bits, turned so that they are the lowest
        turned = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(cuts[i + 1])).bitwiseOR(F.shiftleft("fp", 64 - cuts[i + 1])) if cuts[i + 1] < 64 else F.col("fp")
        at = [rest * j // (radius + 1) for j in range(radius + 2)]
        inner = F.array(*(F.struct(F.lit(j).alias("sub"), _bits(turned, at[j], at[j + 1]).alias("inner")) for j in range(radius + 1)))
        split = F.when(F.col("block") == i, inner).otherwise(split)
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("inner")))
    placed = placed.select("fp", "block", "value", F.explode(F.when(F.col("split"), split).otherwise(whole)).alias("at")).select("fp", "block", "value", "at.sub", "at.inner")
    keys = ["block", "value", "sub", "inner"]
    hot = placed.where("sub >= 0").groupBy(*keys).count().where(F.col("count") > shard)
    hot = materialize(hot.select(*keys, F.ceil(F.col("count") / F.lit(shard)).cast("int").alias("parts")), "hot-shards")
    placed = placed.join(bounded_broadcast(hot), keys, "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = placed.select("fp", *keys, own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other"))
    dealt = dealt.select(*keys, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp")
    keys += ["p", "q"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "own", "fp")
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(p: int, q: int, own: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        held = fp[own == p].astype(np.uint64).tolist()
        return links_within(held, held if p == q else fp[own == q].astype(np.uint64).tolist(), radius)

    def run(batches):
        rest = None
        for table_ in _then_none(batches):
            if table_ is not None:
                cols = [table_.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "own", "fp")]
                rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            *at, own, fp = rest
            p, q = at[-2:]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
            bounds = np.concatenate(([0], new, [len(fp)]))
            last = len(bounds) - 1 if table_ is None else len(bounds) - 2  # the last group may go on in the next batch
            found: list[tuple[int, int]] = []
            for i in np.flatnonzero(np.diff(bounds)[:last] > 1):
                a, b = bounds[i], bounds[i + 1]
                found += search(p[a], q[a], own[a:b], fp[a:b])
            rest = [x[bounds[last] :] for x in rest] if last < len(bounds) - 1 else None
            if found:
                pairs = np.array(found, dtype=np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=kind)

    return dealt.mapInArrow(run, "a long, b long")


def _then_none(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs` (doc_id, text).

    fingerprint: 16 hexadecimal digits. component_id: the smallest doc_id that can be reached over links between
    fingerprints of at most `radius` differing bits, itself included; equal fingerprints are linked. Null and
    empty texts have fingerprint zero and are linked like any other. Rows that repeat an id are linked each by
    its own text. A null id is never the smallest, unless a component has no other (then null). Other columns
    are ignored.
    """
    marked = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    linked = materialize(near_links(distinct.select("fp"), radius, shard), "near-links")
    roots = components(linked).withColumnsRenamed({"node": "fp"})
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = materialize(rooted.join(lows, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: fingerprints of five-word shingles that BK-trees find near each other, confirmed by the
    shingles themselves. The radius of three bits is op6's alone; it is far tighter."""
    return drop_near_copies(docs)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
