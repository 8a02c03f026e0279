"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

A key is a document's text: its hash is its place on the ring, so equal texts lie together. Every shard has `virtual`
nodes there, at hashes of its name; a row's home is the shard of the next node clockwise. A shard takes as many rows as
its bound says. It fills up with its own keys first, in the order of the ring; those that overflow it continue
clockwise, node by node, to the next shard that isn't full. Only overflow moves, so no key pushes another one out.

Rows and nodes are sorted together by one range exchange, a last tie-break making every sort key different, so that
copies of one text spread over tasks. Then a row's number on the ring follows from its task's offset, and what lies
between two nodes is a stretch of numbers. Which stretch goes where is worked out of the nodes' numbers alone: as many
as the ring has nodes, whatever the rows. Each row finds its stretch by its number, in a table of that size.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.shared import materialize, table

SHARDS, VIRTUAL = 40, 128
LAW = "rows"
#: Bytes of a row besides its text.
ROW_BYTES = 16
#: Stretches are looked up by number in this many equal slices of the ring.
SLICES = 4096
STRETCH = (("slice", "long"), ("first", "long"), ("end", "long"), ("shard", "int"), ("first_slot", "long"), ("home", "int"))


def node_places(shards: int, virtual: int) -> F.Column:
    """(place, shard) of every virtual node: hashes of shard and number, the same for a shard whatever the others are."""
    every = F.sequence(F.lit(0), F.lit(shards * virtual - 1))
    return F.explode(F.transform(every, lambda i: F.struct(F.xxhash64(F.lit("node"), (i / virtual).cast("int"), i % virtual).alias("place"), (i / virtual).cast("int").alias("shard"))))


def quotas(n_rows: int, shards: int) -> list[int]:
    """Rows that each shard takes: all full, and at most one apart."""
    return [n_rows // shards + (s < n_rows % shards) for s in range(shards)]


def stretches(nodes: list[tuple[int, int]], n_all: int, bounds: list[int]) -> list[tuple[int, int, int, int]]:
    """(first number, number behind the last, shard, slot of the first) of what goes where. nodes: (number, shard) of
    each node, ascending; rows have the other numbers below n_all. The bounds' sum must hold all rows."""
    if n_all == len(nodes):
        return []
    homes, before = [], -1  # (first, behind the last, node) of each arc that has rows
    for k, (number, _) in enumerate(nodes):
        homes.append((before + 1, number, k))
        before = number
    homes.append((before + 1, n_all, 0))  # behind the last node the ring goes on at the first
    free, taken = list(bounds), [0] * len(bounds)
    out, over = [], []

    def give(first: int, end: int, shard: int) -> int:
        n = min(end - first, free[shard])
        if n:
            out.append((first, first + n, shard, taken[shard]))
            free[shard] -= n
            taken[shard] += n
        return first + n

    for first, end, node in homes:
        if first < end and (first := give(first, end, nodes[node][1])) < end:
            over.append((first, end, node))
    open_nodes = [k for k, (_, s) in enumerate(nodes) if free[s]]
    for first, end, node in over:
        while first < end:
            k = open_nodes[bisect_left(open_nodes, node + 1) % len(open_nodes)]
            shard = nodes[k][1]
            first = give(first, end, shard)
            if not free[shard]:
                open_nodes = [x for x in open_nodes if nodes[x][1] != shard]
    return out


def shard_rows(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, size (bytes of the text in UTF-8 and 16), text_crc32, home
    (the shard where the ring puts it), shard, slot (gapless from 0 in each shard).

    Shards hold as many rows each, or one apart. Null texts count as empty. Rows of one text lie together on the ring,
    by doc_id (null first); a group that is larger than a shard goes on clockwise. Repeated rows and null ids are rows of
    their own. Columns other than doc_id and text are ignored. No rows: none.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("place"), F.lit(None).cast("int").alias("node"),
    )
    # numbered before they are sorted, so that no two rows are alike and a task that is run again cuts the same
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "shard-rows")
    nodes = spark.range(1).select(node_places(shards, virtual).alias("x")).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"), "x.place", F.col("x.shard").alias("node"), F.lit(-1).cast("long").alias("tie"))
    # a node stands behind the rows at its own place, which are its own
    order = [F.col("place"), F.col("node").asc_nulls_first(), F.col("text_crc32"), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = rows.unionByName(nodes).repartitionByRange(*order).sortWithinPartitions(*order)
    ring = materialize(dealt.select("doc_id", "size", "text_crc32", "node", F.monotonically_increasing_id().alias("at")), "ring")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = sorted(tuple(r) for r in ring.groupBy(part.alias("part")).count().collect())  # a row per task
    offsets, n_all = [], 0
    for p, n in counts:
        offsets += [n_all] * (p + 1 - len(offsets))
        n_all += n
    base = F.get(F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<long>"), part.cast("int"))  # one folded array
    numbered = ring.select("doc_id", "size", "text_crc32", "node", (base + within).alias("number"))
    held = sorted((r.number, r.node) for r in numbered.where("node IS NOT NULL").select("number", "node").collect())  # shards * virtual
    given = stretches(held, n_all, quotas(n_all - len(held), shards))
    homes = [(first, end, held[k % len(held)][1]) for k, (first, end) in enumerate(zip([0, *(x + 1 for x, _ in held)], [*(x for x, _ in held), n_all], strict=True))]
    width = max(1, -(-n_all // SLICES))
    cut = _split(given, homes)
    listed = json.dumps([(k, *x) for x in cut for k in range(x[0] // width, (x[1] - 1) // width + 1)])
    sliced = spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<array<long>>")).alias("x"))
    looked = sliced.select(*(F.get("x", F.lit(i)).cast(kind).alias(c) for i, (c, kind) in enumerate(STRETCH)))
    on = (F.col("slice") == F.floor(F.col("number") / width)) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end"))
    found = numbered.where("node IS NULL").join(F.broadcast(looked), on)  # at most 4 rows a node and one a slice
    return found.select("doc_id", "size", "text_crc32", "home", "shard", (F.col("first_slot") + F.col("number") - F.col("first")).alias("slot"))


def _split(given: list[tuple[int, int, int, int]], homes: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Stretches with their home: each lies within one arc."""
    ends = [end for _, end, _ in homes]
    return [(*x, homes[bisect_left(ends, x[1])][2]) for x in given]


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard_rows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")
