"""Line dedup by distinct-site spread: HyperLogLog sketches per line hash, merged by aggregation.

A line found on many sites is boilerplate. Each line's sites are counted by a sketch that is built before the
shuffle and merged after it, so a line that a third of all documents have costs one small sketch per task.
Lines whose estimate is near the threshold are then counted exactly. Of a boilerplate line only the document
with the smallest id keeps it, so text that is copied across sites is never lost altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.shared import bounded_broadcast, materialize, row_key, table

MIN_SITES, MIN_CHARS, LOG2_K = 5, 20, 12


def _key(line: Column) -> Column:
    """128 bits of a line, as two hashes: equal only for equal lines, in effect."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """(k, doc_id, site, pos, key): the lines of each document that are long enough to be judged."""
    cut = docs.select(row_key().alias("k"), "doc_id", F.concat(F.lit("="), F.col(site).cast("string")).alias("site"), F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    line = F.trim("line")
    # a site of null is one site of its own; hll_sketch_agg passes over empty and null strings
    return cut.where(F.length(line) >= min_chars).select("k", "doc_id", F.coalesce("site", F.lit("-")).alias("site"), "pos", _key(line).alias("key"))


def boilerplate_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, keeper) of lines on `min_sites` sites or more; keeper: the smallest doc_id that has the line (null
    if it is only in documents without an id)."""
    lines = _lines(docs, site, min_chars)
    spread = lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG2_K))).alias("sites"), F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n")
    )
    margin = max(1.0, 3 * 1.04 / 2 ** (LOG2_K / 2) * min_sites)
    # n >= min_sites is exact: a line on that many sites has that many rows
    spread = materialize(spread.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites - margin)).select("key", "keeper", "sites"), "line-spread")
    sure = spread.where(F.col("sites") > min_sites + margin).select("key", "keeper")
    near = spread.where(F.col("sites") <= min_sites + margin).select("key", "keeper")
    exact = lines.join(bounded_broadcast(near.select("key")), "key", "left_semi").select("key", "site").distinct()
    exact = exact.groupBy("key").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(near.join(exact.select("key"), "key", "left_semi"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` (doc_id, text, the site column and any others) with boilerplate lines taken out of `text`, and
    n_lines, n_removed added (long).

    A line is what stands between newlines, compared without outer spaces; those under `min_chars` characters
    are kept. No document is dropped: one that had nothing else has an empty text. Null texts stay null, with no
    lines; an empty text has one. Documents without an id keep a line only if no document with an id has it.
    Repeated rows are treated alike.
    """
    lost = materialize(boilerplate_lines(docs, site, min_sites, min_chars), "boilerplate")
    lines = _lines(docs, site, min_chars).join(bounded_broadcast(lost), "key")
    hits = lines.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("k", "doc_id", "pos").distinct()
    # a row's own lines only, so an array is no longer than its text
    hits = bounded_broadcast(materialize(hits.groupBy("k", "doc_id").agg(F.collect_set("pos").alias("cut")), "line-hits"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), row_key().alias("row"))
    whole = whole.join(hits, (whole["row"] == hits["k"]) & whole["own.doc_id"].eqNullSafe(hits["doc_id"]), "left")
    text, cut = F.col("own.text"), F.col("cut")
    own = F.split(text, "\n", -1)
    left = F.array_join(F.filter(own, lambda x, i: ~F.array_contains(cut, i)), "\n")
    out = {c: F.col(f"own.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")}
    out["text"] = F.when(cut.isNull() | text.isNull(), text).otherwise(left)
    out["n_lines"] = F.when(text.isNull(), F.lit(0)).otherwise(F.size(own)).cast("long")
    out["n_removed"] = F.greatest(F.coalesce(F.size(cut), F.lit(0)), F.lit(0)).cast("long")
    return whole.select(*(c.alias(n) for n, c in out.items()))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def oracle() -> str:
    return f"""
    WITH l AS (SELECT doc_id, coalesce('=' || source, '-') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
    b AS (SELECT trim(line, ' ') AS key, min(doc_id) AS keeper FROM l WHERE length(trim(line, ' ')) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
    m AS (SELECT l.doc_id, l.line, l.pos, b.key IS NOT NULL AND l.doc_id <> b.keeper AS cut FROM l LEFT JOIN b ON trim(l.line, ' ') = b.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '') AS text
    FROM m GROUP BY doc_id"""
