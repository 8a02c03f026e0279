"""Snapshots of many sources against the stored state, in one job for all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("source_id", "external_job_id")


def last_wins(rows: DataFrame, key: tuple[str, ...] = KEY, seq: str = "seq") -> DataFrame:
    """One row per key: the values of the last `seq`, with `first_seq`, the place of the first. A null `seq` comes before
    all others; rows of equal `seq` are told apart by a hash of their values."""
    rest = [c for c in rows.columns if c not in key]
    order = F.struct(F.col(seq).isNotNull().alias("known"), F.col(seq).alias("seq"), F.xxhash64(*rest).alias("tie"))
    last = F.max_by(F.struct(*rest), order).alias("last")  # merged before the shuffle, without a window
    return rows.groupBy(*key).agg(last, F.min(seq).alias("first_seq")).select(*key, *(f"last.{c}" for c in rest), "first_seq")


def reconcile(existing: DataFrame, snapshot: DataFrame, ts: Column, payload: list[str], failed: DataFrame | None = None, min_rows: int = 0) -> DataFrame:
    """The new state of `existing` (source_id, external_job_id, id, status, last_seen_at, created_at, updated_at,
    payload columns) after the full snapshot of each source, one row per key, taken at `ts`.

    New rows are inserted as open; those seen again are overwritten, reopened and keep id and created_at; open
    rows not seen since `ts` are closed. Only sources in `snapshot`, with `min_rows` rows at least and not in
    `failed` (source_id), change. `action` is insert, update, close or keep.
    """
    sources = snapshot.groupBy("source_id").count().where(F.col("count") >= min_rows).select("source_id", F.lit(True).alias("__fetched"))
    if failed is not None:
        sources = sources.join(failed.select("source_id").distinct(), "source_id", "left_anti")
    new = snapshot.join(sources, "source_id", "left_semi").select(*KEY, F.struct(*payload).alias("__new"))
    old = existing.select(*KEY, F.struct(*(c for c in existing.columns if c not in KEY)).alias("__old"))
    both = old.join(new, list(KEY), "full").join(sources, "source_id", "left")
    seen, known = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    closes = ~seen & F.coalesce("__fetched", F.lit(False)) & (F.col("__old.status") == "open") & (F.col("__old.last_seen_at") < ts)
    action = F.when(seen & ~known, "insert").when(seen, "update").when(closes, "close").otherwise("keep")
    made = F.concat_ws("|", *KEY)
    return both.withColumn("action", action).select(
        *KEY,
        F.coalesce(F.col("__old.id"), F.sha2(made, 256)).alias("id"),
        F.when(seen, "open").when(closes, "closed").otherwise(F.col("__old.status")).alias("status"),
        F.when(seen, ts).otherwise(F.col("__old.last_seen_at")).alias("last_seen_at"),
        F.when(known, F.col("__old.created_at")).otherwise(ts).alias("created_at"),
        F.when(seen | closes, ts).otherwise(F.col("__old.updated_at")).alias("updated_at"),
        *(F.when(seen, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in payload),
        "action",
    )


def snapshot_stats(fetched: DataFrame, reconciled: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per source, and in all (source_id null): fetched rows, mapped (with an external id), unique keys, deduped, inserted,
    updated, closed, and failed: of a source in `errors` (source_id) as many rows as were met, one at least."""
    a = fetched.groupBy("source_id").agg(F.count(F.lit(1)).alias("fetched"), F.count("external_job_id").alias("mapped"), F.count_distinct("external_job_id").alias("unique_rows"))
    b = reconciled.groupBy("source_id").agg(*(F.count_if(F.col("action") == x).alias(y) for x, y in (("insert", "inserted"), ("update", "updated"), ("close", "closed"))))
    met = a.withColumn("deduped", F.col("mapped") - F.col("unique_rows")).join(b, "source_id", "left")
    if errors is not None:
        met = met.join(errors.select("source_id").distinct().withColumn("__error", F.lit(True)), "source_id", "full")
    else:
        met = met.withColumn("__error", F.lit(None).cast("boolean"))
    failed = F.when(F.col("__error"), F.greatest(F.coalesce("unique_rows", F.lit(0)), F.coalesce("mapped", F.lit(0)), F.coalesce("fetched", F.lit(0)), F.lit(1))).otherwise(0)
    names = ["fetched", "mapped", "unique_rows", "deduped", "inserted", "updated", "closed"]
    return met.withColumn("failed", failed.cast("long")).rollup("source_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*names, "failed"]))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest `order`."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def stitched_pages(pages: DataFrame, source: str, order: list[str], total: str) -> DataFrame:
    """Rows of each source in page order, cut at the number that the source advertises."""
    w = Window.partitionBy(source).orderBy(*order)
    return pages.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col(total))


def merge_details(summary: DataFrame, detail: DataFrame, key: str, policy: str = "drop") -> DataFrame:
    """Summary rows with their details; a row without is dropped, or kept and flagged (`flag`)."""
    if policy == "drop":
        return summary.join(detail, key)
    return summary.join(detail.withColumn("__hit", F.lit(True)), key, "left").withColumn("detail_failed", F.col("__hit").isNull()).drop("__hit")


def purge_empty(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(F.nullif(text, F.lit("")).isNotNull())
