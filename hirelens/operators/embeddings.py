"""Which embeddings are fresh, stale or missing; validation; refresh in batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.operators.calls import call_once
from hirelens.operators.ledger import TARGET
from hirelens.operators.texts import job_texts
from hirelens.sources.store import fresh_folder, staged


def with_freshness(jobs: DataFrame, held: DataFrame) -> DataFrame:
    """`jobs` (job_id, content_fingerprint) with `state`: missing, stale or fresh against `held` (job_id,
    content_fingerprint) of one target. Equal nulls are fresh."""
    h = held.select("job_id", F.col("content_fingerprint").alias("__held"), F.lit(True).alias("__hit"))
    state = F.when(F.col("__hit").isNull(), "missing").when(F.col("content_fingerprint").eqNullSafe(F.col("__held")), "fresh").otherwise("stale")
    return jobs.join(h, "job_id", "left").withColumn("state", state).drop("__held", "__hit")


def to_embed(jobs: DataFrame, held: DataFrame, source_id: str | None = None, structured_version: int | None = None, force: bool = False) -> DataFrame:
    """Those of `jobs` (job_id, description, content_fingerprint; source_id and status; structured_jd and
    structured_jd_version) that need an embedding of the target of `held`: they have a description and are missing or
    stale, or with `force` in any state.

    source_id: only open jobs of this source. structured_version: only jobs parsed at this version or a later one.
    """
    rows = jobs.where("description IS NOT NULL")
    if source_id is not None:
        rows = rows.where((F.col("source_id") == source_id) & (F.col("status") == "open"))
    if structured_version is not None:
        rows = rows.where(F.col("structured_jd").isNotNull() & (F.coalesce("structured_jd_version", F.lit(0)) >= structured_version))
    return rows if force else with_freshness(rows, held).where("state <> 'fresh'").drop("state")


def freshness_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count_if(F.col("state") == "fresh").alias("fresh"), F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("content_fingerprint").isNull()).alias("without_fingerprint"))


def valid_vectors(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """`rows` with `valid`: as many finite numbers as the target has dimensions."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.withColumn("valid", F.coalesce((F.size(vector) == dim) & finite, F.lit(False)))


def refresh(stale: DataFrame, embed: Callable[[list[str]], list[list[float]]], parallel: int, batch: int = 32, root: str | None = None, model: str = "") -> DataFrame:
    """(job_id, content_fingerprint, embedding) of `stale` (job_id, text, content_fingerprint). `parallel` bounds the
    calls made at once, `batch` the texts of one call. Each distinct text is embedded once, here and not when the result
    is read; with a ledger `root`, also over later runs of the same `model`. Rows whose call failed aren't there."""
    spark = stale.sparkSession
    asked = staged(stale.select("job_id", "text", "content_fingerprint", F.sha2(F.concat(F.lit(f"{model}\n"), "text"), 256).alias("call_key")), "embed")
    answers, _ = call_once(asked.select("call_key", "text"), lambda rows: embed([r["text"] for r in rows]), root or fresh_folder(spark, "embed-calls"), "array<float>", batch, parallel)
    return asked.join(answers, "call_key").where("answer IS NOT NULL").select("job_id", "content_fingerprint", F.col("answer").alias("embedding"))


def refresh_embeddings(jobs: DataFrame, held: DataFrame, embed: Callable[[list[str]], list[list[float]]], target: dict, at: Column, root: str, parallel: int = 8, batch: int = 32, **selection) -> tuple[DataFrame, DataFrame]:
    """(embeddings after the refresh, one row of counts: selected, refreshed, failed) of `jobs` (as for `to_embed` and
    `texts.job_texts`) against `held` (job_id, the target's columns, embedding, content_fingerprint, created_at,
    updated_at), for one target: which are due, their texts, the calls, and the upsert.

    Vectors that don't fit the target's dimensions count as failed, as do rows whose call failed; what is held of them
    stays. Other targets' rows stay.
    """
    of = reduce(Column.__and__, (F.col(c) == F.lit(target[c]) for c in TARGET))
    due = to_embed(jobs, held.where(of), **selection)
    texts = staged(due.join(job_texts(due), "job_id").select("job_id", "content_fingerprint", "text"), "due")
    model = "|".join(str(target[c]) for c in TARGET)
    made = valid_vectors(refresh(texts, embed, parallel, batch, root, model), "embedding", target["embedding_dim"]).where("valid")
    new = made.select("job_id", *(F.lit(target[c]).cast(held.schema[c].dataType).alias(c) for c in TARGET), F.col("embedding").cast(held.schema["embedding"].dataType), "content_fingerprint", at.alias("created_at"), at.alias("updated_at"))
    counts = texts.agg(F.count(F.lit(1)).alias("selected")).crossJoin(new.agg(F.count(F.lit(1)).alias("refreshed")))  # of one row each
    return upsert(held, new, ["job_id", *TARGET]), counts.withColumn("failed", F.col("selected") - F.col("refreshed"))


def upsert(held: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace held ones of the same key, but for created_at, which stays; the rest stays."""
    if "created_at" in held.columns and "created_at" in new.columns:
        first = held.select(*key, F.col("created_at").alias("__first"))
        new = new.join(first, key, "left").withColumn("created_at", F.coalesce("__first", "created_at")).drop("__first")
    return held.join(new, key, "left_anti").unionByName(new)
