"""Counts, coverage, integrity, links and skills: joins and aggregations over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions import normalize as N


def request_metrics(log: DataFrame) -> DataFrame:
    """Per route and overall (route null) of `log` (route, duration, failed)."""
    return log.rollup("route").agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors"), F.round(F.avg("duration"), 4).alias("avg_duration"), F.max("duration").alias("max_duration"))


def status_histogram(log: DataFrame) -> DataFrame:
    """(route, statuses) per route and overall (route null) of `log` (route, status): requests by status, as a map. Counted
    by route and status first, so a group holds one row a status; requests without a status have no place in it."""
    counts = log.where("status IS NOT NULL").groupBy("route", "status").agg(F.count(F.lit(1)).alias("n"))
    overall = counts.groupBy("status").agg(F.sum("n").alias("n")).select(F.lit(None).cast(log.schema["route"].dataType).alias("route"), "status", "n")
    both = counts.where("route IS NOT NULL").unionByName(overall)
    return both.groupBy("route").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))


def usage_totals(usage: DataFrame, by: str, measures: list[str]) -> DataFrame:
    return usage.rollup(by).agg(*(F.sum(m).alias(m) for m in measures))


def coverage(rows: DataFrame, by: str, status: str, values: list[str]) -> DataFrame:
    """Rows by group and status, one column a status."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == v).alias(v) for v in values))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """One report (check, n) of the rows that each check finds."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).count().where(F.col("count") > 1)


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def outside(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(~F.col(column).isin(*allowed))


def reconcile_output(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing, unexpected or duplicate ids of a batch's output."""
    say = lambda df, what: df.select(key).distinct().withColumn("problem", F.lit(what))
    return say(expected.join(got, key, "left_anti"), "missing").unionByName(say(got.join(expected, key, "left_anti"), "unexpected")).unionByName(say(duplicates(got, [key]), "duplicate"))


def insert_absent(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`held` and those of `new` whose key it lacks; held rows never change."""
    return held.unionByName(new.dropDuplicates([key]).join(held, key, "left_anti").select(*held.columns))


def nested(rows: DataFrame, by: str, order: list, fields: list[str], name: str, parents: DataFrame | None = None) -> DataFrame:
    """Rows of each group as an array of structs, in the order of `order` (columns or expressions); for parents that have
    few rows each. With `parents` (by), those without rows have an empty array."""
    keys = [F.expr(o).alias(f"__{i}") for i, o in enumerate(order)]
    gathered = F.array_sort(F.collect_list(F.struct(*keys, *fields)))
    made = rows.groupBy(by).agg(F.transform(gathered, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))
    if parents is None:
        return made
    return parents.join(made, by, "left").withColumn(name, F.coalesce(name, F.array().cast(made.schema[name].dataType)))


def offload(rows: DataFrame, text: str, prefix: str, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(`rows` with sha256 and key in place of the text, contents that the store lacks: sha256, content). Blank
    texts have neither."""
    sha = F.when(F.trim(text) != "", F.sha2(text, 256))
    pointed = rows.withColumn("sha256", sha).withColumn("key", F.concat(F.lit(prefix + "/"), F.col("sha256"), F.lit(".gz")))
    store = pointed.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.any_value(text).alias("content"))
    return pointed.drop(text), store if held is None else store.join(held, "sha256", "left_anti")


def rehydrate(rows: DataFrame, store: DataFrame) -> DataFrame:
    return rows.join(store, "sha256", "left")


def taxonomy_aliases(taxonomy: DataFrame) -> DataFrame:
    """(alias, uri, seq) of `taxonomy` (seq, uri, label, alt_labels): the label and each alternative, also without
    what stands in parentheses, in skill spelling; blank uris don't count, and an alias belongs to the first."""
    parts = F.concat(F.array("label"), F.split(F.coalesce("alt_labels", F.lit("")), r"[\n|;,]"))
    both = F.flatten(F.transform(parts, lambda x: F.array(x, F.regexp_replace(x, r"\([^)]*\)", " "))))
    spread = taxonomy.where(F.trim("uri") != "").select("seq", "uri", F.explode(both).alias("raw")).withColumn("alias", N.skill_text(F.col("raw")))
    return spread.where(F.col("alias") != "").groupBy("alias").agg(F.min_by("uri", F.struct("seq", "uri")).alias("uri"), F.min("seq").alias("seq"))


def patched_aliases(base: DataFrame, patch: DataFrame) -> DataFrame:
    return base.join(patch, "alias", "left_anti").unionByName(patch)


def align_skills(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """`skills` (raw, ...) with alias, uri and status: mapped or unknown."""
    spelt = skills.withColumn("alias", N.skill_text(F.col("raw")))
    return spelt.join(aliases.select("alias", "uri"), "alias", "left").withColumn("status", F.when(F.col("uri").isNull(), "unknown").otherwise("mapped"))


def pending_parse(rows: DataFrame, version: int, version_only: bool = False, exclude: DataFrame | None = None) -> DataFrame:
    """Rows with content (description_plain or description_html_key) that have no structured_jd (unless version_only)
    or one of a structured_version below `version`; not those whose job_id is in `exclude`. One without a version is left
    alone."""
    old = F.coalesce(F.col("structured_version") < version, F.lit(False))
    old = F.when(F.col("structured_jd").isNull(), F.lit(not version_only)).otherwise(old)
    left = rows.where((F.col("description_plain").isNotNull() | F.col("description_html_key").isNotNull()) & old)
    return left if exclude is None else left.join(exclude.select("job_id"), "job_id", "left_anti")


def run_coverage(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per platform, and in all (platform null): sources, those whose newest run is a success, failed or running,
    those without a run, and success_rate, the share of successes among runs that have ended (null if none has).

    sources: id, platform. ledger: source_id, status, started_at. Runs of other sources don't count."""
    newest = ledger.groupBy("source_id").agg(F.max_by("status", F.struct("started_at", "status")).alias("status"))
    met = sources.select(F.col("id").alias("source_id"), "platform").join(newest, "source_id", "left")
    has = lambda x: F.count_if(F.col("status") == x)
    counted = met.rollup("platform").agg(F.count(F.lit(1)).alias("sources"), *(has(x).alias(x) for x in ("success", "failed", "running")), F.count_if(F.col("status").isNull()).alias("not_started"))
    return counted.withColumn("success_rate", F.try_divide(F.col("success"), F.col("success") + F.col("failed")))
