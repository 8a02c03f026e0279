"""Stored state and its upkeep: versioned tables, run ledger, batches of changes, backfills, lookups."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions import normalize as N
from hirelens.functions.fold import composed
from hirelens.functions.html import hydrated
from hirelens.operators.blobs import put_contents, with_pointers
from hirelens.operators.snapshot import reconcile
from hirelens.sources.store import staged

COUNTERS = ("fetched", "mapped", "unique_rows", "deduped", "inserted", "updated", "closed", "failed")
LEDGER = "run_id string, source_id string, status string, started_at timestamp, finished_at timestamp, error_summary string, " + ", ".join(f"{c} long" for c in COUNTERS)
TARGET = ("embedding_kind", "embedding_target_revision", "embedding_model", "embedding_dim")


class StateConflict(Exception):
    """Another writer has put a version on the one that this writer began with."""


def _pointers(spark: SparkSession, root: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def newest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(number, what the pointer says) of the newest version; 0 and nothing if there is none."""
    folder, fs = _pointers(spark, root)
    if not fs.exists(folder):
        return 0, {}
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder))
    names = [n for n in names if n.isdigit()]
    if not names:
        return 0, {}
    said = spark.read.text(f"{root}/pointer/{names[-1]}", wholetext=True).first()
    return int(names[-1]), json.loads(said[0])


def point(spark: SparkSession, root: str, base: int, said: dict) -> None:
    """Makes `said` version base + 1. Its file is created only if it isn't there, so of two writers that began with the
    same version one fails."""
    folder, fs = _pointers(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{base + 1:010d}")
    own = spark._jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    fs.mkdirs(folder)
    if fs.exists(path):
        raise StateConflict(f"{root} has a version {base + 1} by another writer")
    out = fs.create(own, False)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    try:
        claimed = fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, f"claim-{base + 1:010d}"))
    except Exception as e:  # noqa: BLE001  whatever the file system says, the claim isn't ours
        raise StateConflict(f"{root}: version {base + 1} can't be claimed") from e
    if not claimed or not fs.rename(own, path):
        raise StateConflict(f"{root} has a version {base + 1} by another writer")


def write_state(df: DataFrame, root: str, base: int | None = None) -> str:
    """Writes a table's next version as a folder of its own, then names it by the next pointer. Readers keep the version
    they have; a job that is lost before the pointer leaves the old state. base: the number of the version that `df` was
    made from (default: the newest now); raises StateConflict if it isn't the newest any more."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    base = newest(spark, root)[0] if base is None else base
    df.write.parquet(f"{root}/versions/{version}")
    point(spark, root, base, {"version": version})
    return version


def read_state(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The table's newest version, or the one that is named."""
    return spark.read.parquet(f"{root}/versions/{version or newest(spark, root)[1]['version']}")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int").alias("bucket")


def reconcile_buckets(spark: SparkSession, root: str, snapshot: DataFrame, ts: Column, payload: list[str], buckets: int = 64, **how) -> tuple[DataFrame, list[int]]:
    """(changed rows with `action`, buckets that were written): brings `snapshot` (as for `snapshot.reconcile`) into the
    stored state at `root`, which is kept by bucket of source_id. Only the buckets of the snapshot's sources are read and
    written; the next pointer names their new folders beside the other buckets' old ones. Raises StateConflict if another
    writer was faster. A bucket's rows are spread over its files as the join left them, so a large source is no one
    task."""
    base, said = newest(spark, root)
    folders = said.get("buckets", {})
    snapshot = staged(snapshot, "snapshot")
    touched = sorted(r.bucket for r in snapshot.select(_bucket(buckets)).distinct().collect())  # no more than buckets
    kinds = dict(snapshot.dtypes)
    schema = "source_id string, external_job_id string, id string, status string, last_seen_at timestamp, created_at timestamp, updated_at timestamp, " + ", ".join(f"`{c}` {kinds[c]}" for c in payload)
    old = [folders[str(b)] for b in touched if str(b) in folders]
    held = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
    new = staged(reconcile(held, snapshot, ts, payload, **how).select("*", _bucket(buckets)), "reconciled")
    path = f"{root}/versions/{uuid.uuid4().hex}"
    new.drop("action").write.partitionBy("bucket").parquet(path)
    made = {str(r.bucket): f"{path}/bucket={r.bucket}" for r in new.select("bucket").distinct().collect()}
    point(spark, root, base, {"buckets": folders | made, "schema": schema})
    return new.where("action <> 'keep'").drop("bucket"), sorted(map(int, made))


def read_buckets(spark: SparkSession, root: str) -> DataFrame:
    """The newest state that `reconcile_buckets` has written."""
    said = newest(spark, root)[1]
    return spark.read.schema(said["schema"]).parquet(*said["buckets"].values())


def start_runs(ledger: DataFrame, sources: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, rejected source_ids) for `sources` (source_id): one with a running run is rejected."""
    running = ledger.where("status = 'running'").select("source_id").distinct()
    asked = sources.select("source_id").distinct()
    run = F.sha2(F.concat_ws("|", F.col("source_id"), at.cast("string")), 256)
    empty = {c: F.lit(None).cast("long").alias(c) for c in COUNTERS}
    rows = asked.join(running, "source_id", "left_anti").select(
        run.alias("run_id"), "source_id", F.lit("running").alias("status"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("error_summary"), *empty.values()
    )
    return rows, asked.join(running, "source_id", "left_semi")


def finish_runs(ledger: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """The ledger after `results` (source_id, error, counters) end the running runs of their sources. A run with an
    error has failed; so many rows as were met, and one at least, count as failed then."""
    r = results.select("source_id", "error", *(F.col(c).alias(f"__{c}") for c in COUNTERS if c != "failed" and c in results.columns))
    got = ledger.join(r, "source_id", "left")
    ends = (F.col("status") == "running") & F.coalesce(*(F.col(f"__{c}") for c in COUNTERS if f"__{c}" in got.columns), F.when(F.col("error").isNotNull(), 0)).isNotNull()
    met = F.greatest(*(F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in ("unique_rows", "mapped", "fetched") if f"__{c}" in got.columns), F.lit(1))
    out = {"status": F.when(ends, F.when(F.col("error").isNull(), "success").otherwise("failed")).otherwise(F.col("status")), "finished_at": F.when(ends, at).otherwise(F.col("finished_at")), "error_summary": F.when(ends, F.col("error")).otherwise(F.col("error_summary"))}
    out["failed"] = F.when(ends, F.when(F.col("error").isNull(), 0).otherwise(met)).otherwise(F.col("failed"))
    for c in COUNTERS:
        if f"__{c}" in got.columns:
            out[c] = F.when(ends, F.col(f"__{c}")).otherwise(F.col(c))
    return got.select(*(out.get(c, F.col(c)).alias(c) for c in ledger.columns))


def resolve_owners(rows: DataFrame, sources: DataFrame, key: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows with source_id, rows without an owner) by the key `platform:identifier`; a source_id that is there already
    stays if it is one."""
    known = sources.select(F.col("id").alias("__id"), N.source_key(F.col("platform"), F.col("identifier")).alias("__key"))
    given = F.col("source_id") if "source_id" in rows.columns else F.lit(None).cast("string")
    got = rows.withColumn("__given", given).join(known, F.trim(key) == F.col("__key"), "left").withColumnRenamed("__id", "__by_key")
    ids = sources.select(F.col("id").alias("__valid"))
    got = got.join(ids, F.col("__given") == F.col("__valid"), "left").withColumn("source_id", F.when(F.col("__given").isNull(), F.col("__by_key")).otherwise(F.col("__valid")))
    got = got.drop("__given", "__by_key", "__key", "__valid")
    return got.where("source_id IS NOT NULL"), got.where("source_id IS NULL")


def split_source_key(key: Column, platforms: tuple[str, ...]) -> Column:
    """struct(platform, identifier) of `platform:identifier`, cut at the first colon; unknown platform or no identifier:
    null."""
    platform, identifier = F.lower(F.trim(F.substring_index(key, ":", 1))), F.trim(F.regexp_extract(key, "(?s)^[^:]*:(.*)$", 1))
    return F.when(platform.isin(*platforms) & (identifier != ""), F.struct(platform.alias("platform"), identifier.alias("identifier")))


def apply_changes(rows: DataFrame, changes: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows after `changes`, changes whose row isn't there). `changes` (key, seq, fields map<string,string>) set only
    the columns they name, to null too; of several for a row and column the last counts."""
    each = changes.select(key, "seq", F.explode("fields").alias("name", "value"))
    last = each.groupBy(key, "name").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    gathered = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("v.value").alias("value")))).alias("__set"))  # at most a row's columns
    got = rows.join(gathered, key, "left")
    kinds = dict(rows.dtypes)
    out = {c: F.when(F.map_contains_key("__set", F.lit(c)), F.col("__set")[c].cast(kinds[c])).otherwise(F.col(c)) for c in rows.columns if c != key}
    if "updated_at" in out:
        out["updated_at"] = F.when(F.col("__set").isNotNull(), at).otherwise(F.col("updated_at"))
    return got.select(*(out.get(c, F.col(c)).alias(c) for c in rows.columns)), changes.join(rows.select(key), key, "left_anti")


def create_rows(rows: DataFrame, requests: DataFrame, sources: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(`rows` and those that `requests` create, rejected (request_id, reason)).

    requests: request_id, seq, source (`platform:identifier`) and source_id, external_job_id, description_html and any
    columns of rows. A given source_id must be one; else the key names the owner: no_owner. A row that is there already,
    or that an earlier request of the batch has created, is not created again: exists. A blank description_plain is that
    of the HTML; columns that a request lacks are null.
    """
    owned, ownerless = resolve_owners(requests, sources)
    order = F.struct(F.col("seq").isNotNull(), "seq", "request_id")
    owned = owned.withColumn("description_plain", hydrated(F.col("description_plain") if "description_plain" in requests.columns else F.lit(None).cast("string"), F.col("description_html")))
    first = owned.groupBy(F.col("source_id").alias("__s"), F.col("external_job_id").alias("__e")).agg(F.min(order)["request_id"].alias("__first"))
    there = rows.select(F.col("source_id").alias("__rs"), F.col("external_job_id").alias("__re"), F.lit(True).alias("__there")).distinct()
    same = lambda s, e: (F.col("source_id") == F.col(s)) & F.col("external_job_id").eqNullSafe(F.col(e))
    met = owned.join(first, same("__s", "__e")).join(there, same("__rs", "__re"), "left")
    new = F.col("__there").isNull() & (F.col("request_id") == F.col("__first"))
    made = met.where(new).withColumns({
        "id": F.sha2(F.concat_ws("|", "source_id", "external_job_id"), 256), "status": F.lit("open"), **{c: at for c in ("created_at", "updated_at", "last_seen_at")},
    })
    created = made.select(*((F.col(c) if c in made.columns else F.lit(None)).cast(kind).alias(c) for c, kind in rows.dtypes))
    rejected = ownerless.select("request_id", F.lit("no_owner").alias("reason")).unionByName(met.where(~new).select("request_id", F.lit("exists").alias("reason")))
    return rows.unionByName(created), rejected


def full_fingerprint(title: Column, description: Column) -> Column:
    """`content_fingerprint` of the compatibility-composed texts."""
    return N.content_fingerprint(composed(F.coalesce(title, F.lit(""))), composed(F.coalesce(description, F.lit(""))))


def backfill_fingerprints(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with content_fingerprint computed anew, one row of counts: scanned, updated, unchanged, missing). missing:
    had none before."""
    new = jobs.withColumn("__new", full_fingerprint(F.col("title"), F.col("description_plain")))
    same = F.col("content_fingerprint").eqNullSafe(F.col("__new"))
    counts = new.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~same).alias("updated"), F.count_if(same).alias("unchanged"), F.count_if(F.col("content_fingerprint").isNull()).alias("missing"))
    return new.withColumn("content_fingerprint", F.col("__new")).drop("__new"), counts


def backfill_unknown_links(jobs: DataFrame, links: DataFrame, unknown_id: str, at: Column) -> DataFrame:
    """`links` (job_id, location_id, is_primary, source_raw, created_at) and one to the unknown place, as primary, for
    each of `jobs` (job_id, location_text) with a text and without a primary link."""
    primary = links.where("is_primary").select("job_id")
    left = jobs.where(F.trim(F.coalesce("location_text", F.lit(""))) != "").join(primary, "job_id", "left_anti")
    return links.unionByName(left.select("job_id", F.lit(unknown_id).alias("location_id"), F.lit(True).alias("is_primary"), F.col("location_text").alias("source_raw"), at.alias("created_at")))


def _members(raw: str) -> list[tuple[str, str]]:
    """(name, text as it stands) of the members of a JSON object."""
    scan, blank = json.JSONDecoder().raw_decode, re.compile(r"[ \t\n\r]*").match
    at, found = blank(raw, blank(raw).end() + 1).end(), []
    while raw[at] != "}":
        start = at
        name, at = scan(raw, at)
        _, at = scan(raw, blank(raw, blank(raw, at).end() + 1).end())
        found.append((name, raw[start:at]))
        at = blank(raw, at).end()
        if raw[at] == ",":
            at = blank(raw, at + 1).end()
    return found


def without_members(c: Column, names: tuple[str, ...]) -> Column:
    """JSON objects without some members; the others stay byte for byte. What is no JSON object stays as it is."""

    def cut(raw: str | None) -> str | None:
        try:
            if raw is None or not isinstance(json.loads(raw), dict):
                return raw
        except ValueError:
            return raw
        members = _members(raw)
        kept = [text for name, text in members if name not in names]
        return raw if len(kept) == len(members) else "{" + ",".join(kept) + "}"

    return F.pandas_udf(lambda s: s.map(cut, na_action="ignore"), "string")(c)


# What a domain was called before.
OLD_DOMAIN_FIELDS = ("industry_raw", "industry_normalized", "job_domain_raw", "job_domain_normalized")


def reset_old_domains(jobs: DataFrame, version: int = 3) -> DataFrame:
    """`jobs` where rows of an older structured_jd_version, or none, lose their domain and the fields of its former name
    in structured_jd; its other values stay byte for byte."""
    old = F.coalesce(F.col("structured_jd_version"), F.lit(0)) < version
    return jobs.withColumns({
        "job_domain_raw": F.when(old, F.lit(None).cast("string")).otherwise(F.col("job_domain_raw")), "job_domain_normalized": F.when(old, "unknown").otherwise(F.col("job_domain_normalized")),
        "structured_jd": F.when(old, without_members(F.col("structured_jd"), OLD_DOMAIN_FIELDS)).otherwise(F.col("structured_jd")),
    })


def stamp_versions(jobs: DataFrame, version: int = 3) -> DataFrame:
    """`jobs` where a structured_jd without a structured_jd_version gets `version`."""
    bare = F.col("structured_jd").isNotNull() & F.col("structured_jd_version").isNull()
    return jobs.withColumn("structured_jd_version", F.when(bare, F.lit(version)).otherwise(F.col("structured_jd_version")))


def backfill_contents(jobs: DataFrame, folder: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(`jobs` with pointers in place of description_html and raw_payload, one row of counts: scanned, html_due, raw_due,
    plain_due, written) of `jobs` (description_plain, these texts, and their _key and _hash columns). Rows that have a
    pointer keep it; a blank description_plain is filled from the HTML. dry_run: only counts; `jobs` stay as they are."""
    blank = F.trim(F.coalesce("description_plain", F.lit(""))) == ""
    pointers = [f"{n}_{x}" for n in ("description_html", "raw_payload") for x in ("key", "hash")]
    bare = jobs.withColumns({"__html": F.when(F.col("description_html_key").isNull(), F.col("description_html")), "__raw": F.when(F.col("raw_payload_key").isNull(), F.col("raw_payload"))})
    pointed, contents = with_pointers(bare.withColumnsRenamed({c: f"__{c}" for c in pointers}), "__html", "__raw")
    due = lambda n: F.col(f"{n}_key").isNotNull()
    counts = pointed.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(due("description_html")).alias("html_due"), F.count_if(due("raw_payload")).alias("raw_due"), F.count_if(blank & (F.trim("description_html") != "")).alias("plain_due"))
    if dry_run:
        return jobs, counts.withColumn("written", F.lit(0).cast("long"))
    written = put_contents(contents, folder).where("written").count()
    done = pointed.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in pointers}).withColumn("description_plain", hydrated(F.col("description_plain"), F.col("description_html")))
    return done.select(*(c for c in jobs.columns if c not in ("description_html", "raw_payload"))), counts.withColumn("written", F.lit(written).cast("long"))


def listing(rows: DataFrame, order: list[str], status: str | None = None, offset: int = 0, limit: int = 100, **equal) -> DataFrame:
    """A page of `rows` by status and further equalities, in an order that ends with a key."""
    if status is not None:
        rows = rows.where(F.col("status") == status)
    for c, value in equal.items():
        rows = rows.where(F.col(c) == value)
    return rows.orderBy(*order).offset(offset).limit(limit)


def lookup(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose columns equal those of a row of `keys`, whichever columns these are: by id, by name and platform, by
    job ids and embedding target, ..."""
    return rows.join(keys.distinct(), keys.columns, "left_semi")


def ordered_lookup(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows for `ids` (key, pos), with their `pos`."""
    return rows.join(ids.select(key, "pos"), key)


def fresh_ids(batch: DataFrame, held: DataFrame, target: dict) -> DataFrame:
    """job_ids of `batch` (job_id, content_fingerprint) whose embedding of the target has the same fingerprint; equal
    nulls are the same."""
    of = held
    for c in TARGET:
        of = of.where(F.col(c) == target[c])
    h = of.select("job_id", F.col("content_fingerprint").alias("__held"))
    return batch.join(h, "job_id").where(F.col("content_fingerprint").eqNullSafe(F.col("__held"))).select("job_id").distinct()


def active_target(held: DataFrame, target: dict) -> DataFrame:
    """Embeddings of one target that can be searched."""
    out = held.where("embedding IS NOT NULL")
    for c in TARGET:
        out = out.where(F.col(c) == target[c])
    return out
