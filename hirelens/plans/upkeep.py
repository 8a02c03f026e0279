"""Queries over stored state: ledger, changes, backfills, lookups, further terms, streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions import normalize as N
from hirelens.operators import blobs as B
from hirelens.operators import embeddings as E
from hirelens.operators import ledger as G
from hirelens.operators import records as R
from hirelens.operators import snapshot as S
from hirelens.plans.registry import DOMAIN_SQL, J, query
from hirelens.sources import files
from hirelens.sources.fixtures import jobs, shared_folder, staged, table
from hirelens.streaming import jobs as stream
from hirelens.streaming import snapshots

AT = "2030-01-01"


def _at():
    return F.lit(AT).cast("timestamp")


def _ledger(spark, sf_dir):
    """A run per event of two kinds; the last of some users is still running."""
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'error')")
    status = F.when((F.col("event_id") % 10 == 0) & (F.col("event_type") == "view"), "running").when(F.col("event_type") == "error", "failed").otherwise("success")
    return e.select(
        F.col("event_id").cast("string").alias("run_id"), F.col("user_id").cast("string").alias("source_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("error_summary"), *(F.lit(None).cast("long").alias(c) for c in G.COUNTERS),
    )


RUNS = "l AS (SELECT CAST(event_id AS VARCHAR) AS run_id, CAST(user_id AS VARCHAR) AS source_id, CASE WHEN event_id % 10 = 0 AND event_type = 'view' THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events WHERE event_type IN ('view', 'error'))"


@query(f"WITH {RUNS}, r AS (SELECT DISTINCT source_id FROM l WHERE status = 'running') SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN CAST(c_custkey AS VARCHAR) IN (SELECT source_id FROM r) THEN 'rejected' ELSE 'running' END AS status FROM customer")
def o92_start_runs(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"))
    started, rejected = G.start_runs(_ledger(spark, sf_dir), sources, _at())
    return started.select("source_id", "status").unionByName(rejected.withColumn("status", F.lit("rejected")))


@query(f"""WITH {RUNS} SELECT run_id, CASE WHEN status = 'running' AND CAST(source_id AS BIGINT) % 3 <> 0 THEN CASE WHEN CAST(source_id AS BIGINT) % 3 = 1 THEN 'failed' ELSE 'success' END ELSE status END AS status,
  CASE WHEN status = 'running' THEN CASE CAST(source_id AS BIGINT) % 3 WHEN 1 THEN CAST(source_id AS BIGINT) + 1 WHEN 2 THEN 0 END END AS failed FROM l""")
def o92_finish_runs(spark, sf_dir):
    n = F.col("c_custkey")
    results = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(n.cast("string").alias("source_id"), F.when(n % 3 == 1, "boom").alias("error"), n.alias("mapped"), (n + 1).alias("fetched"), n.alias("unique_rows"))
    return G.finish_runs(_ledger(spark, sf_dir), results, _at()).select("run_id", "status", "failed")


@query(f"WITH {J} SELECT job_id, source_id, job_id % 3 <> 0 AS owned FROM (SELECT job_id, CASE WHEN job_id % 3 <> 0 THEN source_id END AS source_id FROM j)")
def o61_owners(spark, sf_dir):
    """By key for most rows; some have a source_id of their own, and some keys no source."""
    rows = jobs(spark, sf_dir)
    sources = rows.select(F.col("source_id").alias("id")).distinct().select("id", F.lit("lever").alias("platform"), F.concat(F.lit(" "), F.upper("id")).alias("identifier"))
    own = F.when(F.col("job_id") % 3 == 2, F.col("source_id"))
    keyed = rows.select("job_id", own.alias("source_id"), F.when(F.col("job_id") % 3 == 0, "lever:nobody").when(F.col("job_id") % 3 == 1, F.concat(F.lit(" lever:"), F.upper("source_id"))).alias("source"))
    good, bad = G.resolve_owners(keyed, sources)
    return good.select("job_id", "source_id", F.lit(True).alias("owned")).unionByName(bad.select("job_id", "source_id", F.lit(False).alias("owned")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'lever' END AS platform, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ':x' END AS identifier FROM customer")
def o26_split_key(spark, sf_dir):
    k = F.col("c_custkey") % 3
    key = F.when(k == 0, F.concat(F.lit(" Lever: "), "c_mktsegment", F.lit(":x"))).when(k == 1, F.concat(F.lit("other:"), "c_mktsegment")).otherwise("lever:")
    got = G.split_source_key(key, ("lever", "ashby"))
    return table(spark, sf_dir, "customer").select("c_custkey", got["platform"].alias("platform"), got["identifier"].alias("identifier"))


@query(f"""WITH {J} SELECT job_id, CASE WHEN job_id % 4 = 0 THEN 'new ' || job_id WHEN job_id % 4 = 1 THEN NULL ELSE title END AS title, CASE WHEN job_id % 4 = 0 THEN 'closed' ELSE status END AS status,
  CASE WHEN job_id % 4 < 2 THEN TIMESTAMP '{AT}' ELSE last_seen_at END AS updated_at FROM j""")
def o94_changes(spark, sf_dir):
    """Two changes of a row touch one column; the later counts. A change may set a null."""
    rows = jobs(spark, sf_dir).select("job_id", "title", "status", F.col("last_seen_at").alias("updated_at"))
    pairs = lambda **f: F.map_from_arrays(F.array(*map(F.lit, f)), F.array(*f.values()))
    first = rows.where("job_id % 4 = 0").select("job_id", F.lit(1).alias("seq"), pairs(title=F.lit("old"), status=F.lit("closed")).alias("fields"))
    then = rows.where("job_id % 4 < 2").select("job_id", F.lit(2).alias("seq"), pairs(title=F.when(F.col("job_id") % 4 == 0, F.concat(F.lit("new "), F.col("job_id").cast("string")))).alias("fields"))
    return G.apply_changes(rows, first.unionByName(then), "job_id", _at())[0]


@query(f"WITH {J} SELECT count(*) AS scanned, count(*) FILTER (WHERE job_id % 3 <> 0) AS updated, count(*) FILTER (WHERE job_id % 3 = 0) AS unchanged, count(*) FILTER (WHERE job_id % 3 = 1) AS missing FROM j")
def o95_fingerprints(spark, sf_dir):
    rows = jobs(spark, sf_dir).select("job_id", "title", "description_plain")
    held = F.when(F.col("job_id") % 3 == 0, N.content_fingerprint(F.col("title"), F.col("description_plain"))).when(F.col("job_id") % 3 == 2, "cfp:v1:other")
    return G.backfill_fingerprints(rows.withColumn("content_fingerprint", held))[1]


@query("""SELECT o_orderkey AS job_id, 'unknown' AS location_id, 'text ' || o_orderkey AS source_raw FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1)
  UNION ALL SELECT l_orderkey, CAST(l_partkey AS VARCHAR), NULL FROM lineitem WHERE l_linenumber = 1""")
def o93_unknown_links(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").cast("string").alias("location_id"), (F.col("l_linestatus") == "F").alias("is_primary"), F.lit(None).cast("string").alias("source_raw"), F.col("l_shipdate").alias("created_at"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("text "), F.col("o_orderkey").cast("string"))).otherwise(" ").alias("location_text"))
    return G.backfill_unknown_links(rows, links, "unknown", _at()).select("job_id", "location_id", "source_raw")


_STORED = '{"skills":["a, \\"b\\"", {"industry_raw": 1}], "years":%s, "note": null'


@query(f"""WITH r AS (SELECT o_orderkey AS job_id, o_orderkey % 5 < 3 AS old, replace('{_STORED}', '%s', o_totalprice::DECIMAL(18,2)::VARCHAR || '0') AS head FROM orders)
  SELECT job_id, CASE WHEN old THEN 'unknown' ELSE 'sales' END AS job_domain_normalized, CASE WHEN job_id % 7 = 0 THEN 'no JSON' WHEN old THEN replace(head, ', "years"', ',"years"').replace(', "note"', ',"note"') || '}}' ELSE head || ', "industry_raw" : "x" }}' END AS structured_jd FROM r""")
def o93_reset_domains(spark, sf_dir):
    """What is stored holds lists, objects, numbers and nulls; what stays is as it was written."""
    k = F.col("o_orderkey") % 5
    head = F.replace(F.lit(_STORED), F.lit("%s"), F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("0")))
    stored = F.when(F.col("o_orderkey") % 7 == 0, "no JSON").otherwise(F.concat(head, F.lit(', "industry_raw" : "x" }')))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(k != 0, k).alias("structured_jd_version"), F.lit("s").alias("job_domain_raw"), F.lit("sales").alias("job_domain_normalized"), stored.alias("structured_jd"))
    return G.reset_old_domains(rows).select("job_id", "job_domain_normalized", "structured_jd")


@query(f"WITH {J} SELECT job_id, title FROM j WHERE status = 'open' AND source_id = 'src3' ORDER BY job_id LIMIT 50 OFFSET 20")
def o56_listing(spark, sf_dir):
    return G.listing(jobs(spark, sf_dir), ["job_id"], "open", 20, 50, source_id="src3").select("job_id", "title")


@query(f"WITH {J} SELECT job_id, title FROM j WHERE (source_id, external_job_id) IN (SELECT 'src' || (c_custkey % 20), 'ext-' || (c_custkey * 3) FROM customer)")
def o56b_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("src"), (F.col("c_custkey") % 20).cast("string")).alias("source_id"), F.concat(F.lit("ext-"), (F.col("c_custkey") * 3).cast("string")).alias("external_job_id"))
    return G.lookup(jobs(spark, sf_dir), keys).select("job_id", "title")


@query(f"WITH {J} SELECT job_id, -c_custkey AS pos FROM customer JOIN j ON c_custkey * 7 = job_id")
def o77c_ordered_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("job_id"), (-F.col("c_custkey")).alias("pos"))
    return G.ordered_lookup(jobs(spark, sf_dir), "job_id", ids).select("job_id", "pos")


TARGET = {"embedding_kind": "job", "embedding_target_revision": 1, "embedding_model": "m", "embedding_dim": 64}


@query("SELECT vec_id AS job_id FROM embeddings WHERE vec_id % 4 < 2 AND vec_id % 3 <> 0")
def o59b_fresh_ids(spark, sf_dir):
    k = F.col("vec_id")
    held = table(spark, sf_dir, "embeddings").select(k.alias("job_id"), "embedding", *(F.lit(v).alias(c) for c, v in TARGET.items() if c != "embedding_target_revision"), F.when(k % 3 != 0, 1).otherwise(2).alias("embedding_target_revision"), F.when(k % 4 != 0, F.lit("f")).alias("content_fingerprint"))
    batch = held.select("job_id", F.when(F.col("job_id") % 4 == 1, "f").when(F.col("job_id") % 4 != 0, "g").alias("content_fingerprint"))
    return G.fresh_ids(batch, G.active_target(held, TARGET), TARGET)


_EMBEDDABLE = """SELECT job_id, CASE WHEN job_id % 13 <> 0 THEN description_plain END AS description, CASE job_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'g' END AS content_fingerprint, source_id, status,
  CASE WHEN job_id % 7 <> 0 THEN '{}' END AS structured_jd, CASE WHEN job_id % 5 <> 0 THEN job_id % 5 END AS structured_jd_version FROM j"""
_STALE = "description IS NOT NULL AND (hit IS NULL OR fp IS DISTINCT FROM content_fingerprint)"


@query(f"""WITH {J}, e AS ({_EMBEDDABLE}), h AS (SELECT vec_id AS job_id, CASE WHEN vec_id % 4 <> 0 THEN 'f' END AS fp, 1 AS hit FROM embeddings), m AS (SELECT * FROM e LEFT JOIN h USING (job_id))
  SELECT 'all' AS variant, job_id FROM m WHERE {_STALE} UNION ALL SELECT 'forced', job_id FROM m WHERE description IS NOT NULL
  UNION ALL SELECT 'structured', job_id FROM m WHERE {_STALE} AND structured_jd IS NOT NULL AND coalesce(structured_jd_version, 0) >= 3
  UNION ALL SELECT 'source', job_id FROM m WHERE {_STALE} AND source_id = 'src3' AND status = 'open'""")
def o59_to_embed(spark, sf_dir):
    """All that need an embedding, and by force, of parsed jobs only, and of one source's open jobs."""
    rows = spark.sql(_EMBEDDABLE.replace("FROM j", "FROM {j}").replace("'{}'", "'{{}}'"), j=jobs(spark, sf_dir))
    k = F.col("vec_id")
    held = table(spark, sf_dir, "embeddings").select(k.alias("job_id"), F.when(k % 4 != 0, "f").alias("content_fingerprint"))
    variants = {"all": {}, "forced": {"force": True}, "structured": {"structured_version": 3}, "source": {"source_id": "src3"}}
    return reduce(DataFrame.unionByName, (E.to_embed(rows, held, **how).select(F.lit(name).alias("variant"), "job_id") for name, how in variants.items()))


TARGET = {"embedding_kind": "job", "embedding_target_revision": 1, "embedding_model": "m", "embedding_dim": 4}


def _embed(texts):
    """A stand-in for a service: says how long a text is; gardeners' vectors have a number too few."""
    return [[float(len(t)), 0.5, 1.0, *([] if "Gardener" in t else [2.0])] for t in texts]


@query(f"""WITH {J}, t AS (SELECT job_id, length('Title: ' || title || CASE WHEN d <> 'unknown' THEN chr(10) || chr(10) || 'Domain: ' || replace(d, '_', ' ') ELSE '' END || chr(10) || chr(10) || 'Additional role context:' || chr(10) || '- Role ' || job_id) AS n, title,
    job_id % 3 AS k, status FROM (SELECT *, {DOMAIN_SQL('title')} AS d FROM j)), r AS (SELECT *, status = 'open' AND k <> 0 AND NOT contains(title, 'Gardener') AS refreshed FROM t)
  SELECT job_id, 1 AS revision, CASE WHEN refreshed THEN n ELSE -1 END AS first, CASE WHEN refreshed OR k = 0 THEN 'f' || job_id ELSE 'old' END AS fingerprint, CASE WHEN k = 2 THEN '{AT}' ELSE '2020-01-01' END AS created, CASE WHEN refreshed THEN '{AT}' ELSE '2020-01-01' END AS updated
  FROM r WHERE k <> 2 OR refreshed UNION ALL SELECT job_id, 2, -1, 'old', '2020-01-01', '2020-01-01' FROM t WHERE k = 1 UNION ALL
  SELECT NULL, count_if(status = 'open' AND k <> 0), count_if(refreshed), 'counts', NULL, CAST(count_if(status = 'open' AND k <> 0 AND NOT refreshed) AS VARCHAR) FROM r""")
def o88_refresh_upsert(spark, sf_dir):
    """Open postings whose embedding is stale or missing: their texts, calls of a stand-in, upsert; a held row keeps its
    created_at, other targets' rows stay, and a vector that doesn't fit leaves what is held."""
    rows = N.with_domain(jobs(spark, sf_dir), "title", "job_domain").select(
        "job_id", "title", "status", F.concat(F.lit("Role "), F.col("job_id").cast("string")).alias("description"), F.concat(F.lit("f"), F.col("job_id").cast("string")).alias("content_fingerprint"), "job_domain",
        F.lit(None).cast("array<string>").alias("required_skills"), F.lit(None).cast("array<string>").alias("preferred_skills"), F.lit(None).cast("string").alias("seniority_level"),
    )
    k, past = F.col("job_id") % 3, F.lit("2020-01-01").cast("timestamp")
    had = rows.where(k != 2).select("job_id", *(F.lit(x).alias(c) for c, x in TARGET.items()), F.array(*[F.lit(-1.0).cast("float")] * 4).alias("embedding"), F.when(k == 0, F.col("content_fingerprint")).otherwise("old").alias("content_fingerprint"), past.alias("created_at"), past.alias("updated_at"))
    held = staged(had.unionByName(had.where(k == 1).withColumn("embedding_target_revision", F.lit(2))), "held")
    got, counts = E.refresh_embeddings(rows.where("status = 'open'"), held, _embed, TARGET, _at(), f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    shown = got.select("job_id", F.col("embedding_target_revision").cast("long").alias("revision"), F.get("embedding", F.lit(0)).cast("long").alias("first"), F.col("content_fingerprint").alias("fingerprint"), day("created_at").alias("created"), day("updated_at").alias("updated"))
    return shown.unionByName(counts.select(F.lit(None).cast("long").alias("job_id"), F.col("selected").alias("revision"), F.col("refreshed").alias("first"), F.lit("counts").alias("fingerprint"), F.lit(None).cast("string").alias("created"), F.col("failed").cast("string").alias("updated")))


@query("SELECT doc_id, length(text) AS n FROM documents")
def o12_state(spark, sf_dir):
    root = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    G.write_state(docs.limit(1), root)
    G.write_state(docs, root)
    return G.read_state(spark, root)


@query(f"""WITH {J}, l AS (SELECT source_id, external_job_id, arg_max(title, job_id) AS title FROM j GROUP BY 1, 2), s AS (SELECT source_id, external_job_id, title, source_id IN ('src1', 'src2') AS again, hash_of % 3 = 0 AS gone
    FROM (SELECT *, CAST(substr(external_job_id, 5) AS INTEGER) AS hash_of FROM l))
  SELECT source_id, external_job_id, title || CASE WHEN again AND NOT gone THEN '!' ELSE '' END AS title, CASE WHEN again AND gone THEN 'closed' ELSE 'open' END AS status, CASE WHEN again THEN '{AT}' ELSE '2029-01-01' END AS updated, true AS conflict FROM s""")
def o12_bucketed_state(spark, sf_dir):
    """A state of all sources, then a snapshot of two of them, which rewrites only their buckets; a writer that began
    with the first version can't put its own on it."""
    rows = S.last_wins(jobs(spark, sf_dir).select("source_id", "external_job_id", "title", F.col("job_id").alias("seq"))).drop("seq", "first_seq")
    root = f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    G.reconcile_buckets(spark, root, rows, F.lit("2029-01-01").cast("timestamp"), ["title"], 16)
    base, before = G.newest(spark, root)
    some = rows.where("source_id IN ('src1', 'src2') AND cast(substr(external_job_id, 5) AS int) % 3 <> 0").withColumn("title", F.concat("title", F.lit("!")))
    _, written = G.reconcile_buckets(spark, root, some, _at(), ["title"], 16)
    after = G.newest(spark, root)[1]
    if len(written) > 2 or any(before["buckets"][b] != x for b, x in after["buckets"].items() if int(b) not in written):
        raise AssertionError("buckets of other sources were rewritten")
    try:
        G.point(spark, root, base, before)
        conflict = False
    except G.StateConflict:
        conflict = True
    return G.read_buckets(spark, root).select("source_id", "external_job_id", "title", "status", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"), F.lit(conflict).alias("conflict"))


@query("""WITH p AS (SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN '{"a":1,"b":[' || page_id // 8 || ']}' ELSE 'no JSON' END AS raw FROM pages),
  k AS (SELECT page_id, CASE WHEN trim(html) <> '' THEN 'job-html/' || sha256(html) || '.html.gz' END AS html_key, CASE WHEN page_id % 4 = 2 THEN 'job-raw/' || sha256(raw) || '.json.gz' END AS raw_key FROM p)
  SELECT page_id, html_key, raw_key, CASE WHEN html_key IS NOT NULL THEN 'ok' END AS state, 0 AS written_again FROM k""")
def o09_store(spark, sf_dir):
    """Contents put into the store, put again, and read back with their hashes checked."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("description_html"), F.when(F.col("page_id") % 4 == 1, "{ }").when(F.col("page_id") % 4 == 2, F.concat(F.lit('{"b": ['), F.floor(F.col("page_id") / 8).cast("string"), F.lit('], "a": 1}'))).when(F.col("page_id") % 4 == 3, "no JSON").alias("raw_payload"))
    pointed, contents = B.with_pointers(rows)
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    B.put_contents(contents, folder)
    again = B.put_contents(contents, folder).where("written").count()
    found = B.read_contents(contents, folder).select(F.col("key").alias("description_html_key"), F.when(F.sha2("content", 256) == F.col("sha256"), F.col("state")).otherwise("damaged").alias("state"))
    return pointed.join(found, "description_html_key", "left").select("page_id", F.col("description_html_key").alias("html_key"), F.col("raw_payload_key").alias("raw_key"), "state", F.lit(again).alias("written_again"))


@query("""WITH s AS (SELECT user_id AS id, 'p' || (user_id % 4) AS platform FROM (SELECT DISTINCT user_id FROM events)), r AS (SELECT user_id AS id, arg_max(event_type, event_id) AS last FROM events WHERE event_type IN ('view', 'error', 'click') AND user_id % 3 <> 0 GROUP BY 1),
  m AS (SELECT platform, CASE last WHEN 'view' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' END AS status FROM s LEFT JOIN r USING (id))
  SELECT platform, count(*) AS sources, count_if(status = 'success') AS success, count_if(status = 'failed') AS failed, count_if(status = 'running') AS running, count_if(status IS NULL) AS not_started,
    count_if(status = 'success') / nullif(count_if(status = 'success') + count_if(status = 'failed'), 0)::DOUBLE AS success_rate FROM m GROUP BY ROLLUP (platform)""")
def o71_run_coverage(spark, sf_dir):
    """Sources by platform and how their newest run ended."""
    e = table(spark, sf_dir, "events")
    sources = e.select(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("platform")).distinct()
    status = F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running")
    runs = e.where("user_id % 3 <> 0").select(F.col("user_id").cast("string").alias("source_id"), status.alias("status"), F.col("event_id").alias("started_at")).where("status IS NOT NULL")
    return R.run_coverage(sources, runs)


@query(f"""WITH {J}, held AS (SELECT DISTINCT source_id, external_job_id FROM j WHERE job_id % 2 = 0), q AS (SELECT job_id, source_id, external_job_id, source_id = 'src3' AND job_id % 4 <> 1 AS ownerless, row_number() OVER (PARTITION BY source_id, external_job_id, source_id = 'src3' AND job_id % 4 <> 1 ORDER BY job_id) AS n FROM j WHERE job_id % 2 = 1)
  SELECT job_id AS request_id, CASE WHEN ownerless THEN 'no_owner' WHEN n > 1 OR (source_id, external_job_id) IN (SELECT (source_id, external_job_id) FROM held) THEN 'exists' ELSE 'created' END AS outcome, CASE WHEN ownerless OR n > 1 OR (source_id, external_job_id) IN (SELECT (source_id, external_job_id) FROM held) THEN NULL ELSE 'text ' || job_id END AS plain FROM q""")
def o94_create(spark, sf_dir):
    """A batch of new postings: owners by id or by key, one unknown; some are there already or come twice."""
    j = jobs(spark, sf_dir)
    sources = j.where("source_id <> 'src3' OR job_id % 4 = 1").select(F.col("source_id").alias("id"), F.lit("lever").alias("platform"), F.concat(F.lit("b"), "source_id").alias("identifier")).distinct()
    k = F.col("job_id")
    asked = j.where("job_id % 2 = 1").select(
        k.alias("request_id"), k.alias("seq"), F.concat(F.lit("lever:b"), F.when((F.col("source_id") == "src3") & (k % 4 != 1), "none").otherwise(F.col("source_id"))).alias("source"),
        F.when(k % 3 == 0, F.when((F.col("source_id") == "src3") & (k % 4 != 1), "none").otherwise(F.col("source_id"))).alias("source_id"), "external_job_id", F.concat(F.lit("<p>text "), k.cast("string"), F.lit("</p>")).alias("description_html"), k.cast("string").alias("title"),
    )
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("description_plain", "string"), ("status", "string"), ("created_at", "timestamp"))}
    held = j.where("job_id % 2 = 0").select("source_id", "external_job_id").distinct().select(F.lit("held").alias("id"), "source_id", "external_job_id", *none.values())
    got, rejected = G.create_rows(held, asked, sources, _at())
    made = got.where("id <> 'held'").select(F.col("title").cast("long").alias("request_id"), F.lit("created").alias("outcome"), F.col("description_plain").alias("plain"))
    return made.unionByName(rejected.select("request_id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("plain")))


@query("""WITH p AS (SELECT page_id, page_id % 3 = 0 AS pointed, CASE WHEN page_id % 2 = 0 THEN '{"a":' || page_id || '}' END AS raw, trim(coalesce(html, '')) <> '' AS has, html FROM pages), c AS (SELECT count(*) AS scanned, count_if(NOT pointed AND has) AS html_due, count(raw) AS raw_due, count_if(page_id % 5 = 0 AND has) AS plain_due FROM p)
  SELECT page_id, CASE WHEN pointed THEN 'old' WHEN has THEN 'job-html/' || sha256(html) || '.html.gz' END AS html_key, CASE WHEN raw IS NOT NULL THEN 'job-raw/' || sha256(raw) || '.json.gz' END AS raw_key, page_id % 5 = 0 AND NOT has AS still_blank, CASE WHEN page_id % 4 = 0 THEN 3 END AS version, scanned, html_due, raw_due, plain_due, 0 AS dry FROM p, c""")
def o93_contents_and_versions(spark, sf_dir):
    """Contents moved to the store, blank texts filled, versions stamped; the dry run before it counts the same and writes
    nothing."""
    k = F.col("page_id")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.col("html").alias("description_html"), F.when(k % 2 == 0, F.concat(F.lit('{"a": '), k.cast("string"), F.lit("}"))).alias("raw_payload"), F.when(k % 5 != 0, "text").alias("description_plain"),
        F.when(k % 3 == 0, "old").alias("description_html_key"), F.when(k % 3 == 0, "old").alias("description_html_hash"), none.alias("raw_payload_key"), none.alias("raw_payload_hash"),
        F.when(k % 4 == 0, "{}").alias("structured_jd"), F.lit(None).cast("int").alias("structured_jd_version"),
    )
    folder = f"{shared_folder(spark)}/moved-{uuid.uuid4().hex}"
    dry = G.backfill_contents(rows, folder, dry_run=True)[1].first()
    done, counts = G.backfill_contents(rows, folder)
    n = counts.first()
    if dry[:4] != n[:4] or n["written"] == 0:
        raise AssertionError(f"the dry run counts {dry}, the run {n}")
    totals = [F.lit(n[c]).alias(c) for c in ("scanned", "html_due", "raw_due", "plain_due")]
    blank = F.trim(F.coalesce("description_plain", F.lit(""))) == ""
    return G.stamp_versions(done).select("page_id", F.col("description_html_key").alias("html_key"), F.col("raw_payload_key").alias("raw_key"), (blank & F.col("description_html_key").isNull()).alias("still_blank"), F.col("structured_jd_version").alias("version"), *totals, F.lit(dry["written"]).alias("dry"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS workplace, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS number,
  CASE WHEN p_size <= 1 THEN 'junior' WHEN p_size <= 4 THEN 'mid' WHEN p_size <= 8 THEN 'senior' ELSE 'director' END AS level, 'SQL|go' AS cleaned FROM part""")
def o31_o32_o41_o48_terms(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_size")
    hint = F.when(k % 4 == 0, "Hybrid or REMOTE").when(k % 4 == 1, "hybrid, on-site").when(k % 4 == 2, "On Site").otherwise("x")
    number = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".7"))).otherwise(F.concat(F.lit(" "), k.cast("string")))
    listed = N.clean_list(F.array(F.lit(" SQL "), F.lit(""), F.lit("sql"), F.lit(None).cast("string"), F.lit("go"), F.lit("rust")), 2)
    return p.select("p_partkey", N.workplace(F.array(F.lit("y"), hint), "unknown").alias("workplace"), N.best_int(number).alias("number"), N.seniority_of_years(k).alias("level"), F.array_join(listed, "|").alias("cleaned"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND text <> ''")
def o57_purge(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "").when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"))
    return S.purge_empty(rows, "text").select("doc_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def o81_first_seen(spark, sf_dir):
    """Every pair once; with a watermark as wide as the data, repeats never come too late to be known."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    at = f"{shared_folder(spark)}/first-seen-{uuid.uuid4().hex}"
    out = stream.first_seen(rows, ["user_id", "event_type"], late="60 days")
    stream.run_once(out, f"{at}/out", f"{at}/log")
    return spark.read.schema(out.schema).parquet(f"{at}/out").select("user_id", "event_type")


#: Days of three snapshots; five sources' third one fails.
DAYS = ("2024-01-01", "2024-01-02", "2024-01-03")
THIRD_FAILS = "source_id IN ('src0', 'src1', 'src2', 'src3', 'src4')"


def _landed(spark, sf_dir):
    """A folder of snapshots that land in pieces, as rows and marks: the second one's end before its rows, half of the
    first one behind it, a piece again, and a late piece of an ended one."""
    rows = jobs(spark, sf_dir).select("source_id", "external_job_id", "title", F.col("job_id").alias("seq"))
    days = reduce(DataFrame.unionByName, (rows.where((F.col("seq") + n) % 3 != 0).withColumn("day", F.lit(n)) for n in (1, 2, 3)))
    held = staged(days.withColumn("kind", F.lit("row")), "snapshot-rows")
    sources = held.select("source_id").distinct()

    def mark(n, kind, where="true"):
        nothing = {c: F.lit(None).cast(k).alias(c) for c, k in (("external_job_id", "string"), ("title", "string"), ("seq", "long"))}
        return sources.where(where).select("source_id", *nothing.values(), F.lit(n).alias("day"), F.lit(kind).alias("kind"))

    half = F.col("seq") % 2 == 0
    pieces = [
        held.where((F.col("day") == 1) & half), mark(2, "end").unionByName(held.where("day = 3")), held.where((F.col("day") == 1) & ~half).unionByName(mark(1, "end")).unionByName(held.where((F.col("day") == 2) & half)),
        mark(3, "end", f"NOT {THIRD_FAILS}").unionByName(mark(3, "failed", THIRD_FAILS)), held.where("day = 1").unionByName(mark(1, "end")), held.where((F.col("day") == 2) & ~half),
    ]
    path = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    at = F.element_at(F.array(*(F.lit(d).cast("timestamp") for d in DAYS)), F.col("day"))
    for piece in pieces:
        piece.withColumn("at", at).drop("day").coalesce(1).write.mode("append").parquet(path)
    return path


@query(f"""WITH {J}, d AS (SELECT * FROM (VALUES (1), (2), (3)) t(n)), r AS (SELECT source_id, external_job_id, job_id, title, n FROM j CROSS JOIN d WHERE (job_id + n) % 3 <> 0 AND NOT (n = 3 AND {THIRD_FAILS})),
  k AS (SELECT source_id, external_job_id, arg_max(title, CAST(n AS BIGINT) * 1000000000 + job_id) AS title, min(n) AS first, max(n) AS last, CASE WHEN {THIRD_FAILS} THEN 2 ELSE 3 END AS ended FROM r GROUP BY 1, 2)
  SELECT source_id, external_job_id, title, CASE WHEN last < ended THEN 'closed' ELSE 'open' END AS status, '2024-01-0' || first AS created, '2024-01-0' || last AS last_seen, '2024-01-0' || CASE WHEN last < ended THEN last + 1 ELSE last END AS updated FROM k""")
def o79_streaming_reconcile(spark, sf_dir):
    """Three snapshots of each source by micro-batches of a file: the state is that of whole snapshots in order."""
    path, root = _landed(spark, sf_dir), f"{shared_folder(spark)}/reconcile-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    snapshots.reconcile_snapshots(stream, root, ["title"], buckets=4, partitions=8)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return snapshots.read_reconciled(spark, root, "title string").select("source_id", "external_job_id", "title", "status", day("created_at").alias("created"), day("last_seen_at").alias("last_seen"), day("updated_at").alias("updated"))


@query(f"""WITH {J}, t AS (SELECT DISTINCT trim(title) AS raw FROM j WHERE trim(title) <> '') SELECT 'aligned' AS kind, raw, lower(raw) AS alias, CASE WHEN contains(raw, 'Engineer') THEN 'u:' || length(raw) END AS uri, CASE WHEN contains(raw, 'Engineer') THEN 'a "b", c' END AS label,
  CASE WHEN contains(raw, 'Engineer') THEN 'mapped' ELSE 'unknown' END AS rest FROM t UNION ALL SELECT 'alias', NULL, lower(raw), 'u:' || length(raw), 'L, ' || raw, 'en|taxonomy' FROM t WHERE contains(raw, 'Engineer')""")
def o06_o07_skill_files(spark, sf_dir):
    """Skills written as lines, aligned skills and aliases as CSV with quotes and commas, and all read back."""
    at = f"{shared_folder(spark)}/skills-{uuid.uuid4().hex}"
    skills = jobs(spark, sf_dir).select("title").distinct()
    skills.unionByName(spark.range(3).select(F.lit("  ").alias("title"))).write.text(f"{at}/raw")
    raw = files.scan_skills(spark, f"{at}/raw").distinct()
    known, uri = F.col("raw").contains("Engineer"), F.concat(F.lit("u:"), F.length("raw").cast("string"))
    files.write_aligned(raw.select("raw", F.lower("raw").alias("alias"), F.when(known, uri).alias("uri"), F.when(known, 'a "b", c').alias("label"), F.when(known, "mapped").otherwise("unknown").alias("status")), f"{at}/aligned")
    files.write_aliases(raw.where(known).select(F.lower("raw").alias("alias"), uri.alias("uri"), F.concat(F.lit("L, "), "raw").alias("label")), f"{at}/aliases")
    read = lambda name: spark.read.csv(f"{at}/{name}", header=True, escape="\\")
    aligned = read("aligned").select(F.lit("aligned").alias("kind"), F.col("raw_skill").alias("raw"), F.col("normalized_skill").alias("alias"), F.col("canonical_uri").alias("uri"), F.col("canonical_label").alias("label"), F.col("status").alias("rest"))
    aliases = read("aliases").select(F.lit("alias").alias("kind"), F.lit(None).cast("string").alias("raw"), "alias", F.col("canonical_uri").alias("uri"), F.col("canonical_label").alias("label"), F.concat_ws("|", "language", "source").alias("rest"))
    return aligned.unionByName(aliases)

