"""Queries of the library's own operators over the given tables, and their SQL, by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelens.functions import html as H
from hirelens.functions import normalize as N
from hirelens.functions import vocabulary as V
from hirelens.operators import embeddings as E
from hirelens.operators import matching as M
from hirelens.operators import records as R
from hirelens.operators import snapshot as S
from hirelens.sources.fixtures import JOBS_SQL, jobs, shared_folder, table
from hirelens.streaming import jobs as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
J = f"j AS ({JOBS_SQL})"
#: The state holds what was posted before this date; the snapshot is taken then.
SYNC = "1997-01-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def marked_sql(c: str, markers: dict, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({c}, {m!r})' for m in ms)} THEN '{v}'" for v, ms in markers.items()) + f" ELSE {otherwise} END"


DOMAIN_SQL = lambda c: marked_sql(f"lower({c})", V.DOMAIN_MARKERS, "'unknown'")
SENIORITY_SQL = lambda t, y: marked_sql(f"lower({t})", V.SENIORITY_MARKERS, f"CASE WHEN {y} <= 1 THEN 'junior' WHEN {y} >= 8 THEN 'senior' ELSE 'mid' END")

LAST = f"""{J}, l AS (SELECT *, row_number() OVER (PARTITION BY source_id, external_job_id ORDER BY job_id DESC) AS rn,
  min(job_id) OVER (PARTITION BY source_id, external_job_id) AS first_seq FROM j)"""


@query(f"WITH {LAST} SELECT source_id, external_job_id, job_id, title, first_seq FROM l WHERE rn = 1")
def o77_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).select("source_id", "external_job_id", "job_id", "title", F.col("job_id").alias("seq"))
    return S.last_wins(rows).select("source_id", "external_job_id", "job_id", "title", "first_seq")


def _state(spark, sf_dir):
    """(stored state, landed snapshot rows): posted before SYNC; what is still open then, but for every seventh posting,
    and later postings."""
    j = jobs(spark, sf_dir)
    old = S.last_wins(j.where(F.col("last_seen_at") < SYNC).withColumn("seq", F.col("job_id")))
    old = old.select("source_id", "external_job_id", F.col("job_id").cast("string").alias("id"), "status", "last_seen_at", F.col("last_seen_at").alias("created_at"), F.col("last_seen_at").alias("updated_at"), "title")
    landed = j.where((F.col("status") == "open") & (F.col("job_id") % 7 != 0)).select("source_id", "external_job_id", "title", F.col("job_id").alias("seq"))
    return old, landed


def _reconciled(spark, sf_dir):
    old, landed = _state(spark, sf_dir)
    return landed, S.reconcile(old, S.last_wins(landed), F.lit(SYNC).cast("timestamp"), ["title"])


RECONCILED = f"""{J},
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, external_job_id ORDER BY job_id DESC) AS rn FROM j WHERE last_seen_at < TIMESTAMP '{SYNC}') x WHERE rn = 1),
  n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, external_job_id ORDER BY job_id DESC) AS rn FROM j WHERE status = 'open' AND job_id % 7 <> 0) x WHERE rn = 1),
  s AS (SELECT DISTINCT source_id FROM n),
  r AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.external_job_id, n.external_job_id) AS external_job_id,
    CASE WHEN n.job_id IS NOT NULL AND o.job_id IS NULL THEN 'insert' WHEN n.job_id IS NOT NULL THEN 'update'
      WHEN o.status = 'open' AND coalesce(o.source_id, n.source_id) IN (SELECT source_id FROM s) THEN 'close' ELSE 'keep' END AS action,
    o.status AS old_status, o.job_id AS old_id, o.last_seen_at AS old_seen, coalesce(n.title, o.title) AS title
    FROM o FULL JOIN n ON o.source_id = n.source_id AND o.external_job_id = n.external_job_id)"""


@query(f"""WITH {RECONCILED} SELECT source_id, external_job_id, title, action, CASE action WHEN 'keep' THEN old_status WHEN 'close' THEN 'closed' ELSE 'open' END AS status,
  coalesce(CAST(old_id AS VARCHAR), sha256(source_id || '|' || external_job_id)) AS id, CASE WHEN action IN ('insert', 'update') THEN TIMESTAMP '{SYNC}' ELSE old_seen END AS last_seen_at,
  CASE WHEN action = 'insert' THEN TIMESTAMP '{SYNC}' ELSE old_seen END AS created_at, CASE WHEN action = 'keep' THEN old_seen ELSE TIMESTAMP '{SYNC}' END AS updated_at FROM r""")
def o85_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir)[1].select("source_id", "external_job_id", "title", "action", "status", "id", "last_seen_at", "created_at", "updated_at")


@query(f"""WITH {RECONCILED}, f AS (SELECT source_id, count(*) AS fetched, count(DISTINCT external_job_id) AS unique_rows FROM j WHERE status = 'open' AND job_id % 7 <> 0 GROUP BY 1),
  g AS (SELECT f.source_id, fetched, fetched AS mapped, unique_rows, fetched - unique_rows AS deduped, count(*) FILTER (WHERE action = 'insert') AS inserted,
    count(*) FILTER (WHERE action = 'update') AS updated, count(*) FILTER (WHERE action = 'close') AS closed, CASE WHEN f.source_id = 'src3' THEN fetched ELSE 0 END AS failed
  FROM f JOIN r USING (source_id) GROUP BY 1, 2, 3, 4, 5)
  SELECT source_id, sum(fetched)::BIGINT AS fetched, sum(mapped)::BIGINT AS mapped, sum(unique_rows)::BIGINT AS unique_rows, sum(deduped)::BIGINT AS deduped, sum(inserted)::BIGINT AS inserted,
    sum(updated)::BIGINT AS updated, sum(closed)::BIGINT AS closed, sum(failed)::BIGINT AS failed FROM g GROUP BY ROLLUP (source_id)""")
def o70_snapshot_stats(spark, sf_dir):
    return S.snapshot_stats(*_reconciled(spark, sf_dir), spark.sql("SELECT 'src3' AS source_id"))


@query("SELECT user_id, max(struct_pack(ts := ts, event_id := event_id)).event_id AS event_id FROM events GROUP BY 1")
def o77b_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return S.latest(rows, "user_id", "at").select("user_id", "event_id")


@query("SELECT event_id, user_id FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 100")
def o77c_keyset_page(spark, sf_dir):
    return S.keyset_page(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 1000, 100)


@query("""SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders) x
  JOIN (SELECT c_custkey, CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) % 10 AS total FROM customer) c ON o_custkey = c_custkey WHERE place <= total""")
def o02_stitched_pages(spark, sf_dir):
    totals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.floor(F.greatest("c_acctbal", F.lit(0.0))) % 10).alias("total"))
    return S.stitched_pages(table(spark, sf_dir, "orders").join(totals, "o_custkey"), "o_custkey", ["o_orderdate", "o_orderkey"], "total").select("o_custkey", "o_orderkey", "place")


@query("""SELECT o_orderkey, n_lines, n_lines IS NULL AS detail_failed FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) d ON o_orderkey = l_orderkey""")
def o03_merge_details(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return S.merge_details(table(spark, sf_dir, "orders").select("o_orderkey"), d, "o_orderkey", "flag")


@query("SELECT sha256(text) AS sha256, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY 1")
def o09_offload(spark, sf_dir):
    rows, store = R.offload(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "html")
    return rows.join(store.select("sha256"), "sha256").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def o10_rehydrate(spark, sf_dir):
    rows, store = R.offload(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "html")
    return R.rehydrate(rows, store).select("doc_id", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("n"))


@query(f"WITH {J} SELECT job_id, {SENIORITY_SQL('title', 'jd_experience_years')} AS seniority, {DOMAIN_SQL('title')} AS domain FROM j")
def o35_o39_domain_seniority(spark, sf_dir):
    return N.with_domain(jobs(spark, sf_dir), "title", "domain").select("job_id", N.seniority(F.col("title"), F.col("jd_experience_years")).alias("seniority"), "domain")


_deny, _offer = (" OR ".join(f"contains(lower(description_plain), '{m}')" for m in ms) for ms in (V.SPONSORSHIP_DENIED, V.SPONSORSHIP_OFFERED))


@query(f"WITH {J} SELECT job_id, CASE WHEN {_deny} THEN 'yes' WHEN {_offer} THEN 'no' ELSE 'unknown' END AS sponsorship FROM j")
def o34_sponsorship(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", N.sponsorship(F.col("description_plain")).alias("sponsorship"))


@query(f"WITH {J}, g AS (SELECT job_id, {marked_sql('lower(description_plain)', V.DEGREE_MARKERS, chr(39) + 'unknown' + chr(39))} AS level FROM j) SELECT job_id, level, CASE level WHEN 'none' THEN 0 WHEN 'associate' THEN 1 WHEN 'bachelor' THEN 2 WHEN 'master' THEN 3 WHEN 'doctorate' THEN 4 ELSE -1 END AS degree_rank FROM g")
def o36_degree(spark, sf_dir):
    level = N.degree_level(F.col("description_plain"))
    return jobs(spark, sf_dir).select("job_id", level.alias("level"), N.degree_rank(level).alias("degree_rank"))


@query(f"WITH {J} SELECT job_id, CAST(regexp_extract(description_plain, 'Needs ([0-9]+)', 1) AS INTEGER) AS years, string_split(description_plain, chr(10))[2] AS line FROM j")
def o37_experience(spark, sf_dir):
    found = N.experience(F.col("description_plain"))
    return jobs(spark, sf_dir).select("job_id", found["years"].alias("years"), F.get(found["lines"], F.lit(0)).alias("line"))


# label by p_size, and what it becomes
EMPLOYMENT = {
    "Full-Time": "full-time", "regular": "full-time", "Full_time / part-time": "mixed", "Temp role": "temporary", "Summer Intern": "intern", "Per diem": "per-diem", "contractor": "contract",
    "Fixed-term": "temporary", "Part time (evenings)": "part-time", "Apprenticeship": "apprenticeship", "Volunteer!": "volunteer", "third_party": "contract", "Template maker": "other", " ": None,
}


@query(f"""SELECT p_partkey, CASE p_size % {len(EMPLOYMENT)} {' '.join(f"WHEN {i} THEN {'NULL' if x is None else repr(x)}" for i, x in enumerate(EMPLOYMENT.values()))} END AS employment,
  trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS token, trim(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM part""")
def o23_o29_o30_labels(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, EMPLOYMENT)), F.col("p_size") % len(EMPLOYMENT) + 1)
    return table(spark, sf_dir, "part").select("p_partkey", N.employment_type(label).alias("employment"), N.skill_token(F.col("p_type")).alias("token"), N.slug(F.col("p_brand")).alias("slug"))


@query("""SELECT c_custkey, regexp_replace(lower(r_name || '-' || n_name || '-' || c_mktsegment), '[^a-z0-9]+', '-', 'g') AS key, c_mktsegment || ', ' || n_name || ', ' || r_name AS display
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def o30_location_key(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    all_ = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return all_.select("c_custkey", N.location_key(F.col("r_name"), F.col("n_name"), F.col("c_mktsegment")).alias("key"), N.display_name(F.col("c_mktsegment"), F.col("n_name"), F.col("r_name")).alias("display"))


@query("SELECT o_orderkey, o_orderdate AS at, o_orderdate AS at_ms FROM orders")
def o24_timestamps(spark, sf_dir):
    at = F.unix_timestamp("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.flexible_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"), F.when(at > 100_000_000, N.flexible_timestamp(at * 1000)).otherwise(N.flexible_timestamp(at)).alias("at_ms"))


@query(f"WITH {J} SELECT job_id, 'cfp:v1:' || sha256('{{\"description_plain\":\"' || trim(regexp_replace(description_plain, '\\s+', ' ', 'g')) || '\",\"title\":\"' || title || '\"}}') AS fingerprint FROM j")
def o33_fingerprint(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", N.content_fingerprint(F.col("title"), F.col("description_plain")).alias("fingerprint"))


def _marked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.sha2("text", 256).alias("content_fingerprint"))
    held = table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("job_id"))
    held = held.select("job_id", F.when(F.col("label") % 2 == 0, F.col("content_fingerprint")).otherwise("other").alias("content_fingerprint"))
    return E.with_freshness(docs, held)


FRESH = """m AS (SELECT doc_id AS job_id, sha256(text) AS fp, CASE WHEN vec_id IS NULL THEN 'missing' WHEN label % 2 = 0 THEN 'fresh' ELSE 'stale' END AS state FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""


@query(f"WITH {FRESH} SELECT job_id, fp AS content_fingerprint, state FROM m")
def o59_freshness(spark, sf_dir):
    return _marked(spark, sf_dir)


@query(f"WITH {FRESH} SELECT count(*) FILTER (WHERE state = 'fresh') AS fresh, count(*) FILTER (WHERE state = 'stale') AS stale, count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE fp IS NULL) AS without_fingerprint FROM m")
def o67_freshness_counts(spark, sf_dir):
    return E.freshness_counts(_marked(spark, sf_dir))


@query("SELECT vec_id, vec_id % 5 NOT IN (1, 2, 3, 4) OR vec_id % 25 > 4 AS valid FROM embeddings")
def o89_valid_vectors(spark, sf_dir):
    """Some vectors are cut, have a hole, are no number or infinite, or are missing."""
    e, kind = table(spark, sf_dir, "embeddings"), F.when(F.col("vec_id") % 25 > 4, 0).otherwise(F.col("vec_id") % 5)
    tail = F.slice("embedding", 2, 63)
    put = lambda x: F.concat(F.array(F.lit(x).cast("float")), tail)
    broken = F.when(kind == 1, tail).when(kind == 2, put(None)).when(kind == 3, put(float("nan"))).when(kind == 4, F.when(F.col("vec_id") % 2 == 0, put(float("inf")))).otherwise(F.col("embedding"))
    return E.valid_vectors(e.withColumn("embedding", broken), "embedding", 64).select("vec_id", "valid")


@query("SELECT event_type AS route, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 4) AS avg_duration, max(value) AS max_duration FROM events GROUP BY ROLLUP (event_type)")
def o72_request_metrics(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), F.col("value").alias("duration"), (F.col("event_type") == "error").alias("failed"))
    return R.request_metrics(log)


@query("""WITH c AS (SELECT event_type AS route, CAST(200 + event_id % 7 * 50 AS VARCHAR) AS status, count(*) AS n FROM events WHERE event_id % 11 <> 0 GROUP BY 1, 2),
  b AS (SELECT * FROM c UNION ALL SELECT NULL, status, sum(n) FROM c GROUP BY 2) SELECT route, string_agg(status || ':' || CAST(CAST(n AS BIGINT) AS VARCHAR), ',' ORDER BY status) AS statuses FROM b GROUP BY 1""")
def o72_status_histogram(spark, sf_dir):
    status = F.when(F.col("event_id") % 11 != 0, (200 + F.col("event_id") % 7 * 50).cast("string"))
    made = R.status_histogram(table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), status.alias("status")))
    return made.select("route", F.array_join(F.transform(F.map_entries("statuses"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias("statuses"))


@query("SELECT event_type AS model, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS tokens FROM events GROUP BY ROLLUP (event_type)")
def o73_token_usage(spark, sf_dir):
    usage = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.lit(1).alias("calls"), F.col("event_id").alias("tokens"))
    return R.usage_totals(usage, "model", ["calls", "tokens"])


@query(f"WITH {J} SELECT source_id, count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'closed') AS closed FROM j GROUP BY 1")
def o71_coverage(spark, sf_dir):
    return R.coverage(jobs(spark, sf_dir), "source_id", "status", ["open", "closed"])


@query(f"""WITH {J} SELECT 'duplicate_owner_pairs' AS "check", count(*) AS n FROM (SELECT source_id, external_job_id FROM j GROUP BY 1, 2 HAVING count(*) > 1) x
  UNION ALL SELECT 'orphan_lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
  UNION ALL SELECT 'unmatched_owners', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)
  UNION ALL SELECT 'several_running', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) > 1) x
  UNION ALL SELECT 'several_primary', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING count(*) > 1) x
  UNION ALL SELECT 'blocked_deletes', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') x
  UNION ALL SELECT 'sponsorship_domain', count(*) FROM j WHERE sponsorship_not_available NOT IN ('yes', 'no')""")
def o74_violations(spark, sf_dir):
    j, orders = jobs(spark, sf_dir), table(spark, sf_dir, "orders")
    return R.violations({
        "duplicate_owner_pairs": R.duplicates(j, ["source_id", "external_job_id"]),
        "orphan_lines": R.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", orders.where("o_orderstatus <> 'P'"), "o_orderkey"),
        "unmatched_owners": R.orphans(orders, "o_custkey", table(spark, sf_dir, "customer").where("c_nationkey < 20"), "c_custkey"),
        "several_running": R.duplicates(table(spark, sf_dir, "events").where("event_type = 'view'"), ["user_id"]),
        "several_primary": R.duplicates(table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'"), ["l_orderkey"]),
        "blocked_deletes": orders.where("o_orderstatus = 'O'").select("o_custkey").distinct(),
        "sponsorship_domain": R.outside(j, "sponsorship_not_available", ["yes", "no"]),
    })


@query("""SELECT o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR), ',' ORDER BY -l_quantity, l_linenumber, l_suppkey), '') AS lines
  FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag <> 'N') l ON o_orderkey = l_orderkey GROUP BY 1""")
def o64_nested(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").withColumnRenamed("l_orderkey", "o_orderkey")
    made = R.nested(lines, "o_orderkey", ["-l_quantity", "l_linenumber", "l_suppkey"], ["l_linenumber", "l_suppkey"], "s", table(spark, sf_dir, "orders").select("o_orderkey"))
    return made.select("o_orderkey", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_suppkey"].cast("string"))), ",").alias("lines"))


@query("SELECT c_custkey AS key, 'held' AS origin FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY 1")
def o86_insert_absent(spark, sf_dir):
    held = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.lit("held").alias("origin"))
    return R.insert_absent(held, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit("new").alias("origin")), "key")


@query("""SELECT p_partkey, raw, uri, CASE WHEN uri IS NULL THEN 'unknown' ELSE 'mapped' END AS status FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('Rare ', p_name) ELSE p_name END AS raw FROM part) LEFT JOIN (
  SELECT alias, arg_min(uri, seq) AS uri FROM (
    SELECT p_partkey AS seq, p_brand AS uri, trim(lower(p_type)) AS alias FROM part
    UNION ALL SELECT p_partkey, p_brand, lower(p_name) FROM part WHERE p_size < 25) x GROUP BY 1) a ON lower(raw) = a.alias""")
def o65_align_skills(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    taxonomy = p.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("uri"), F.col("p_type").alias("label"), F.when(F.col("p_size") < 25, F.col("p_name")).alias("alt_labels"))
    return R.align_skills(p.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Rare "), "p_name")).otherwise(F.col("p_name")).alias("raw")), R.taxonomy_aliases(taxonomy)).select("p_partkey", "raw", "uri", "status")


@query("""SELECT o_orderkey AS id, 'missing' AS problem FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
  UNION ALL SELECT l_orderkey, 'duplicate' FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def o84_reconcile_output(spark, sf_dir):
    return R.reconcile_output(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query(f"""WITH {J}, v AS (SELECT o_custkey, job_id AS ordinal, 3 AS weight, {DOMAIN_SQL('title')} AS domain FROM j
    UNION ALL SELECT c_custkey, 0, 2, {DOMAIN_SQL('c_mktsegment')} FROM customer),
  k AS (SELECT o_custkey, domain, sum(weight) AS w, min(ordinal) AS f FROM v WHERE domain <> 'unknown' GROUP BY 1, 2),
  b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, f) AS rn FROM k)
  SELECT DISTINCT v.o_custkey, coalesce(b.domain, 'unknown') AS domain FROM v LEFT JOIN b ON v.o_custkey = b.o_custkey AND rn = 1""")
def o75_domain_vote(spark, sf_dir):
    titles = jobs(spark, sf_dir).select("o_custkey", F.col("job_id").alias("ordinal"), F.lit(3).alias("weight"), "title")
    summary = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(0).cast("long").alias("ordinal"), F.lit(2).alias("weight"), F.col("c_mktsegment").alias("title"))
    return M.domain_vote(N.with_domain(titles.unionByName(summary), "title", "domain"), "o_custkey")


def _candidates(spark, sf_dir):
    """The stated query set: vectors whose id is divisible by 50, with features that differ between them."""
    c = F.floor(F.col("vec_id") / 50)
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("candidate_id"), "embedding", (c % 3 == 0).alias("needs_sponsorship"), (c % 6 - 1).cast("int").alias("user_degree_rank"), (c % 13 + 2).cast("int").alias("user_years"),
        F.split(F.element_at(F.array(*map(F.lit, SKILL_SETS)), (c % len(SKILL_SETS) + 1).cast("int")), "[|]").alias("user_skills"),
        F.element_at(F.array(*map(F.lit, DOMAINS)), (c % len(DOMAINS) + 1).cast("int")).alias("user_domain"), F.element_at(F.array(*map(F.lit, LEVELS)), (c % len(LEVELS) + 1).cast("int")).alias("user_seniority"),
    )


SKILL_SETS, DOMAINS, LEVELS = ("python|sql|tableau", "sql|c 1", "go"), ("data_ai", "software_engineering", "unknown", "finance_treasury"), ("mid", "senior", "junior", "lead", "director")
WANTED, PREFERRED = ("Python|SQL", "Go", "C_1|R&D", ""), ("Tableau", "", "SQL|Go")


def _match_jobs(spark, sf_dir, *more, **options):
    rows = N.with_domain(jobs(spark, sf_dir), "title", "job_domain", **options)
    pick = lambda values: F.element_at(F.array(*(F.array(*(F.lit(x) for x in v.split("|") if x)).cast("array<string>") for v in values)), (F.col("job_id") % len(values) + 1).cast("int"))
    return rows.select(
        "job_id", "title", "sponsorship_not_available", "min_degree_rank", "jd_experience_years", "job_domain", pick(WANTED).alias("required_skills"), pick(PREFERRED).alias("preferred_skills"),
        F.when(F.col("job_id") % 11 != 0, 3).alias("structured_jd_version"), F.when(F.col("job_id") % 5 == 1, "senior").alias("seniority_level"), *more,
    )


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("job_id"), "embedding")


def _recall(spark, sf_dir):
    return M.top_k(_candidates(spark, sf_dir).select("candidate_id", "embedding"), _vectors(spark, sf_dir))


def _pairs(spark, sf_dir):
    own = _candidates(spark, sf_dir).drop("embedding")
    return _recall(spark, sf_dir).join(_match_jobs(spark, sf_dir), "job_id").join(own, "candidate_id")


def _pick_sql(values, at):
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values)) + " END"


_cos = "round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6)"
TOPK = f"k AS (SELECT * FROM (SELECT c.vec_id AS candidate_id, e.vec_id AS job_id, {_cos} AS cosine_score, row_number() OVER (PARTITION BY c.vec_id ORDER BY {_cos} DESC, e.vec_id) AS rank FROM embeddings c, embeddings e WHERE c.vec_id % 50 = 0) x WHERE rank <= 200)"
CANDIDATES = f"""cd AS (SELECT vec_id AS candidate_id, embedding, c % 3 = 0 AS needs, c % 6 - 1 AS user_degree_rank, c % 13 + 2 AS user_years, string_split({_pick_sql(SKILL_SETS, f"c % {len(SKILL_SETS)}")}, '|') AS user_skills,
  {_pick_sql(DOMAINS, f"c % {len(DOMAINS)}")} AS user_domain, {_pick_sql(LEVELS, f"c % {len(LEVELS)}")} AS user_seniority FROM (SELECT *, vec_id // 50 AS c FROM embeddings WHERE vec_id % 50 = 0))"""
MATCH_JOBS = f"""{J}, mj AS (SELECT job_id, title, sponsorship_not_available, min_degree_rank, jd_experience_years, {DOMAIN_SQL('title')} AS title_domain,
  list_filter(string_split({_pick_sql(WANTED, f"job_id % {len(WANTED)}")}, '|'), lambda x: x <> '') AS required_skills, list_filter(string_split({_pick_sql(PREFERRED, f"job_id % {len(PREFERRED)}")}, '|'), lambda x: x <> '') AS preferred_skills,
  CASE WHEN job_id % 11 <> 0 THEN 3 END AS version, CASE WHEN job_id % 5 = 1 THEN 'senior' ELSE {SENIORITY_SQL('title', 'jd_experience_years')} END AS level FROM j)"""
PAIRS = f"{TOPK}, {CANDIDATES}, {MATCH_JOBS}, p AS (SELECT k.*, mj.* EXCLUDE (job_id), cd.* EXCLUDE (candidate_id, embedding) FROM k JOIN mj USING (job_id) JOIN cd USING (candidate_id))"
#: The given vectors are random, so the usual threshold would leave few pairs.
MINIMUM = 0.1


@query(f"WITH {TOPK} SELECT candidate_id, job_id, cosine_score FROM k")
def o68_vector_top_k(spark, sf_dir):
    return _recall(spark, sf_dir).select("candidate_id", "job_id", "cosine_score")


@query(f"""WITH {PAIRS}, m AS (SELECT candidate_id, needs AND sponsorship_not_available = 'yes' AS a, min_degree_rank >= 0 AND user_degree_rank >= 0 AND min_degree_rank > user_degree_rank AS b, jd_experience_years > user_years + 1 AS c FROM p)
  SELECT candidate_id, count(*) AS input_count, count(*) FILTER (WHERE NOT (a OR b OR c)) AS passed_count, count(*) FILTER (WHERE a OR b OR c) AS rejected_count,
    count(*) FILTER (WHERE a) AS rejected_sponsorship, count(*) FILTER (WHERE b) AS rejected_degree, count(*) FILTER (WHERE c) AS rejected_experience FROM m GROUP BY 1""")
def o54_o66_hard_filter(spark, sf_dir):
    return M.stage_summary(M.reject_reasons(_pairs(spark, sf_dir)), "candidate_id")


_near = " OR ".join(f"(user_domain = '{a}' AND title_domain IN ({', '.join(repr(x) for x in b)})) OR (title_domain = '{a}' AND user_domain IN ({', '.join(repr(x) for x in b)}))" for a, b in V.DOMAIN_NEIGHBOURS.items())
_rank = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.SENIORITY_RANK.items()) + " END"
_tokens = lambda c: f"list_transform({c}, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')))"
_share = lambda c: f"(len(list_intersect({_tokens(c)}, user_skills))::DOUBLE / len({c}))"
ELIGIBLE = f"""{CANDIDATES}, {MATCH_JOBS}, rk AS (SELECT * FROM (SELECT candidate_id, e.vec_id AS job_id, {_cos} AS cosine_score, row_number() OVER (PARTITION BY candidate_id ORDER BY {_cos} DESC, e.vec_id) AS rank
    FROM cd c, embeddings e JOIN mj ON e.vec_id = mj.job_id WHERE version >= 3 AND (NOT needs OR sponsorship_not_available <> 'yes') AND (user_degree_rank < 0 OR min_degree_rank <= user_degree_rank)) x WHERE rank <= 200)"""


@query(f"WITH {ELIGIBLE} SELECT candidate_id, job_id, cosine_score, rank FROM rk")
def o51_o52_o58_recall(spark, sf_dir):
    return M.recall(_candidates(spark, sf_dir), _match_jobs(spark, sf_dir), _vectors(spark, sf_dir))


@query(f"""WITH {ELIGIBLE}, p AS (SELECT rk.*, mj.* EXCLUDE (job_id), cd.* EXCLUDE (candidate_id, embedding) FROM rk JOIN mj USING (job_id) JOIN cd USING (candidate_id) WHERE cosine_score >= {MINIMUM} AND NOT jd_experience_years > user_years + 1),
  f AS (SELECT *, abs({_rank("user_seniority")} - ({_rank("level")})) AS d, greatest(0, jd_experience_years - user_years) AS gap, greatest(0, min_degree_rank - user_degree_rank) AS edu,
    CASE WHEN len(required_skills) + len(preferred_skills) = 0 THEN 0.0::DOUBLE WHEN len(preferred_skills) = 0 THEN 0.7::DOUBLE * {_share("required_skills")} / 0.7::DOUBLE WHEN len(required_skills) = 0 THEN 0.3::DOUBLE * {_share("preferred_skills")} / 0.3::DOUBLE
      ELSE (0.7::DOUBLE * {_share("required_skills")} + 0.3::DOUBLE * {_share("preferred_skills")}) / (0.7::DOUBLE + 0.3::DOUBLE) END AS skill,
    CASE WHEN title_domain = 'unknown' OR user_domain = 'unknown' THEN 0.0::DOUBLE WHEN user_domain = title_domain THEN 1.0::DOUBLE WHEN {_near} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS domain FROM p),
  s AS (SELECT candidate_id, job_id, rank, skill, gap, edu, round_even(0.7::DOUBLE * cosine_score + 0.15::DOUBLE * skill + 0.1::DOUBLE * domain
    + 0.05::DOUBLE * CASE d WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END - least(0.12::DOUBLE, gap * 0.04::DOUBLE) - least(0.08::DOUBLE, edu * 0.08::DOUBLE), 8) AS final_score FROM f)
  SELECT candidate_id, job_id, final_score, round(skill, 6) AS skill_overlap_score, gap AS experience_gap, edu AS education_gap FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY final_score DESC, rank) AS place FROM s) x WHERE place <= 50""")
def o96_match_pipeline(spark, sf_dir):
    # a cosine of six digits makes scores of seven, so eight leave no halves that engines round apart
    found = M.match(_candidates(spark, sf_dir), _match_jobs(spark, sf_dir), _vectors(spark, sf_dir), MINIMUM, digits=8)
    return found.select("candidate_id", "job_id", "final_score", F.round("skill_overlap_score", 6).alias("skill_overlap_score"), "experience_gap", "education_gap")


@query("SELECT CAST(ts AS DATE)::TIMESTAMP AS window_start, event_type AS route, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) AS max_duration FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 HOUR AS DATE) FROM events) GROUP BY 1, 2")
def o80_streaming_metrics(spark, sf_dir):
    at = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    log = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("route"), F.col("value").alias("duration"), (F.col("event_type") == "error").alias("failed"))
    out = stream.windowed_metrics(log)
    stream.run_once(out, f"{at}/out", f"{at}/log")
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query(f"SELECT page_id, {H.html_text_sql('html')} AS plain FROM pages")
def o27_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.html_text(F.col("html")).alias("plain"))


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 AND trim(coalesce(html, '')) <> '' THEN {H.html_text_sql('html')} WHEN page_id % 2 = 1 THEN url ELSE '' END AS plain FROM pages")
def o28_hydrate(spark, sf_dir):
    plain = F.when(F.col("page_id") % 2 == 1, F.col("url")).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", H.hydrated(plain, F.col("html")).alias("plain"))


@query(f"WITH {PAIRS} SELECT candidate_id, count(*) AS n_input, count(*) FILTER (WHERE cosine_score >= 0.2) AS n_passed, count(*) FILTER (WHERE cosine_score < 0.2) AS n_rejected FROM p GROUP BY 1")
def o53_threshold(spark, sf_dir):
    return M.cosine_threshold(_pairs(spark, sf_dir), 0.2)[1]


@query(f"""WITH {J}, v AS (SELECT job_id, description_plain, CASE WHEN job_id % 5 <> 0 THEN job_id % 4 END AS version FROM j)
  SELECT job_id FROM v WHERE description_plain IS NOT NULL AND (job_id % 7 = 0 OR version < 3) AND job_id NOT IN (SELECT doc_id FROM labels)""")
def o55_pending(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumns({"structured_version": F.when(F.col("job_id") % 5 != 0, F.col("job_id") % 4), "description_html_key": F.lit(None).cast("string"), "structured_jd": F.when(F.col("job_id") % 7 != 0, "{}")})
    return R.pending_parse(rows, 3, exclude=table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"))).select("job_id")


@query(f"""WITH m AS ({ORACLES["o96_match_pipeline"]}), r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY final_score DESC, job_id) AS rank FROM m),
  a AS (SELECT r.*, CASE WHEN rank <= 20 THEN CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'stretch' END END AS label FROM r LEFT JOIN labels ON doc_id = job_id),
  s AS (SELECT *, round(final_score + CASE label WHEN 'yes' THEN 0.015::DOUBLE WHEN 'stretch' THEN -0.015::DOUBLE ELSE 0.0::DOUBLE END, 8) AS adjusted_score FROM a),
  t AS (SELECT candidate_id, job_id, label, adjusted_score, rank, row_number() OVER (PARTITION BY candidate_id ORDER BY rank > 20, CASE WHEN rank <= 20 THEN -adjusted_score END, CASE WHEN rank <= 20 THEN -final_score END, rank) AS place FROM s)
  SELECT * EXCLUDE (rank), bool_or(place <> rank) OVER (PARTITION BY candidate_id) AS reorder_applied FROM t""")
def o76_label_rerank(spark, sf_dir):
    ranked = QUERIES["o96_match_pipeline"](spark, sf_dir)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("final_score"), "job_id")))
    said = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"), F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "stretch").alias("label"))
    labels = ranked.select("candidate_id", "job_id").join(said, "job_id")
    return M.label_rerank(ranked, labels, 20, digits=8).select("candidate_id", "job_id", "label", "adjusted_score", "place", "reorder_applied")
