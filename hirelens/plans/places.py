"""Queries over places: nations as countries, customers as cities, orders as place texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions import vocabulary as V
from hirelens.operators import locations as L
from hirelens.plans.registry import query
from hirelens.sources.fixtures import JOBS_SQL, jobs, table

DIMS_SQL = """co AS (SELECT concat('Q', chr(65 + n_nationkey)) AS code, concat('LN', chr(65 + n_nationkey)) AS iso3, concat('F', chr(65 + n_nationkey % 20)) AS fips, concat('Land ', chr(65 + n_nationkey)) AS name FROM nation),
ci AS (SELECT c_custkey AS geonames_id, concat('City ', CAST(c_custkey % 400 AS VARCHAR(10))) AS name, concat('Q', chr(65 + c_nationkey)) AS country_code, concat('A', CAST(c_custkey % 3 AS VARCHAR(10))) AS admin1_code,
  CAST(floor(greatest(c_acctbal, 0) * 100) AS BIGINT) AS population FROM customer)"""
DIMS = f"WITH {DIMS_SQL}"


def dims(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(countries, cities, admin1). Two-letter starts of names clash, as codes of several lists do."""
    sql = "WITH " + DIMS_SQL.replace("FROM nation", "FROM {n}").replace("FROM customer", "FROM {c}")
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    countries = spark.sql(sql + " SELECT * FROM co", n=n, c=c)
    cities = spark.sql(sql + " SELECT *, name AS ascii FROM ci", n=n, c=c)
    admin1 = cities.select("country_code", F.col("admin1_code").alias("code")).distinct().select("country_code", "code", F.concat(F.lit("Région "), "code").alias("name"), F.concat(F.lit("Region "), "code").alias("ascii"))
    return countries, cities, admin1


_TEXTS = """SELECT DISTINCT CASE o_orderkey % 8 WHEN 0 THEN concat('Land ', chr(65 + n_nationkey)) WHEN 1 THEN concat(' ', lower(concat('Land ', chr(65 + n_nationkey)))) WHEN 2 THEN concat('F', chr(65 + n_nationkey % 20)) WHEN 3 THEN concat('LN', chr(65 + n_nationkey)) WHEN 4 THEN 'Remote' WHEN 5 THEN concat(concat('Land ', chr(65 + n_nationkey)), ' / Land A')
  WHEN 6 THEN concat('U', '.K.') ELSE concat('Nowhere ', n_name) END AS text, o_orderkey % 8 AS k, CASE WHEN o_orderkey % 8 = 5 THEN concat('Land ', chr(65 + n_nationkey)) END AS place, o_custkey % 2 = 0 AS explicit FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""
_amb = ", ".join(f"'{x}'" for x in V.AMBIGUOUS_ALPHA2)


def _countries_sql(fips: str) -> str:
    return f"""{DIMS}, t AS ({_TEXTS.format(orders="orders", customer="customer", nation="nation")}),
  terms AS (SELECT DISTINCT code, lower(unnest([code, iso3, {fips} name, replace(name, ' ', '')])) AS term FROM co),
  f AS (SELECT t.*, (SELECT list(DISTINCT code ORDER BY code) FROM terms WHERE term = trim(lower(t.text)) OR term = replace(trim(lower(t.text)), ' ', '')) AS codes,
    CASE WHEN k = 5 THEN (SELECT list(DISTINCT code ORDER BY code) FROM co WHERE name IN (place, 'Land A')) END AS pair FROM t)
  SELECT DISTINCT text, explicit, CASE WHEN k = 4 OR (NOT explicit AND upper(text) IN ({_amb})) THEN NULL WHEN k = 6 THEN 'GB' WHEN k = 5 THEN CASE WHEN explicit AND len(pair) = 1 THEN pair[1] END WHEN len(codes) = 1 THEN codes[1] END AS country_code,
    CASE WHEN k = 4 OR (NOT explicit AND upper(text) IN ({_amb})) THEN true WHEN k = 5 THEN explicit AND len(pair) > 1 WHEN k = 6 THEN false ELSE coalesce(len(codes), 0) > 1 END AS is_ambiguous FROM f"""


@query(_countries_sql("fips,"))
def o62_countries(spark, sf_dir, use_fips=True):
    texts = spark.sql(_TEXTS, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
    return L.resolve_countries(texts, dims(spark, sf_dir)[0], use_fips).select("text", "explicit", "country_code", "is_ambiguous")


@query(_countries_sql(""))
def o62_countries_without_fips(spark, sf_dir):
    return o62_countries(spark, sf_dir, use_fips=False)


@query(f"{DIMS} SELECT c_custkey, v IN (SELECT lower(code) FROM co) AS valid FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'q' || chr(97 + c_nationkey) WHEN 1 THEN 'qz' WHEN 2 THEN 'qaa' ELSE '' END AS v FROM customer)")
def o62b_valid_codes(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    code = F.when(k == 0, F.concat(F.lit(" q"), F.char(F.col("c_nationkey") + 97))).when(k == 1, "QZ").when(k == 2, "qaa").otherwise("")
    return L.with_valid_country(c.withColumn("v", code), "v", dims(spark, sf_dir)[0]).select("c_custkey", F.col("valid_country").alias("valid"))


_ASKED = """SELECT DISTINCT concat('City ', CAST(o_orderkey % 450 AS VARCHAR(10))) AS city, CASE WHEN o_orderkey % 2 = 0 THEN concat('a', CAST(o_custkey % 3 AS VARCHAR(10))) END AS region,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('q', lower(chr(CAST(65 + o_custkey % 25 AS INTEGER)))) END AS country_code FROM {orders}"""


@query(f"""{DIMS}, a AS ({_ASKED.format(orders="orders")}), m AS (SELECT a.*, geonames_id, ci.country_code AS cc, admin1_code, population FROM a JOIN ci ON a.city = ci.name AND (a.country_code IS NULL OR upper(a.country_code) = ci.country_code)
    AND (a.region IS NULL OR upper(a.region) = admin1_code)),
  g AS (SELECT city, region, country_code, count(*) AS n, count(DISTINCT cc) AS countries, list({{'p': population, 'i': -geonames_id, 'c': cc}} ORDER BY population DESC, geonames_id) AS x FROM m GROUP BY 1, 2, 3)
  SELECT city, region, country_code, -x[1].i AS geonames_id, x[1].c AS found_country FROM g WHERE n = 1 OR (countries = 1 AND (region IS NOT NULL OR country_code IS NOT NULL OR x[1].p >= greatest(200000, 8 * x[2].p)))""")
def o63_cities(spark, sf_dir):
    _, cities, admin1 = dims(spark, sf_dir)
    asked = spark.sql(_ASKED, orders=table(spark, sf_dir, "orders"))
    return L.resolve_cities(asked, cities, admin1).select("city", "region", "country_code", "geonames_id", "found_country")


_PLACES = """SELECT DISTINCT o_orderkey % 6 AS k, concat('Land ', chr(65 + n_nationkey)) AS place, o_custkey % 400 AS c, CASE o_orderkey % 6 WHEN 0 THEN concat(concat('Land ', chr(65 + n_nationkey)), ' - Remote') WHEN 1 THEN concat('Remote (', concat('Land ', chr(65 + n_nationkey)), ')') WHEN 2 THEN concat('City ', CAST(o_custkey % 400 AS VARCHAR(10)), ', ', concat('Land ', chr(65 + n_nationkey)))
  WHEN 3 THEN concat('Town, Shire, ', concat('Land ', chr(65 + n_nationkey))) WHEN 4 THEN concat('City ', CAST(o_custkey % 400 AS VARCHAR(10)), ', A', CAST(o_custkey % 3 AS VARCHAR(10))) ELSE concat('Land ', chr(65 + n_nationkey)) END AS location_text
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""


@query(f"""{DIMS}, t AS ({_PLACES.format(orders="orders", customer="customer", nation="nation")}),
  x AS (SELECT t.*, code, 'City ' || c AS city_name, split_part(location_text, ', ', 2) AS second FROM t JOIN co ON place = name),
  d AS (SELECT x.location_text, count(*) AS n, count(DISTINCT country_code) AS countries, arg_max(admin1_code, [population, -geonames_id]) AS a1, any_value(country_code) AS cc FROM x JOIN ci ON city_name = ci.name AND ((k = 2 AND country_code = code) OR (k = 4 AND admin1_code = second)) GROUP BY 1)
  SELECT DISTINCT x.location_text, CASE WHEN k = 2 THEN city_name WHEN k = 3 THEN 'Town' WHEN k = 4 AND countries = 1 THEN city_name END AS city, CASE WHEN k = 2 THEN a1 WHEN k = 3 THEN 'Shire' WHEN k = 4 AND countries = 1 THEN second END AS region,
    CASE WHEN k = 4 THEN CASE WHEN countries = 1 THEN cc END ELSE code END AS country_code, CASE WHEN k IN (0, 1) THEN 'remote' ELSE 'unknown' END AS workplace_type, CASE WHEN k IN (0, 1) THEN place END AS remote_scope FROM x LEFT JOIN d USING (location_text)""")
def o63b_parse(spark, sf_dir):
    texts = spark.sql(_PLACES, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
    return L.parse_locations(texts, *dims(spark, sf_dir))


LINKS_SQL = """lk AS (SELECT l_orderkey AS job_id, l_partkey % 40 AS location_id, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) = 1 AS is_primary, min(l_shipdate) AS created_at, min(l_shipmode) AS source_raw FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) z GROUP BY 1, 2),
lo AS (SELECT CAST(n AS INTEGER) AS id, concat('City ', CAST(n AS VARCHAR(10))) AS city, concat('R', CAST(n % 5 AS VARCHAR(10))) AS region, CASE WHEN n % 4 <> 0 THEN 'QA' END AS country_code, concat('Place ', CAST(n AS VARCHAR(10))) AS display_name FROM (SELECT DISTINCT l_partkey % 40 AS n FROM lineitem) y)"""


def links(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    sql, lines = "WITH " + LINKS_SQL.replace("FROM lineitem", "FROM {l}"), table(spark, sf_dir, "lineitem")
    return spark.sql(sql + " SELECT * FROM lk", l=lines), spark.sql(sql + " SELECT * FROM lo", l=lines)


@query(f"""WITH {LINKS_SQL}, p AS (SELECT job_id, max(CASE WHEN is_primary THEN location_id END) AS pl FROM lk GROUP BY 1)
  SELECT o_orderkey AS job_id, CASE WHEN p.job_id IS NULL THEN 'unlinked' WHEN pl IS NULL THEN 'no_primary' ELSE 'no_country' END AS problem FROM orders LEFT JOIN p ON o_orderkey = p.job_id LEFT JOIN lo ON pl = lo.id WHERE country_code IS NULL""")
def o60_without_location(spark, sf_dir):
    lk, lo = links(spark, sf_dir)
    return L.jobs_without_location(jobs(spark, sf_dir).select("job_id"), lk, lo)


@query(f"""WITH {LINKS_SQL}, h AS (SELECT * FROM lk WHERE job_id % 3 <> 0), n AS (SELECT * FROM lk WHERE location_id % 2 = 0),
  np AS (SELECT job_id, max(location_id) AS pl FROM n WHERE is_primary GROUP BY 1)
  SELECT coalesce(h.job_id, n.job_id) AS job_id, coalesce(h.location_id, n.location_id) AS location_id, CASE WHEN np.job_id IS NULL THEN coalesce(n.is_primary, h.is_primary) ELSE np.pl = coalesce(h.location_id, n.location_id) END AS is_primary, coalesce(h.created_at, n.created_at) AS created_at
  FROM h FULL JOIN n ON h.job_id = n.job_id AND h.location_id = n.location_id LEFT JOIN np ON np.job_id = coalesce(h.job_id, n.job_id)""")
def o87_links(spark, sf_dir):
    lk, _ = links(spark, sf_dir)
    new = lk.where("location_id % 2 = 0").withColumn("seq", F.col("location_id"))
    return L.upsert_links(lk.where("job_id % 3 <> 0"), new).select("job_id", "location_id", "is_primary", "created_at")


@query(f"""WITH {LINKS_SQL}, c AS (SELECT job_id, max(location_id) AS location_id FROM lk GROUP BY 1) SELECT lk.job_id, lk.location_id, CASE WHEN lk.job_id % 2 = 0 THEN c.location_id = lk.location_id ELSE is_primary END AS is_primary
  FROM lk JOIN c USING (job_id) WHERE lk.location_id % 5 <> 0""")
def o87_set_primary_unlink(spark, sf_dir):
    lk, _ = links(spark, sf_dir)
    chosen = lk.where("job_id % 2 = 0").groupBy("job_id").agg(F.max("location_id").alias("location_id"))
    return L.unlink(L.set_primary(lk, chosen), lk.where("location_id % 5 = 0").select("job_id", "location_id")).select("job_id", "location_id", "is_primary")


@query(f"""WITH {LINKS_SQL}, j AS ({JOBS_SQL}) SELECT j.job_id, title, 'lever:' || j.source_id AS source, coalesce(string_agg(display_name || CASE WHEN is_primary THEN '*' ELSE '' END, '|' ORDER BY CASE WHEN is_primary THEN 0 ELSE 1 END, created_at, location_id), '') AS places
  FROM j LEFT JOIN lk ON j.job_id = lk.job_id LEFT JOIN lo ON lk.location_id = lo.id GROUP BY 1, 2, 3""")
def o64b_posting_view(spark, sf_dir):
    lk, lo = links(spark, sf_dir)
    rows = jobs(spark, sf_dir)
    sources = rows.select(F.col("source_id").alias("id"), F.lit("lever").alias("platform"), F.col("source_id").alias("identifier")).distinct()
    got = L.posting_view(rows.select("job_id", "title", "source_id"), sources, lk, lo)
    places = F.array_join(F.transform("locations", lambda x: F.concat(x["display_name"], F.when(x["is_primary"], "*").otherwise(""))), "|")
    return got.select("job_id", "title", "source", places.alias("places"))


@query(f"WITH {LINKS_SQL} SELECT DISTINCT job_id FROM lk JOIN lo ON location_id = id WHERE country_code = 'QA'")
def o51_country_filter(spark, sf_dir):
    lk, lo = links(spark, sf_dir)
    return L.country_filter(jobs(spark, sf_dir).select("job_id"), lk, lo, "QA")
