"""Queries over landed payloads: the given orders as eight platforms would answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.operators import ingest as I  # noqa: E741
from hirelens.operators import locations as L
from hirelens.operators import snapshot as S
from hirelens.plans import places
from hirelens.plans.registry import query
from hirelens.sources.fixtures import JOBS_SQL, jobs, table
from hirelens.sources.store import fresh_folder

PLATFORMS = tuple(I.MAPPERS)
COUNTRIES = ("Canada", "France", "Japan")
LABELS = {"Full-time": "full-time", "Contractor": "contract", "Intern (summer)": "intern", "Temp role": "temporary"}
BODIES = {
    "greenhouse": '{"jobs":%s}', "ashby": '{"jobs":%s}', "lever": "%s", "smartrecruiters": '{"content":%s}', "eightfold": '{"data":{"positions":%s}}',
    "apple": '{"res":{"searchResults":%s}}', "uber": '{"data":{"results":%s}}', "tiktok": '{"data":{"job_post_list":%s}}',
}


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(at) % len(values) + 1).cast("int"))


def _posts(spark, sf_dir) -> DataFrame:
    """A row per order: of one of 40 sources, whose platform is that of its number. Source 39 has rows without an id."""
    return jobs(spark, sf_dir).select(
        F.concat(F.lit("s"), (F.col("job_id") % 40).cast("string")).alias("source_id"), _pick(PLATFORMS, "job_id").alias("platform"), F.floor(F.col("job_id") / 2000).alias("page"), "job_id", "title",
        F.when(F.col("job_id") % 1000 == 39, "").otherwise(F.col("job_id").cast("string")).alias("id"), F.concat(F.lit("City "), (F.col("o_custkey") % 50).cast("string")).alias("city"),
        _pick(COUNTRIES, "o_custkey").alias("country"), _pick(list(LABELS), "o_custkey").alias("kind"), F.date_format("last_seen_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.unix_timestamp("last_seen_at").alias("unix"),
    )


def _obj(**fields):
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _payload() -> dict:
    c, lit, none = F.col, F.lit, F.lit(None).cast("string")
    where = F.concat_ws(", ", "city", "country")
    url = F.concat(lit("https://b.example/"), c("id"))
    nested = _obj(name=c("city"), parent=_obj(parent=_obj(en_name=c("country"))))
    return {
        "greenhouse": _obj(id=c("id"), title=c("title"), absolute_url=url, content=F.concat(lit("<p>"), c("title"), lit("</p>")), location=_obj(name=where), departments=F.array(_obj(name=lit(" Dept A "))),
                           metadata=F.array(_obj(name=lit("Level"), value=lit("x")), _obj(name=lit("Employment kind"), value=c("kind"))), first_published=c("iso"), updated_at=c("iso")),
        "lever": _obj(id=c("id"), text=c("title"), applyUrl=url, descriptionPlain=c("title"), categories=_obj(location=F.concat(lit("Remote - "), c("country")), commitment=c("kind"), team=lit("Team"), department=lit("")), createdAt=c("unix") * 1000),
        "ashby": _obj(id=c("id"), title=F.concat(lit("  "), c("title")), applyUrl=url, location=where, department=lit("D"), team=lit("T"), employmentType=c("kind"), descriptionHtml=lit("<b>x</b>"), publishedAt=c("iso")),
        "smartrecruiters": _obj(id=c("id"), name=c("title"), postingUrl=url, releasedDate=c("iso"), location=_obj(city=c("city"), country=c("country"), remote=c("job_id") % 3 == 0), department=_obj(label=lit("D")),
                                typeOfEmployment=_obj(label=c("kind")), jobAd=_obj(sections=_obj(qualifications=_obj(title=lit("You & us"), text=lit("b")), jobDescription=_obj(title=lit(""), text=lit("a")), companyDescription=_obj(title=lit("C"), text=lit(" "))))),
        "eightfold": _obj(id=c("id"), name=c("title"), _board_base_url=lit("https://b.example/x/"), positionUrl=F.concat(lit("/p/"), c("id")), standardizedLocations=F.array(lit(" "), where), locations=F.array(lit("no")),
                          workLocationOption=lit("hybrid"), jobDescription=c("title"), postedTs=c("unix")),
        "apple": _obj(positionId=c("id"), postingTitle=c("title"), transformedPostingTitle=lit("slug"), description=lit("a < b"), preferredQualifications=lit("c"), team=_obj(teamName=lit("Team")),
                      locations=F.array(_obj(city=none, countryName=c("country")), _obj(city=c("city"), countryName=lit("no")))),
        "uber": _obj(id=c("id"), title=c("title"), department=lit("D"), timeType=c("kind"), description=c("title"), creationDate=c("iso"), location=F.array(_obj(city=lit(" "), region=none, country=none), _obj(city=c("city"), region=c("city"), country=c("country")))),
        "tiktok": _obj(id=c("id"), title=c("title"), description=lit("a"), requirement=lit("b"), city_info=nested, job_category=_obj(en_name=lit(""), name=lit("D")), recruit_type=_obj(en_name=c("kind")), job_post_info=_obj(min_salary=lit("1"), currency=lit("EUR"))),
    }


def landed_pages(spark, sf_dir) -> DataFrame:
    """(source_id, platform, page, body): answers of at most 50 postings each, and an entry that is no object."""
    posts, made = _posts(spark, sf_dir), _payload()
    text = F.lit(None).cast("string")
    for p in PLATFORMS:
        text = F.when(F.col("platform") == p, F.to_json(made[p])).otherwise(text)
    pages = posts.select("source_id", "platform", "page", "job_id", text.alias("payload")).groupBy("source_id", "platform", "page").agg(F.array_sort(F.collect_list(F.struct("job_id", "payload"))).alias("x"))
    listed = F.concat(F.lit("[7,"), F.array_join(F.transform("x", lambda y: y["payload"]), ","), F.lit("]"))
    bodies = [F.when(F.col("platform") == p, F.concat(F.lit(b.split("%s")[0]), listed, F.lit(b.split("%s")[1]))) for p, b in BODIES.items()]
    return pages.select("source_id", "platform", "page", F.coalesce(*bodies).alias("body"))


def mapped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """By way of the landed files."""
    path = fresh_folder(spark, "landed")
    landed_pages(spark, sf_dir).write.json(path)
    return I.map_payloads(I.scan_raw(spark, path))


def _case(values: dict, otherwise: str = "NULL") -> str:
    return "CASE platform " + " ".join(f"WHEN '{p}' THEN {x}" for p, x in values.items()) + f" ELSE {otherwise} END"


_list = "CASE job_id % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLATFORMS)) + " END"
POSTS = f"""WITH j AS ({JOBS_SQL}), p AS (SELECT 's' || (job_id % 40) AS source_id, {_list} AS platform, job_id, title, CAST(job_id AS VARCHAR) AS id, 'City ' || (o_custkey % 50) AS city, last_seen_at AS seen_at,
  CASE o_custkey % 3 WHEN 0 THEN 'Canada' WHEN 1 THEN 'France' ELSE 'Japan' END AS country, CASE o_custkey % 4 WHEN 0 THEN 'full-time' WHEN 1 THEN 'contract' WHEN 2 THEN 'intern' ELSE 'temporary' END AS kind FROM j WHERE job_id % 40 <> 39)"""
_both, _own = "city || ', ' || country", "'https://b.example/' || id"
EXPECTED = f"""SELECT source_id, platform, id AS external_job_id, title,
  {_case({"eightfold": "'https://b.example/x/p/' || id", "apple": "'https://jobs.apple.com/en-us/details/' || id || '/slug'", "uber": "'https://www.uber.com/global/en/careers/list/' || id || '/'", "tiktok": "'https://lifeattiktok.com/search/' || id"}, _own)} AS apply_url,
  {_case({"greenhouse": "'Dept A'", "lever": "NULL", "apple": "'Team'", "eightfold": "NULL"}, "'D'")} AS department, {_case({"lever": "'Team'", "ashby": "'T'"})} AS team, {_case({"apple": "NULL", "eightfold": "NULL"}, "kind")} AS employment_type,
  {_case({"greenhouse": "'<p>' || title || '</p>'", "ashby": "'<b>x</b>'", "smartrecruiters": "'a' || chr(10) || '<h2>You &amp; us</h2>' || chr(10) || 'b'", "apple": "'<h2>Description</h2><p>a &lt; b</p>' || chr(10) || '<h2>Preferred Qualifications</h2><p>c</p>'"})} AS description_html,
  {_case({"lever": "title", "eightfold": "title", "uber": "title", "apple": "'Description:' || chr(10) || 'a < b' || chr(10) || chr(10) || 'Preferred Qualifications:' || chr(10) || 'c'", "tiktok": "'a' || chr(10) || chr(10) || 'b' || chr(10) || chr(10) || 'Salary information:' || chr(10) || 'Min: 1' || chr(10) || 'Currency: EUR'", "smartrecruiters": "'a' || chr(10) || ' You & us ' || chr(10) || ' ' || chr(10) || 'b'"})} AS description_plain,
  {_case({"apple": "NULL", "tiktok": "NULL"}, "seen_at")} AS published_at, {_case({"lever": "'Remote - ' || country", "apple": "country", "uber": _both}, _both)} AS location_text,
  {_case({"smartrecruiters": "city", "apple": "city", "uber": "city", "tiktok": "city"})} AS city, {_case({"smartrecruiters": "country", "apple": "country", "uber": "country", "tiktok": "country"})} AS country_raw,
  {_case({"lever": "'remote'", "eightfold": "'hybrid'", "smartrecruiters": "CASE WHEN job_id % 3 = 0 THEN 'remote' END"})} AS workplace_type FROM p"""


@query(f"{POSTS} {EXPECTED}")
def o01_o13_o21_map(spark, sf_dir):
    good, _ = mapped(spark, sf_dir)
    names = "source_id platform external_job_id title apply_url department team employment_type description_html description_plain published_at location_text city country_raw workplace_type".split()
    return good.select(*names)


@query(f"WITH j AS ({JOBS_SQL}) SELECT 's39' AS source_id, count(*) AS n_errors FROM j WHERE job_id % 1000 = 39 HAVING count(*) > 0")
def o21_failed_sources(spark, sf_dir):
    return mapped(spark, sf_dir)[1]


_known = "CASE country WHEN 'Canada' THEN 'CA' WHEN 'France' THEN 'FR' END"


@query(f"""{POSTS} SELECT source_id, id AS external_job_id, {_case({"smartrecruiters": "city", "apple": "city", "uber": "city", "tiktok": "city", "lever": "NULL"}, f"CASE WHEN {_known} IS NOT NULL THEN city END")} AS city, {_known} AS country_code,
  {_case({"lever": "country"})} AS scope, 1 AS n FROM p""")
def o22_hints(spark, sf_dir):
    """Place texts by the parser, country fields by the resolver, both against the dimensions and two more countries;
    hints have what is known, and the text as it was."""
    good, _ = mapped(spark, sf_dir)
    countries, cities, admin1 = places.dims(spark, sf_dir)
    none = {c: F.lit(None).cast(t).alias(c) for c, t in countries.dtypes if c not in ("code", "name")}
    more = spark.sql("SELECT * FROM VALUES ('CA', 'Canada'), ('FR', 'France') AS t(code, name)").select("code", "name", *none.values())
    countries = countries.unionByName(more)
    parsed = L.parse_locations(good.where("NOT is_structured").select("location_text").distinct(), countries, cities, admin1)
    named = good.where("country_raw IS NOT NULL").select(F.col("country_raw").alias("text"), F.lit(True).alias("explicit")).distinct()
    codes = L.resolve_countries(named, countries).select(F.col("text").alias("country_raw"), "country_code")
    hints = I.with_hints(good, parsed, codes)
    first = F.get("location_hints", F.lit(0))
    return hints.select("source_id", "external_job_id", first["city"].alias("city"), first["country_code"].alias("country_code"), first["remote_scope"].alias("scope"), F.size("location_hints").alias("n"))


@query(f"""WITH j AS ({JOBS_SQL}), m AS (SELECT 's' || (job_id % 40) AS source_id, CAST(job_id AS VARCHAR) AS external_job_id, job_id % 40 AS s, job_id % 3 <> 0 AS held, job_id % 7 <> 0 AS seen, title FROM j)
  SELECT source_id, external_job_id, CASE WHEN s = 39 THEN 'keep' WHEN seen AND held THEN 'update' WHEN seen THEN 'insert' ELSE 'close' END AS action FROM m WHERE (held AND (s <> 39 OR held)) OR (seen AND s <> 39)""")
def o85_after_mapping(spark, sf_dir):
    """Landed payloads against a stored state: the failed source's rows are kept as they are."""
    rows, (good, failed) = jobs(spark, sf_dir), mapped(spark, sf_dir)
    seen = good.where(F.col("external_job_id").cast("long") % 7 != 0).select("source_id", "external_job_id", "title", "seq")
    at = F.lit("2030-01-01").cast("timestamp")
    held = rows.where("job_id % 3 <> 0").select(F.concat(F.lit("s"), (F.col("job_id") % 40).cast("string")).alias("source_id"), F.col("job_id").cast("string").alias("external_job_id"), F.col("job_id").cast("string").alias("id"), F.lit("open").alias("status"), "last_seen_at", F.col("last_seen_at").alias("created_at"), F.col("last_seen_at").alias("updated_at"), "title")
    return S.reconcile(held, S.last_wins(seen), at, ["title"], failed).select("source_id", "external_job_id", "action")


def _details(spark, sf_dir):
    pairs = lambda **f: F.map_from_arrays(F.array(*map(F.lit, f)), F.array(*f.values()))
    own = table(spark, sf_dir, "orders").select("o_orderkey", pairs(status=F.lit("0"), kept=F.col("o_orderstatus")).alias("fields"))
    n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    return own, n.select("o_orderkey", pairs(status=F.col("n"), kept=F.lit(None).cast("string")).alias("fields"))


@query("""SELECT l_orderkey AS o_orderkey, CAST(count(*) AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS kept FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def o03_merge_drop(spark, sf_dir):
    """Rows without a detail are dropped."""
    got = I.merge_payloads(*_details(spark, sf_dir), "o_orderkey", "drop")
    return got.select("o_orderkey", F.col("fields")["status"].alias("status"), F.col("fields")["kept"].alias("kept"))


@query("""SELECT o_orderkey, coalesce(n_lines, '0') AS status, CASE WHEN n_lines IS NULL THEN 'true' END AS failed, CASE WHEN n_lines IS NULL THEN o_orderstatus END AS kept FROM orders LEFT JOIN (
  SELECT l_orderkey, CAST(count(*) AS VARCHAR) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) d ON o_orderkey = l_orderkey""")
def o03_merge_payloads(spark, sf_dir):
    got = I.merge_payloads(*_details(spark, sf_dir), "o_orderkey", "flag")
    return got.select("o_orderkey", F.col("fields")["status"].alias("status"), F.col("fields")["_detail_fetch_failed"].alias("failed"), F.col("fields")["kept"].alias("kept"))


