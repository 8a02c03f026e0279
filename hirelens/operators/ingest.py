"""Landed payloads of eight platforms to postings of one shape, for all sources in one job.

Landed payloads are shredded: each is parsed once, by its platform's schema, into a typed struct that is kept as a table
by platform; a platform's postings are a projection of its part of that table. A source whose rows can't all be mapped has
failed as a whole: it is reported, and the reconcile leaves its stored rows alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions import normalize as N
from hirelens.functions.html import html_text
from hirelens.sources.store import bounded, fresh_folder, staged

# Where a platform's answer holds its list of postings.
LIST_PATHS = {
    "greenhouse": "$.jobs", "ashby": "$.jobs", "lever": "$", "smartrecruiters": "$.content", "eightfold": "$.data.positions",
    "apple": "$.res.searchResults", "uber": "$.data.results", "tiktok": "$.data.job_post_list",
}
# Sections of a description, in order.
JOB_AD_SECTIONS = ("companyDescription", "jobDescription", "qualifications", "additionalInformation")
TITLED_SECTIONS = {
    "Summary": "jobSummary", "Description": "description", "Minimum Qualifications": "minimumQualifications",
    "Preferred Qualifications": "preferredQualifications", "Pay & Benefits": "payAndBenefits",
}
SALARY = {"Min": "min_salary", "Max": "max_salary", "Currency": "currency"}
# Where a posting can be applied for.
APPLY_AT = {"apple": "https://jobs.apple.com/en-us/details/", "uber": "https://www.uber.com/global/en/careers/list/", "tiktok": "https://lifeattiktok.com/search/"}

FIELDS = (
    "external_job_id", "title", "apply_url", "department", "team", "employment_type", "description_html", "description_plain", "published_at", "source_updated_at",
    "location_text", "city", "region", "country_raw", "workplace_type", "is_structured",
)
PLACE = "struct<city:string,region:string,countryName:string,country:string>"
LABEL = "struct<en_name:string,name:string,i18n_name:string>"
_SECTIONS = ", ".join(f"{x}: struct<title:string,text:string>" for x in JOB_AD_SECTIONS)
#: What is read of a payload. Text of any other kind is read as text; a field of another shape is null.
SCHEMAS = {
    "greenhouse": "id string, title string, absolute_url string, content string, location struct<name:string>, departments array<struct<name:string>>, metadata array<struct<name:string,value:string>>, first_published string, updated_at string",
    "lever": "id string, text string, applyUrl string, description string, descriptionPlain string, categories struct<location:string,department:string,team:string,commitment:string>, createdAt string, updatedAt string",
    "ashby": "id string, title string, applyUrl string, location string, department string, team string, employmentType string, descriptionHtml string, descriptionPlain string, publishedAt string",
    "smartrecruiters": "id string, name string, applyUrl string, postingUrl string, releasedDate string, location struct<fullLocation:string,city:string,region:string,country:string,remote:string>, "
    f"department struct<label:string>, function struct<label:string>, typeOfEmployment struct<label:string>, jobAd struct<sections: struct<{_SECTIONS}>>",
    "eightfold": "id string, name string, _board_base_url string, positionUrl string, department string, workLocationOption string, jobDescription string, standardizedLocations array<string>, locations array<string>, postedTs string, creationTs string, "
    "employmentType string, workerType string, typeOfEmployment string",
    "apple": "positionId string, id string, postingTitle string, transformedPostingTitle string, jobSummary string, description string, minimumQualifications string, preferredQualifications string, payAndBenefits string, postDateInGMT string, "
    "team struct<teamName:string>, locations array<struct<name:string,city:string,stateProvince:string,countryName:string>>",
    "uber": "id string, title string, description string, department string, team string, timeType string, creationDate string, updatedDate string, location string, allLocations string",
    "tiktok": "id string, title string, description string, requirement string, city_info struct<en_name:string,name:string,i18n_name:string,"
    f"parent:struct<parent:{LABEL}>>, job_category {LABEL}, department_info {LABEL}, job_subject {LABEL}, recruit_type {LABEL}, job_post_info struct<min_salary:string,max_salary:string,currency:string>",
}
#: What a platform's projection gives; the rest follows from these for all platforms alike.
RAW = ("external_job_id", "title", "apply_url", "department", "team", "kind", "description_html", "description_plain", "published", "updated", "location_text", "city", "region", "country_raw", "hint")


def scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, platform, seq, payload) of landed answers: JSON lines of source_id, platform, page and body, the
    platform's answer as text. Entries of its list that are no objects, and bodies without a list, give nothing."""
    pages = spark.read.schema("source_id string, platform string, page long, body string").json(path)
    return unpack_pages(pages)


def unpack_pages(pages: DataFrame) -> DataFrame:
    """As `scan_raw`, of pages (source_id, platform, page, body). seq orders a source's entries."""
    found = F.lit(None).cast("string")
    for platform, at in LIST_PATHS.items():
        found = F.when(F.col("platform") == platform, F.get_json_object("body", at)).otherwise(found)
    spread = pages.select("source_id", "platform", "page", F.posexplode(F.from_json(found, "array<string>")).alias("pos", "payload"))
    seq = F.col("page") * F.lit(1 << 32) + F.col("pos")
    return spread.where(F.col("payload").startswith("{")).select("source_id", "platform", seq.alias("seq"), "payload")


def merged(summary: Column, detail: Column) -> Column:
    """A map of a summary's fields with those of its detail in their place, nulls too."""
    names = F.map_keys(detail)
    return F.map_concat(F.map_filter(summary, lambda k, _: ~F.array_contains(names, k)), detail)


def merge_payloads(summary: DataFrame, detail: DataFrame, key: str, policy: str = "drop") -> DataFrame:
    """`summary` (key, fields map<string,string>) with the fields of `detail` (key, fields). Without a detail a row is
    dropped, or kept with `_detail_fetch_failed` (policy flag)."""
    d = detail.select(F.col(key), F.col("fields").alias("more"))
    if policy == "drop":
        return summary.join(d, key).select(key, merged(F.col("fields"), F.col("more")).alias("fields"))
    flagged = F.map_from_arrays(F.array(F.lit("_detail_fetch_failed")), F.array(F.lit("true")))
    fields = F.when(F.col("more").isNotNull(), merged(F.col("fields"), F.col("more"))).otherwise(merged(F.col("fields"), flagged))
    return summary.join(d, key, "left").select(key, fields.alias("fields"))


def field(v: Column, path: str) -> Column:
    """What is at a path such as `$.a.b[0].c`; null if a step isn't there."""
    for name, number in re.findall(r"\.(\w+)|\[(\d+)\]", path):
        v = v[name] if name else F.get(v, F.lit(int(number)))
    return v


def text(v: Column, path: str) -> Column:
    """The stripped text at `path`; null if empty."""
    return N.clean(field(v, path))


def as_text(path: str) -> Column:
    return text(F.col("v"), path)


def items(path: str) -> Column:
    return field(F.col("v"), path)


def first_text(values: Column, of: Callable[[Column], Column]) -> Column:
    """The first text that `of` gives for an entry of an array."""
    return F.get(F.filter(F.transform(values, of), lambda x: x.isNotNull()), F.lit(0))


def joined(sep: str, *parts: Column) -> Column:
    return F.nullif(F.concat_ws(sep, *parts), F.lit(""))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def greenhouse() -> dict[str, Column]:
    named = F.filter(items("$.metadata"), lambda x: F.coalesce(F.lower(x["name"]).contains("employment"), F.lit(False)))
    kind = text(F.get(named, F.lit(0)), "$.value")
    return {
        "external_job_id": as_text("$.id"), "title": as_text("$.title"), "apply_url": as_text("$.absolute_url"), "department": as_text("$.departments[0].name"),
        "kind": kind, "description_html": as_text("$.content"),
        "published": as_text("$.first_published"), "updated": as_text("$.updated_at"), "location_text": as_text("$.location.name"), "hint": kind,
    }


def lever() -> dict[str, Column]:
    kind = as_text("$.categories.commitment")
    return {
        "external_job_id": as_text("$.id"), "title": as_text("$.text"), "apply_url": as_text("$.applyUrl"), "department": as_text("$.categories.department"),
        "team": as_text("$.categories.team"), "kind": kind, "description_html": as_text("$.description"),
        "description_plain": as_text("$.descriptionPlain"), "published": as_text("$.createdAt"), "updated": as_text("$.updatedAt"),
        "location_text": as_text("$.categories.location"), "hint": kind,
    }


def ashby() -> dict[str, Column]:
    kind = as_text("$.employmentType")
    return {
        "external_job_id": as_text("$.id"), "title": as_text("$.title"), "apply_url": as_text("$.applyUrl"), "department": as_text("$.department"), "team": as_text("$.team"),
        "kind": kind, "description_html": as_text("$.descriptionHtml"), "description_plain": as_text("$.descriptionPlain"),
        "published": as_text("$.publishedAt"), "location_text": as_text("$.location"), "hint": kind,
    }


def smartrecruiters() -> dict[str, Column]:
    def section(name: str) -> Column:
        body, title = as_text(f"$.jobAd.sections.{name}.text"), as_text(f"$.jobAd.sections.{name}.title")
        return F.when(body.isNotNull(), F.concat_ws("\n", F.concat(F.lit("<h2>"), escaped(title), F.lit("</h2>")), body))

    html = joined("\n", *map(section, JOB_AD_SECTIONS))
    city, region, country = (as_text(f"$.location.{x}") for x in ("city", "region", "country"))
    return {
        "external_job_id": as_text("$.id"), "title": as_text("$.name"), "apply_url": F.coalesce(as_text("$.applyUrl"), as_text("$.postingUrl")),
        "department": as_text("$.department.label"), "team": as_text("$.function.label"), "kind": as_text("$.typeOfEmployment.label"),
        "description_html": html, "published": as_text("$.releasedDate"),
        "location_text": F.coalesce(as_text("$.location.fullLocation"), joined(", ", city, region, country)), "city": city, "region": region, "country_raw": country,
        "hint": F.when(F.lower(as_text("$.location.remote")) == "true", "remote"),
    }


def eightfold() -> dict[str, Column]:
    where = F.coalesce(*(first_text(items(x), lambda i: text(i, "$")) for x in ("$.standardizedLocations", "$.locations")))
    base, at = as_text("$._board_base_url"), as_text("$.positionUrl")
    return {
        "external_job_id": as_text("$.id"), "title": as_text("$.name"), "apply_url": F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(at, F.lit("/"))),
        "department": as_text("$.department"), "kind": F.coalesce(*(as_text(x) for x in ("$.employmentType", "$.workerType", "$.typeOfEmployment"))),
        "description_plain": as_text("$.jobDescription"), "published": as_text("$.postedTs"), "updated": as_text("$.creationTs"),
        "location_text": where, "hint": as_text("$.workLocationOption"),
    }


def apple() -> dict[str, Column]:
    parts = ("city", "stateProvince", "countryName")
    where = first_text(items("$.locations"), lambda i: F.coalesce(text(i, "$.name"), joined(", ", *(text(i, f"$.{x}") for x in parts))))
    city, region, country = map(_apple_part, parts)
    own = {title: as_text(f"$.{x}") for title, x in TITLED_SECTIONS.items()}
    number = as_text("$.positionId")
    return {
        "external_job_id": F.coalesce(number, as_text("$.id")), "title": as_text("$.postingTitle"), "department": as_text("$.team.teamName"),
        "apply_url": F.concat(F.lit(APPLY_AT["apple"]), number, F.lit("/"), F.coalesce(as_text("$.transformedPostingTitle"), number)),
        "description_html": joined("\n", *(F.concat(F.lit("<h2>"), escaped(F.lit(t)), F.lit("</h2><p>"), F.replace(escaped(c), F.lit("\n"), F.lit("<br/>")), F.lit("</p>")) for t, c in own.items())),
        "description_plain": joined("\n\n", *(F.concat(F.lit(f"{t}:\n"), c) for t, c in own.items())), "published": as_text("$.postDateInGMT"),
        "location_text": where, "city": city, "region": region, "country_raw": country
    }


def _apple_part(name: str) -> Column:
    return first_text(items("$.locations"), lambda i: text(i, f"$.{name}"))


def uber() -> dict[str, Column]:
    """A place is an object or a list of them, under either of two names."""
    places = [F.coalesce(F.from_json(field(F.col("v"), x), f"array<{PLACE}>"), F.array().cast(f"array<{PLACE}>")) for x in ("$.location", "$.allLocations")]
    either = F.concat(*places)  # one object is read as an array of it
    country = lambda i: F.coalesce(text(i, "$.countryName"), text(i, "$.country"))
    shown = lambda i: F.nullif(F.array_join(F.array_distinct(F.filter(F.array(text(i, "$.city"), text(i, "$.region"), country(i)), lambda x: x.isNotNull())), ", "), F.lit(""))
    number = as_text("$.id")
    return {
        "external_job_id": number, "title": as_text("$.title"), "apply_url": F.concat(F.lit(APPLY_AT["uber"]), number, F.lit("/")), "department": as_text("$.department"), "team": as_text("$.team"),
        "kind": as_text("$.timeType"), "description_plain": as_text("$.description"), "published": as_text("$.creationDate"), "updated": as_text("$.updatedDate"),
        "location_text": first_text(either, shown), "city": first_text(either, lambda i: text(i, "$.city")), "region": first_text(either, lambda i: text(i, "$.region")),
        "country_raw": F.coalesce(first_text(either, lambda i: text(i, "$.countryName")), first_text(either, lambda i: text(i, "$.country")))
    }


def tiktok() -> dict[str, Column]:
    def label(path: str) -> Column:
        return F.coalesce(*(as_text(f"{path}.{x}") for x in ("en_name", "name", "i18n_name")))

    pay = joined("\n", *(F.concat(F.lit(f"{t}: "), as_text(f"$.job_post_info.{x}")) for t, x in SALARY.items()))
    city, country, number = label("$.city_info"), label("$.city_info.parent.parent"), as_text("$.id")
    return {
        "external_job_id": number, "title": as_text("$.title"), "apply_url": F.concat(F.lit(APPLY_AT["tiktok"]), number), "department": label("$.job_category"),
        "team": F.coalesce(label("$.department_info"), label("$.job_subject")), "kind": label("$.recruit_type"),
        "description_plain": joined("\n\n", as_text("$.description"), as_text("$.requirement"), F.concat(F.lit("Salary information:\n"), pay)),
        "location_text": joined(", ", city, country), "city": city, "country_raw": country
    }


MAPPERS = {f.__name__: f for f in (greenhouse, lever, ashby, smartrecruiters, eightfold, apple, uber, tiktok)}
#: Platforms whose rows must have an address to apply at.
NEEDS_URL = ("eightfold", "apple", "uber", "tiktok")
#: Platforms that name city and country, and those whose place text tells the workplace.
STRUCTURED = ("smartrecruiters", "apple", "uber", "tiktok")


def shredded(landed: DataFrame) -> DataFrame:
    """(source_id, seq, platform, shape and a struct `v_` of each platform, null but for the row's own) of `landed`
    (source_id, platform, seq, payload), written once by `shape`: the platform, or `unknown`."""
    spark = landed.sparkSession
    shape = F.when(F.col("platform").isin(*MAPPERS), F.col("platform")).otherwise("unknown")
    parsed = [F.when(F.col("platform") == p, F.from_json("payload", SCHEMAS[p])).alias(f"v_{p}") for p in MAPPERS]
    typed = landed.select("source_id", "platform", "seq", *parsed, shape.alias("shape"))
    path = fresh_folder(spark, "shredded")
    typed.write.partitionBy("shape").parquet(path)
    return spark.read.schema(typed.schema).parquet(path)


def map_payloads(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, failed) of `landed` (source_id, platform, seq, payload).

    postings: source_id, platform, seq and FIELDS, of sources without an error. location_text is the place as written;
    city, region and country_raw are set where the platform names them (is_structured). failed: source_id and n_errors
    of each source that has a row without an external id, without an address where one is made up of parts, of an
    unknown platform, or that is no JSON object. Both are read from tables that are written here.
    """
    typed, made = shredded(landed), []
    for platform, mapper in MAPPERS.items():
        got = mapper()
        rows = typed.where(F.col("shape") == platform).withColumn("v", F.col(f"v_{platform}"))  # only its files are read
        raw = rows.select("source_id", "platform", "seq", *(got.get(c, F.lit(None)).cast("string").alias(c) for c in RAW))
        if platform == "smartrecruiters":
            raw = raw.withColumn("description_plain", F.when(F.col("description_html").isNotNull(), html_text(F.col("description_html"))).otherwise(F.col("description_plain")))
        made.append(raw)
    raw = reduce(DataFrame.unionByName, made).withColumn("is_structured", F.col("platform").isin(*STRUCTURED))
    hints = F.when(F.col("is_structured"), F.array("hint")).otherwise(F.array("location_text", "hint"))
    bad = F.col("external_job_id").isNull() | (F.col("platform").isin(*NEEDS_URL) & F.col("apply_url").isNull())
    mapped = raw.withColumns({
        "employment_type": N.employment_type(F.col("kind")), "published_at": N.flexible_timestamp(F.col("published")),
        "source_updated_at": N.flexible_timestamp(F.col("updated")), "workplace_type": N.workplace(hints), "bad": bad,
    }).select("source_id", "platform", "seq", *FIELDS, "bad")
    mapped = staged(mapped, "mapped")
    errors = mapped.where("bad").select("source_id").unionByName(typed.where("shape = 'unknown'").select("source_id"))
    failed = staged(errors.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_errors")), "failed-sources")
    return mapped.drop("bad").join(bounded(failed.select("source_id")), "source_id", "left_anti"), failed


def with_hints(postings: DataFrame, parsed: DataFrame, countries: DataFrame) -> DataFrame:
    """`postings` with location_hints, an array of at most one struct.

    parsed: (location_text, city, region, country_code, remote_scope) of the texts of platforms that give one text;
    countries: (country_raw, country_code) of those that name a country. Nothing known: an empty array.
    """
    p = parsed.select("location_text", *(F.col(c).alias(f"p_{c}") for c in ("city", "region", "country_code", "remote_scope")))
    c = countries.select("country_raw", F.col("country_code").alias("c_code"))
    got = postings.join(p, "location_text", "left").join(c, "country_raw", "left")
    own = F.col("is_structured")
    city, region, code = (F.when(own, F.col(a)).otherwise(F.col(b)) for a, b in (("city", "p_city"), ("region", "p_region"), ("c_code", "p_country_code")))
    hint = F.struct(
        city.alias("city"), region.alias("region"), code.alias("country_code"), F.coalesce("workplace_type", F.lit("unknown")).alias("workplace_type"),
        F.when(~own, F.col("p_remote_scope")).alias("remote_scope"), F.col("location_text").alias("source_raw"),
    )
    usable = F.coalesce(F.col("location_text"), city, region, code).isNotNull()
    kept = [x for x in postings.columns if x not in ("city", "region", "country_raw", "is_structured", "location_text", "workplace_type")]
    return got.select(*kept, F.when(usable, F.array(hint)).otherwise(F.array().cast("array<struct<city:string,region:string,country_code:string,workplace_type:string,remote_scope:string,source_raw:string>>")).alias("location_hints"))
