"""Reference files, skill lists and profiles as DataFrames, and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions import normalize as N

# Names that a taxonomy's columns go by.
TAXONOMY_COLUMNS = {
    "uri": ("uri", "concepturi", "concept_uri", "skill_uri", "id"),
    "label": ("preferredlabel", "preferred_label", "preferred term", "preferred_term", "label", "skill"),
    "alt_labels": ("altlabels", "alt_labels", "alternative_labels", "non_preferred_labels", "nonpreferredlabels", "alternativelabels"),
    "language": ("language", "lang", "language_code"),
}
ALIAS_FIELDS = ("alias", "canonical_uri", "canonical_label", "language", "source")
ALIGNED_FIELDS = ("raw_skill", "normalized_skill", "canonical_uri", "canonical_label", "status")
PROFILE = (
    "candidate_id string, summary string, skills array<string>, workAuthorization string, work_authorization string, totalYearsExperience double, total_years_experience double, "
    "education array<struct<degree:string,school:string,fieldOfStudy:string,field_of_study:string>>, "
    "workHistory array<struct<title:string,company:string,bullets:array<string>,description:string,achievements:array<string>>>, "
    "work_history array<struct<title:string,company:string,bullets:array<string>,description:string,achievements:array<string>>>, _corrupt string"
)


def _tab_fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Lines with `least` tab-separated fields at least, as an array `f`; comments and blank lines are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.transform(F.split("value", "\t"), lambda x: F.trim(x)).alias("f")).where(F.size("f") >= least)


def scan_countries(spark: SparkSession, path: str) -> DataFrame:
    """(code, iso3, fips, name); codes of other than two letters are left out."""
    f = F.col("f")
    return _tab_fields(spark, path, 5).select(F.upper(f[0]).alias("code"), F.upper(f[1]).alias("iso3"), F.upper(f[3]).alias("fips"), f[4].alias("name")).where(F.length("code") == 2)


def scan_admin1(spark: SparkSession, path: str) -> DataFrame:
    """(country_code, code, name, ascii) of lines that start with country.code."""
    f = F.col("f")
    got = _tab_fields(spark, path, 2).where(F.contains(f[0], F.lit(".")))
    return got.select(F.upper(F.substring_index(f[0], ".", 1)).alias("country_code"), F.upper(F.regexp_extract(f[0], r"^[^.]*\.(.*)$", 1)).alias("code"), f[1].alias("name"), F.nullif(F.get(f, F.lit(2)), F.lit("")).alias("ascii"))


def scan_cities(spark: SparkSession, path: str) -> DataFrame:
    """(geonames_id, name, ascii, country_code, admin1_code, population); ids that are no number are left out, such a
    population is 0."""
    f = F.col("f")
    got = _tab_fields(spark, path, 15).select(
        f[0].try_cast("long").alias("geonames_id"), f[1].alias("name"), f[2].alias("ascii"), F.upper(f[8]).alias("country_code"), F.nullif(F.upper(f[10]), F.lit("")).alias("admin1_code"),
        F.coalesce(f[14].try_cast("long"), F.lit(0)).alias("population"),
    )
    return got.where("geonames_id IS NOT NULL")


def taxonomy_delimiter(header: str) -> str:
    """The one of comma, tab and semicolon that a header has most of."""
    return max(",\t;", key=header.count)


def scan_taxonomy(spark: SparkSession, path: str, language: str = "en") -> tuple[DataFrame, DataFrame]:
    """(rows, counts): rows of the language as (seq, uri, label, alt_labels); one row of counts: input_rows, skipped
    (without a uri or label). A file without such columns is an error. Cells may span lines."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError("a taxonomy needs a header")
    raw = spark.read.csv(path, header=True, sep=taxonomy_delimiter(header[0]), multiLine=True, quote='"', escape='"')
    names = {c.strip().lower(): c for c in reversed(raw.columns)}
    found = {k: next((names[c] for c in options if c in names), None) for k, options in TAXONOMY_COLUMNS.items()}
    for k in ("uri", "label"):
        if found[k] is None:
            raise ValueError(f"no {k} column; one of {', '.join(TAXONOMY_COLUMNS[k])} is needed")
    cols = {k: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c else F.lit(None).cast("string") for k, c in found.items()}
    own = F.coalesce(N.skill_text(cols["language"]), F.lit(""))
    spoken = raw.where((own == "") | (own == N.skill_text(F.lit(language)))).select(F.monotonically_increasing_id().alias("seq"), *(cols[k].alias(k) for k in ("uri", "label", "alt_labels")))
    whole = F.col("uri").isNotNull() & F.col("label").isNotNull()
    counts = raw.agg(F.count(F.lit(1)).alias("input_rows")).crossJoin(spoken.agg(F.count_if(~whole).alias("skipped")))  # one row each
    return spoken.where(whole), counts


def scan_skills(spark: SparkSession, path: str) -> DataFrame:
    """(raw) of a file of one skill a line, without blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("raw")).where("raw <> ''")


def scan_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, rejected lines) of JSON lines with camelCase or snake_case names; other names are ignored. A line that
    is no profile, or has a number of years that is negative or not whole, is rejected: (candidate_id, line)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    raw = lines.select("value", F.from_json("value", PROFILE, {"columnNameOfCorruptRecord": "_corrupt"}).alias("p")).select("value", "p.*")
    years = F.coalesce("totalYearsExperience", "total_years_experience")
    bad = F.col("_corrupt").isNotNull() | F.coalesce((years < 0) | (years != F.floor(years)), F.lit(False))
    education = F.transform("education", lambda e: F.struct(e["degree"].alias("degree"), e["school"].alias("school"), F.coalesce(e["fieldOfStudy"], e["field_of_study"]).alias("field_of_study")))
    work = F.transform(F.coalesce("workHistory", "work_history"), lambda w: F.struct(w["title"].alias("title"), w["company"].alias("company"), F.coalesce(w["bullets"], w["achievements"], F.when(F.trim(w["description"]) != "", F.array(w["description"]))).alias("bullets")))
    good = raw.where(~bad).select("candidate_id", "summary", "skills", F.coalesce("workAuthorization", "work_authorization").alias("work_authorization"), years.cast("int").alias("total_years"), education.alias("education"), work.alias("work_history"))
    return good, raw.where(bad).select("candidate_id", F.col("value").alias("line"))


def write_aliases(aliases: DataFrame, path: str, language: str = "en", source: str = "taxonomy") -> None:
    """An alias table (alias, uri, label) as CSV with a header."""
    out = aliases.select("alias", F.col("uri").alias("canonical_uri"), F.col("label").alias("canonical_label"), F.lit(language).alias("language"), F.lit(source).alias("source"))
    out.select(*ALIAS_FIELDS).write.csv(path, header=True)


def write_aligned(aligned: DataFrame, path: str) -> None:
    """Aligned skills (raw, alias, uri, label, status) as CSV with a header."""
    out = aligned.select(F.col("raw").alias("raw_skill"), F.col("alias").alias("normalized_skill"), F.col("uri").alias("canonical_uri"), F.col("label").alias("canonical_label"), "status")
    out.select(*ALIGNED_FIELDS).write.csv(path, header=True)


def write_matches(results: DataFrame, path: str) -> None:
    """Match results as JSON lines, nulls included."""
    results.write.option("ignoreNullFields", "false").json(path)
