"""Queries over files that Spark writes from the given tables and reads back: reference lists, taxonomies, profiles, results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.plans.registry import ORACLES, QUERIES, query
from hirelens.sources import files as S
from hirelens.sources.fixtures import shared_folder, table


def _written(lines: DataFrame, label: str) -> str:
    """The path of `lines` (one text column), written as text files."""
    path = f"{shared_folder(lines.sparkSession)}/{label}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _tabs(*fields):
    return F.concat_ws("\t", *(f if not isinstance(f, str) else F.lit(f) for f in fields))


def _letter(start: int):
    return F.char(F.col("c_nationkey") + start)


@query("SELECT concat('Q', chr(65 + c_nationkey)) AS code, concat('LN', chr(65 + c_nationkey)) AS iso3, concat('F', chr(65 + c_nationkey)) AS fips, c_name AS name FROM customer WHERE c_custkey % 5 > 2")
def o04_countries(spark, sf_dir):
    """Comments, blank and short lines, and codes of other than two letters are left out."""
    k, name = F.col("c_custkey") % 5, F.col("c_name")
    whole = _tabs(F.concat(F.lit("q"), _letter(97)), F.concat(F.lit(" ln"), _letter(97)), "004", F.concat(F.lit("f"), _letter(97)), name, "Capital")
    lines = table(spark, sf_dir, "customer").select(F.when(k == 0, F.concat(F.lit("#ISO\t"), name)).when(k == 1, _tabs("qa", "qaa", "004", "fa")).when(k == 2, _tabs("qaa", "qaa", "004", "fa", name)).otherwise(whole))
    return S.scan_countries(spark, _written(lines.unionByName(spark.range(3).select(F.lit(" ").alias(lines.columns[0]))), "countries"))


@query("""SELECT concat('Q', chr(65 + c_nationkey)) AS country_code, CASE WHEN c_custkey % 5 = 2 THEN 'A.1' ELSE concat('A', c_custkey % 7) END AS code, concat('Région ', c_name) AS name,
  CASE WHEN c_custkey % 5 = 3 THEN concat('Region ', c_name) END AS ascii FROM customer WHERE c_custkey % 5 > 1""")
def o04_admin1(spark, sf_dir):
    """Lines without a point in the code or without a name are left out; a code may hold further points."""
    k, country, name = F.col("c_custkey") % 5, F.concat(F.lit("q"), _letter(97)), F.concat(F.lit("Région "), "c_name")
    code = F.concat(country, F.lit(".a"), (F.col("c_custkey") % 7).cast("string"))
    lines = table(spark, sf_dir, "customer").select(
        F.when(k == 0, _tabs("nothing", name)).when(k == 1, code).when(k == 2, _tabs(F.concat(country, F.lit(".a.1")), name)).when(k == 3, _tabs(code, name, F.concat(F.lit("Region "), "c_name"), "7")).otherwise(_tabs(code, name, "", "7"))
    )
    return S.scan_admin1(spark, _written(lines, "admin1"))


@query("""SELECT c_custkey AS geonames_id, c_name AS name, lower(c_name) AS ascii, concat('Q', chr(65 + c_nationkey)) AS country_code, CASE WHEN c_custkey % 5 <> 3 THEN 'A1' END AS admin1_code,
  CASE WHEN c_custkey % 5 = 2 THEN 0 ELSE c_custkey * 10 END AS population FROM customer WHERE c_custkey % 5 > 1""")
def o04_cities(spark, sf_dir):
    """Short lines and ids that are no number are left out; a population that is none is 0."""
    k, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    population = F.when(k == 2, "many").otherwise((F.col("c_custkey") * 10).cast("string"))
    start = [F.when(k == 0, "x").otherwise(key), F.col("c_name"), F.lower("c_name"), "", "0", "0", "P", "PPL", F.concat(F.lit("q"), _letter(97)), "", F.when(k == 3, "").otherwise("a1"), "", "", ""]
    lines = table(spark, sf_dir, "customer").select(F.when(k == 1, _tabs(*start)).otherwise(_tabs(*start, population, "", "5", "UTC")))
    return S.scan_cities(spark, _written(lines, "cities"))


def _taxonomy(spark, sf_dir):
    """(rows, counts) of the parts as a taxonomy whose cells hold separators, quotes and line breaks."""
    k = F.col("p_partkey") % 6
    rows = table(spark, sf_dir, "part").select(
        F.when(k != 0, F.concat(F.lit("u"), F.col("p_partkey").cast("string"))).otherwise(" ").alias("ConceptUri"), F.when(k != 1, F.concat(F.lit(' "'), "p_name", F.lit('"; '))).alias("PreferredLabel"),
        F.concat("p_type", F.lit("\n"), "p_brand").alias("altLabels"), F.when(k == 2, "de").when(k == 3, "EN").alias("language"), F.lit("x").alias("note"),
    )
    path = f"{shared_folder(spark)}/taxonomy-{uuid.uuid4().hex}"
    rows.write.csv(path, header=True, sep=";", quote='"', escape='"')
    return S.scan_taxonomy(spark, path)


@query("SELECT concat('u', p_partkey) AS uri, concat('\"', p_name, '\";') AS label, concat(p_type, chr(10), p_brand) AS alt_labels FROM part WHERE p_partkey % 6 > 2")
def o05_taxonomy(spark, sf_dir):
    return _taxonomy(spark, sf_dir)[0].select("uri", "label", "alt_labels")


@query("SELECT count(*) AS input_rows, count(*) FILTER (WHERE p_partkey % 6 < 2) AS skipped FROM part")
def o82_taxonomy_counts(spark, sf_dir):
    return _taxonomy(spark, sf_dir)[1]


_NEGATIVE, _BROKEN, _PART_YEAR = '", "totalYearsExperience": -1}', '{"candidate_id": ', '", "total_years_experience": 2.5}'


@query(f"""SELECT CASE WHEN k <> 3 THEN CAST(c_custkey AS VARCHAR) END AS candidate_id, CASE WHEN k < 2 THEN 'H1B' END AS work_authorization, CASE WHEN k < 2 THEN c_nationkey END AS total_years,
  CASE WHEN k < 2 THEN 'CS' END AS field_of_study, CASE WHEN k < 2 THEN 'x|y' END AS bullets,
  CASE k WHEN 2 THEN concat('{{"candidate_id": "', c_custkey, '{_NEGATIVE}') WHEN 3 THEN '{_BROKEN}' WHEN 4 THEN concat('{{"candidate_id": "', c_custkey, '{_PART_YEAR}') END AS line FROM (SELECT *, c_custkey % 6 AS k FROM customer)""")
def o06b_profiles(spark, sf_dir):
    """Profiles with either spelling of the names, and rejected lines as they stand."""
    k, start = F.col("c_custkey") % 6, F.concat(F.lit('{"candidate_id": "'), F.col("c_custkey").cast("string"))
    years = F.col("c_nationkey").cast("string")
    camel = F.concat(start, F.lit('", "skills": ["a"], "workAuthorization": "H1B", "education": [{"degree": "BSc", "fieldOfStudy": "CS"}], "workHistory": [{"title": "t", "bullets": ["x", "y"]}], "other": {"z": 1}, "totalYearsExperience": '), years, F.lit("}"))
    snake = F.concat(start, F.lit('", "work_authorization": "H1B", "education": [{"field_of_study": "CS"}], "work_history": [{"achievements": ["x", "y"], "place": "p"}], "total_years_experience": '), years, F.lit("}"))
    bad = F.when(k == 2, F.concat(start, F.lit(_NEGATIVE))).when(k == 3, _BROKEN).when(k == 4, F.concat(start, F.lit(_PART_YEAR)))
    lines = table(spark, sf_dir, "customer").select(F.when(k == 0, camel).when(k == 1, snake).when(k == 5, F.concat(start, F.lit('"}'))).otherwise(bad))
    good, rejected = S.scan_profiles(spark, _written(lines, "profiles"))
    shown = good.select("candidate_id", "work_authorization", "total_years", F.get("education", F.lit(0))["field_of_study"].alias("field_of_study"), F.array_join(F.get("work_history", F.lit(0))["bullets"], "|").alias("bullets"))
    return shown.unionByName(rejected, allowMissingColumns=True)


@query(ORACLES["o96_match_pipeline"])
def o08_match_results(spark, sf_dir):
    """The match query's results as JSON lines, read back."""
    found = QUERIES["o96_match_pipeline"](spark, sf_dir)
    path = f"{shared_folder(spark)}/matches-{uuid.uuid4().hex}"
    S.write_matches(found, path)
    return spark.read.schema(found.schema).json(path)
