"""The recommendation from profiles to results, and its SQL."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from hirelens.operators import recommend as W
from hirelens.plans.places import LINKS_SQL, links
from hirelens.plans.registry import CANDIDATES, DOMAIN_SQL, MINIMUM, ORACLES, _match_jobs, query
from hirelens.sources.fixtures import jobs, shared_folder, table
from hirelens.sources.store import bounded, staged

TARGET = {"embedding_kind": "job", "embedding_target_revision": 2, "embedding_model": "m", "embedding_dim": 4}
LEAST, WINDOW = 0.95, 10
#: The stated query set: customers whose number is divisible by 50.
ASKED = "c_custkey % 50 = 0"


def _vector(n):
    return F.array(*(x.cast("float") for x in (n % 7 + 1, n % 5 + 1, n % 3 + 1, F.lit(1))))


def _embed(texts):
    found = [int(re.search(r"Nr (\d+)", t)[1]) for t in texts]
    return [[float(n % 7 + 1), float(n % 5 + 1), float(n % 3 + 1), 1.0] for n in found]


def _judge(payloads):
    titles = [json.loads(p)["job_profile"]["title"] for p in payloads]
    return ["yes" if "Engineer" in t else "stretch" if "Gardener" in t else None if "Sales" in t else "maybe" for t in titles]


def _profiles(spark, sf_dir):
    c, key = table(spark, sf_dir, "customer").where(ASKED), F.col("c_custkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (key % len(xs) + 1).cast("int"))
    work = F.array(F.struct(pick("Data Scientist", "Gardener", "Treasury Analyst", "Gardener").alias("title"), F.lit("Acme").alias("company"), F.array(F.lit("did a")).alias("bullets")))
    return c.select(
        key.alias("candidate_id"), F.concat(F.lit("Nr "), key.cast("string"), F.lit(" sells")).alias("summary"), F.array(F.lit("Python"), F.lit("SQL"), F.lit("Security Tableau")).alias("skills"),
        pick("Needs: H1B visa", "Citizen", "Citizen").alias("work_authorization"), F.array(F.struct(pick("BSc Bachelor", "PhD", "none").alias("degree"))).alias("education"),
        (key % 13 + 2).cast("int").alias("total_years"), work.alias("work_history"),
    )


_texts = "(SELECT c_custkey, 0 AS ord, 2 AS w, 'Nr ' || c_custkey || ' sells' AS t FROM customer UNION ALL SELECT c_custkey, 1, 1, 'Python' FROM customer UNION ALL SELECT c_custkey, 2, 1, 'SQL' FROM customer UNION ALL SELECT c_custkey, 3, 1, 'Security Tableau' FROM customer UNION ALL SELECT c_custkey, 9, 3, CASE c_custkey % 4 WHEN 0 THEN 'Data Scientist' WHEN 2 THEN 'Treasury Analyst' ELSE 'Gardener' END FROM customer)"
_votes = f"vo AS (SELECT c_custkey, d, sum(w) AS w, min(ord) AS f FROM (SELECT *, {DOMAIN_SQL('t')} AS d FROM {_texts} x) y WHERE d <> 'unknown' GROUP BY 1, 2), vd AS (SELECT c_custkey, arg_max(d, w * 100 - f) AS user_domain FROM vo GROUP BY 1)"
_cd = f"""{_votes}, cd AS (SELECT c_custkey AS candidate_id, [c_custkey % 7 + 1, c_custkey % 5 + 1, c_custkey % 3 + 1, 1] AS embedding, c_custkey % 3 = 0 AS needs, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 0 END AS user_degree_rank, c_custkey % 13 + 2 AS user_years,
  ['python', 'sql', 'security tableau'] AS user_skills, coalesce(user_domain, 'unknown') AS user_domain, CASE WHEN c_custkey % 13 + 2 <= 4 THEN 'mid' WHEN c_custkey % 13 + 2 <= 8 THEN 'senior' ELSE 'director' END AS user_seniority FROM customer LEFT JOIN vd USING (c_custkey) WHERE {ASKED})"""
_je = "je AS (SELECT job_id AS vec_id, [job_id % 7 + 1, job_id % 5 + 1, job_id % 3 + 1, 1] AS embedding FROM j WHERE source_id <> 'src7' AND job_id IN (SELECT job_id FROM lk JOIN lo ON location_id = id WHERE country_code = 'QA'))"
_base = ORACLES["o96_match_pipeline"].split("\n  SELECT candidate_id, job_id, final_score, round(skill")[0]
_base = _base.replace(CANDIDATES, f"{LINKS_SQL}, {_cd}").replace(", rk AS (", f", {_je}, rk AS (").replace("embeddings e JOIN", "je e JOIN").replace(f"cosine_score >= {MINIMUM}", f"cosine_score >= {LEAST}")
_labels = "CASE WHEN contains(title, 'Engineer') THEN 'yes' WHEN contains(title, 'Gardener') THEN 'stretch' WHEN contains(title, 'Sales') THEN NULL ELSE 'maybe' END"
SQL = f"""{_base}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY final_score DESC, rank) AS n FROM s),
  l AS (SELECT r.* EXCLUDE (rank), j.source_id, CASE WHEN n <= {WINDOW} THEN {_labels} END AS label FROM r JOIN j USING (job_id)),
  a AS (SELECT *, round(final_score + CASE label WHEN 'yes' THEN 0.015::DOUBLE WHEN 'stretch' THEN -0.015::DOUBLE ELSE 0.0::DOUBLE END, 8) AS adjusted_score FROM l),
  t AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY n > {WINDOW}, CASE WHEN n <= {WINDOW} THEN -adjusted_score END, CASE WHEN n <= {WINDOW} THEN -final_score END, n) AS place FROM a),
  pl AS (SELECT job_id, count(*) AS n_places, arg_min(display_name, (NOT is_primary, created_at, display_name)) AS first_place FROM lk JOIN lo ON location_id = id GROUP BY 1)"""


def _recommended(spark, sf_dir):
    plain = jobs(spark, sf_dir)
    rows = _match_jobs(spark, sf_dir, "source_id", held=lambda known: bounded(staged(known, "titles"))).withColumn("min_degree_level", F.lit("none"))
    sources = plain.where("source_id <> 'src7'").select(F.col("source_id").alias("id"), F.lit("lever").alias("platform"), F.col("source_id").alias("identifier")).distinct()
    one = plain.select("job_id", *(F.lit(x).alias(c) for c, x in TARGET.items()), _vector(F.col("job_id")).alias("embedding"))
    old = one.withColumn("embedding_target_revision", F.lit(1)).withColumn("embedding", F.array(*[F.lit(1.0).cast("float")] * 4))
    lk, lo = links(spark, sf_dir)
    lk = lk.withColumn("is_primary", F.coalesce("is_primary", F.lit(False)))
    root = f"{shared_folder(spark)}/recommend-{uuid.uuid4().hex}"
    return W.recommend(_profiles(spark, sf_dir), rows, one.unionByName(old), sources, lk, lo, _embed, TARGET, root, "qa", judge=_judge, minimum=LEAST, window=WINDOW, digits=8)


@query(f"""{SQL} SELECT candidate_id, job_id, place, label, adjusted_score, 'lever:' || source_id AS source, n_places, first_place FROM t JOIN pl USING (job_id) WHERE place <= 50""")
def o96_o58_recommend(spark, sf_dir):
    """Profiles, sources, embedding target, country, nested places and labels each decide on some result."""
    got = _recommended(spark, sf_dir)[0]
    return got.select("candidate_id", "job_id", "place", "label", "adjusted_score", "source", F.size("locations").alias("n_places"), F.get("locations", F.lit(0))["display_name"].alias("first_place"))


@query(f"""{SQL} SELECT cd.candidate_id, cd.user_domain, cd.user_seniority, cd.user_degree_rank, (SELECT count(*) FROM rk WHERE rk.candidate_id = cd.candidate_id) AS after_prefilter,
  (SELECT count(*) FROM rk WHERE rk.candidate_id = cd.candidate_id AND cosine_score >= {LEAST}) AS after_threshold, (SELECT count(*) FROM s WHERE s.candidate_id = cd.candidate_id) AS after_hard_filter,
  (SELECT count(*) FROM t WHERE t.candidate_id = cd.candidate_id AND place <= 50) AS results_returned, (SELECT count(label) FROM t WHERE t.candidate_id = cd.candidate_id AND place <= 50) AS labelled FROM cd""")
def o96_recommend_meta(spark, sf_dir):
    got = _recommended(spark, sf_dir)[1]
    return got.select("candidate_id", "user_domain", "user_seniority", "user_degree_rank", "after_prefilter", "after_threshold", "after_hard_filter", "results_returned", "labelled")
