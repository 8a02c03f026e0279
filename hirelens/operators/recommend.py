"""From candidates' profiles to recommended jobs: one job for a whole table of profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.functions import normalize as N
from hirelens.functions import vocabulary as V
from hirelens.operators import embeddings as E
from hirelens.operators import ledger as G
from hirelens.operators import matching as M
from hirelens.operators import records as R
from hirelens.operators import requirements as Q
from hirelens.operators import texts as X
from hirelens.operators.calls import call_once
from hirelens.sources.store import bounded, staged

USER_CHARS = 4000
# What a text of a profile weighs for its domain.
SUMMARY_VOTE, SKILL_VOTE, TITLE_VOTE = 2, 1, 3
PLACE_FIELDS = ("source_raw", "workplace_type", "remote_scope", "is_primary", "city", "region", "country_code", "display_name")

#: What is asked of a job to mark and score its pairs; the rest that results show of it is joined to them last.
SCORED = ("sponsorship_not_available", "min_degree_rank", "jd_experience_years", "job_domain", *M.JOB_TERMS)


def profile_domains(profiles: DataFrame) -> DataFrame:
    """(candidate_id, domain) of `profiles` (candidate_id, summary, skills, work_history) by the votes of their summary,
    skills and titles; of equal ones the first of these counts."""
    vote = lambda weight, text, first, i: F.struct((F.lit(first) + i).alias("ordinal"), F.lit(weight).alias("weight"), text.alias("text"))
    none = F.array().cast("array<struct<ordinal:int,weight:int,text:string>>")
    skills = F.coalesce(F.transform("skills", lambda x, i: vote(SKILL_VOTE, x, 1, i)), none)
    titles = F.coalesce(F.transform("work_history", lambda x, i: vote(TITLE_VOTE, x["title"], 1 << 20, i)), none)
    votes = profiles.select("candidate_id", F.explode(F.concat(F.array(vote(SUMMARY_VOTE, F.col("summary"), 0, F.lit(0))), skills, titles)).alias("v")).select("candidate_id", "v.*")
    return M.domain_vote(N.with_domain(votes, "text", "domain"), "candidate_id")


def candidates_of(profiles: DataFrame, embed: Callable[[list[str]], list[list[float]]], target: dict, root: str, needs_sponsorship: bool | None = None, max_chars: int = USER_CHARS, parallel: int = 8, batch: int = 32) -> DataFrame:
    """`profiles` (as `files.scan_profiles` gives them) with what a match asks of a candidate, and the embedding of their
    text, asked for once per text. needs_sponsorship: for all of them, whatever their profiles say (None: as they say)."""
    model = "|".join(str(target[c]) for c in G.TARGET)
    texts = X.candidate_texts(profiles, max_chars).withColumn("call_key", F.sha2(F.concat(F.lit(f"{model}\n"), "text"), 256))
    texts = staged(texts, "profile-texts")
    answers, _ = call_once(texts.select("call_key", "text"), lambda rows: embed([r["text"] for r in rows]), root, "array<float>", batch, parallel)
    vectors = E.valid_vectors(texts.join(answers, "call_key"), "answer", target["embedding_dim"]).where("valid").select("candidate_id", F.col("answer").alias("embedding"))
    features = X.candidate_features(profiles).join(profile_domains(profiles).withColumnRenamed("domain", "user_domain"), "candidate_id")
    if needs_sponsorship is not None:
        features = features.withColumn("needs_sponsorship", F.lit(needs_sponsorship))
    return profiles.select("candidate_id", "summary", "work_history").join(features, "candidate_id").join(vectors, "candidate_id")


def places_of(jobs: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """(job_id, locations) of `jobs` (job_id): structs of PLACE_FIELDS, the primary one first, then as they were added."""
    met = links.join(jobs.select("job_id").distinct(), "job_id", "left_semi").join(places.withColumnRenamed("id", "location_id"), "location_id", "left")
    full = met.select("job_id", "created_at", *(F.col(c) if c in met.columns else F.lit(None).cast("string").alias(c) for c in PLACE_FIELDS))
    return R.nested(full, "job_id", ["NOT is_primary", "created_at", "display_name"], list(PLACE_FIELDS), "locations", jobs.select("job_id").distinct())


def recommend(
    profiles: DataFrame, jobs: DataFrame, held: DataFrame, sources: DataFrame, links: DataFrame, places: DataFrame, embed: Callable[[list[str]], list[list[float]]], target: dict, root: str,
    country: str | None = None, needs_sponsorship: bool | None = None, judge: Callable[[list[str]], list[str | None]] | None = None,
    minimum: float = V.MIN_COSINE, k: int = V.TOP_K, top_n: int = V.TOP_N, window: int = 20, max_gap: int = 1, digits: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """(results, meta) for `profiles`.

    jobs: as for `matching.match`, with source_id and what results show; held: embeddings of any targets; sources: id,
    platform, identifier; links, places: jobs' locations and what these are. From the k nearest eligible jobs of a known
    source, with an embedding of `target` and, if `country` is given, a place there, those are left that reach `minimum`
    and whose experience isn't out of reach; they are scored, `judge` (payloads to labels, once per payload) may reorder
    the first `window`, and top_n are returned with source, nested locations and scores. meta: a row per candidate, with
    its features and how many jobs each stage left.

    Recall reads of a job only what it asks for. What the later stages need of a job or a candidate alone (tokens, places,
    its part of a payload) is worked out once for each of those that were found, and not for each pair.
    """
    people = staged(candidates_of(profiles, embed, target, f"{root}/profiles", needs_sponsorship), "people")
    key = N.source_key(F.col("platform"), F.col("identifier"))
    live = jobs.join(bounded(staged(sources.select(F.col("id").alias("source_id"), key.alias("source")), "sources")), "source_id")
    places, there = bounded(staged(places, "places")), None
    if country is not None:
        inside = places.where(F.upper("country_code") == country.strip().upper()).select(F.col("id").alias("location_id"))
        there = links.join(inside, "location_id", "left_semi").select("job_id").distinct()
    near = staged(M.recall(people, live, G.active_target(held, target), k, countries=there), "near")
    passed, counts = M.cosine_threshold(near, minimum)
    asked = people.drop("embedding", "summary", "work_history")
    found = staged(M.with_job_terms(live.join(bounded(staged(passed.select("job_id").distinct(), "found-ids")), "job_id", "left_semi")), "found")
    full = passed.join(bounded(found.select("job_id", *SCORED)), "job_id").join(bounded(asked), "candidate_id")
    # scored and, where meta is read, counted: joined anew for that, of what the counts ask for, rather than written in between
    marked = M.reject_reasons(full.withColumns({"needs_sponsorship": F.lit(False), "__rank": F.col("user_degree_rank"), "user_degree_rank": F.lit(-1)}), max_gap).withColumn("user_degree_rank", F.col("__rank")).drop("__rank")
    # labels move rows of the window only, so what comes behind it and behind top_n is in no result
    ranked = staged(M.rerank(marked.where("size(reasons) = 0").drop("reasons"), max(top_n, window), digits).drop("rank").withColumnRenamed("place", "rank"), "ranked")
    nested = bounded(staged(places_of(ranked, links, places), "nested"))
    labels = ranked.select("candidate_id", "job_id", F.lit(None).cast("string").alias("label")).where("false")
    if judge is not None:
        first = ranked.where(F.col("rank") <= window)
        shown = found.join(first.select("job_id").distinct(), "job_id", "left_semi").join(nested, "job_id")
        jobs_shown = staged(shown.select("job_id", Q.job_profile(shown).alias("job_profile")), "job-profiles")
        people_shown = staged(people.select("candidate_id", Q.candidate_profile(people).alias("candidate_profile")), "candidate-profiles")
        shown = first.join(bounded(jobs_shown), "job_id").join(bounded(people_shown), "candidate_id")
        payloads = staged(Q.model_payloads(shown).withColumn("call_key", F.sha2("payload", 256)), "payloads")
        answers, _ = call_once(payloads.select("call_key", "payload"), lambda rows: judge([r["payload"] for r in rows]), f"{root}/labels")
        labels = bounded(staged(payloads.join(answers, "call_key").select("candidate_id", "job_id", F.col("answer").alias("label")), "labels"))
    results = staged(M.label_rerank(ranked, labels, window, digits).where(F.col("place") <= top_n), "results")
    with_places = results.join(found.drop(*SCORED), "job_id").join(nested, "job_id")
    after = marked.groupBy("candidate_id").agg(F.count_if(F.size("reasons") == 0).alias("after_hard_filter"), *(F.count_if(F.array_contains("reasons", r)).alias(f"rejected_{r}") for r in ("sponsorship", "degree", "experience")))
    returned = results.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("results_returned"), F.count_if("enriched").alias("labelled"))
    stages = counts.select("candidate_id", F.col("n_input").alias("after_prefilter"), F.col("n_passed").alias("after_threshold")).join(after, "candidate_id", "left").join(returned, "candidate_id", "left")
    own = asked.select("candidate_id", "needs_sponsorship", "user_degree_rank", "user_domain", "user_seniority", "user_years", F.size("user_skills").alias("user_skill_count"))
    return with_places, own.join(stages, "candidate_id", "left").na.fill(0, [c for c in stages.columns if c != "candidate_id"])
