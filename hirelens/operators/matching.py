"""Recommendation for a whole table of candidates: recall, threshold, hard filter, weighted rerank."""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelens.functions import normalize as N
from hirelens.functions import vocabulary as V
from hirelens.sources.store import Objects, bounded, fresh_folder, staged

#: Vectors that cells and first bounds are fitted on, at most; cells; vectors of a task and candidates of a block, in
#: bytes; scores that are held at once.
SAMPLE, CELLS, PART_BYTES, BLOCK_BYTES, TILE = 4096, 64, 64_000_000, 16_000_000, 1_000_000
#: Pairs that a task writes when equal candidates get their shared ones; rows that it holds to find the first of equals.
TASK_PAIRS, EQUALS = 2_000_000, 1_000_000


def _unit(vectors: pa.ListArray) -> np.ndarray:
    """Unit vectors as rows of a matrix; every one has as many numbers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def eligible(sponsorship: np.ndarray, degree: np.ndarray, needs: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which jobs (columns) may be shown to which candidates (rows): without a sponsorship bar for who needs it, and
    within the degree of who has one. sponsorship: 1 if it is known to be no bar."""
    return (~needs[:, None] | sponsorship[None, :]) & ((rank[:, None] < 0) | (degree[None, :] <= rank[:, None]))


@dataclass(frozen=True)
class Cells:
    """Centres of cells, and how far a cell's vectors are from its centre at most."""

    centres: np.ndarray
    radius: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its centre) of unit vectors."""
        cell = (x @ self.centres.T - 0.5 * (self.centres**2).sum(axis=1)).argmax(axis=1)
        return cell, np.linalg.norm(x - self.centres[cell], axis=1)


def fit_cells(sample: np.ndarray, cells: int = CELLS, rounds: int = 8) -> np.ndarray:
    """Centres of a bounded sample of unit vectors, by k-means from vectors spread over it."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        own = (sample @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Best:
    """The k best (score, id) of each of n rows; ties by id."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.score, self.ids, self.least = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), least.copy()

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        beats = (score >= self.least[rows, None]) & (score > -np.inf)
        some, at = beats.any(axis=1), beats.any(axis=0)
        rows, score, ids = rows[some], score[np.ix_(some, at)], ids[at]
        if not len(rows):
            return
        both = np.concatenate((self.score[rows], score), axis=1)
        named = np.concatenate((self.ids[rows], np.broadcast_to(ids, score.shape)), axis=1)
        at = np.lexsort((named, -both), axis=1)[:, : self.k]
        self.score[rows], self.ids[rows] = np.take_along_axis(both, at, 1), np.take_along_axis(named, at, 1)
        self.least[rows] = np.maximum(self.least[rows], self.score[rows, -1])


def search(x: np.ndarray, allowed: Callable[[np.ndarray, slice], np.ndarray], least: np.ndarray, held: dict[int, tuple[np.ndarray, np.ndarray, slice]], cells: Cells, k: int, digits: int, tile: int = TILE) -> tuple[Best, int, int]:
    """(best of each of the unit vectors `x`, pairs of a vector of `x` and a cell, those that were passed over).

    held: of each cell (ids, unit vectors, their place). By the triangle inequality no vector of a cell has a higher score
    than the centre's and the radius; a cell that can't beat a row's k-th score so far, or `least`, is passed over.
    """
    best, seen, passed = Best(len(x), k, least), 0, 0
    bound = x @ cells.centres.T + cells.radius
    for cell in sorted(held, key=lambda c: -bound[:, c].mean()):
        ids, vectors, place = held[cell]
        rows = np.flatnonzero(bound[:, cell] >= best.least - 10.0**-digits)
        seen, passed = seen + len(x), passed + len(x) - len(rows)
        step = max(1, tile // max(1, len(rows)))
        for i in range(0, len(vectors), step):
            for j in range(0, len(rows), tile):
                some, at = rows[j : j + tile], slice(place.start + i, place.start + min(i + step, len(vectors)))
                score = np.round(x[some] @ vectors[i : i + step].T, digits)
                best.add(some, np.where(allowed(some, at), score, -np.inf), ids[i : i + step])
    return best, seen, passed


def top_k(candidates: DataFrame, vectors: DataFrame, k: int = V.TOP_K, digits: int = 6, counts: tuple | None = None) -> DataFrame:
    """(candidate_id, job_id, cosine_score, rank) of the k nearest of `vectors` (job_id, embedding, ...) to each of
    `candidates` (candidate_id, embedding, ...), exact.

    Of jobs that a candidate may not be shown (`eligible`, by needs_sponsorship and user_degree_rank of candidates,
    sponsorship_not_available and min_degree_rank of vectors; what is not there bars nothing) none is counted, so k
    eligible ones are found. Rows without a vector, or of another length than the candidates', are left out. Scores are
    rounded before ranking; ties by job_id.

    Vectors are put in lists by k-means cell, fitted on at most SAMPLE of them, and dealt to tasks of PART_BYTES. The
    candidates are a table of blocks of BLOCK_BYTES in the shared folder, with a lower bound of their k-th score from
    the sample; each task reads it block by block once, passing over cells that can't beat that bound or the k-th score
    so far, and holds TILE scores at a time. `counts`: two accumulators, of pairs of a candidate and a cell, and of
    those passed over.

    Equal vectors of equal rules score alike, so of these only the k of smallest job_id can be among the k nearest: where
    the sample says that this halves the vectors, the others are left out. Equal candidates of equal rules have the same
    k nearest: where that halves the candidates, these are searched for once and then given to each.
    """
    spark = candidates.sparkSession
    with_rules = {"needs_sponsorship", "user_degree_rank"} <= set(candidates.columns) and {"sponsorship_not_available", "min_degree_rank"} <= set(vectors.columns)
    needs, rank = (F.coalesce("needs_sponsorship", F.lit(False)), F.coalesce("user_degree_rank", F.lit(-1)).cast("int")) if with_rules else (F.lit(False), F.lit(-1))
    bar, degree = (F.coalesce(F.col("sponsorship_not_available") != "yes", F.lit(False)), F.coalesce("min_degree_rank", F.lit(-1)).cast("int")) if with_rules else (F.lit(True), F.lit(-1))
    asked = candidates.where("embedding IS NOT NULL").select(F.col("candidate_id").cast("long").alias("candidate_id"), "embedding", needs.alias("needs"), rank.alias("rank"))
    dim = asked.agg(F.max(F.size("embedding"))).first()[0] or 0
    whole = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    v = vectors.where(whole).select(F.col("job_id").cast("long").alias("job_id"), F.col("embedding").cast("array<double>").alias("embedding"), bar.alias("open"), degree.alias("degree"))
    v, asked = staged(v, "vectors"), asked.where(whole)
    sample = v.orderBy(F.xxhash64("job_id"), "job_id").limit(SAMPLE).toArrow().combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "candidate_id long, job_id long, cosine_score double, rank int")
    drawn = {"x": _unit(_column(sample, "embedding")), "open": _flags(sample, "open"), "degree": _column(sample, "degree").to_numpy(zero_copy_only=False)}
    centres = fit_cells(drawn["x"])
    if 2 * _left_of(sample, v.count(), k) <= 1:
        v = v.mapInArrow(_first_of_equals(k), v.schema).repartition(F.xxhash64("embedding", "open", "degree")).mapInArrow(_first_of_equals(k), v.schema)
    alike = ["embedding", "needs", "rank"]
    leads = staged(asked.groupBy(*alike).agg(F.min("candidate_id").alias("lead")), "leads")
    n_asked = asked.count()
    shared = 2 * leads.count() <= n_asked
    searched = leads.select(F.col("lead").alias("candidate_id"), *alike) if shared else asked

    def place(batches):
        cells = Cells(centres, np.zeros(len(centres)))
        for batch in batches:
            if batch.num_rows:
                cell, away = cells.nearest(_unit(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    placed = staged(v.mapInArrow(place, "job_id long, embedding array<double>, open boolean, degree int, cell long, away double"), "placed")
    found = {r.cell: r for r in placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # a row per cell
    n = sum(r.n for r in found.values())
    cells = Cells(centres, np.array([found[c].radius if c in found else -np.inf for c in range(len(centres))]))
    block = max(1, BLOCK_BYTES // (dim * 8 + 64))

    def bound(batches):
        for batch in batches:
            for some in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                score = np.round(_unit(some.column("embedding")) @ drawn["x"].T, digits)
                score[~eligible(drawn["open"], drawn["degree"], _flags(some, "needs"), some.column("rank").to_numpy(zero_copy_only=False))] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(score), -np.inf)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(least)], names=[*some.schema.names, "least"])

    folder = fresh_folder(spark, "candidates")
    searched.withColumn("embedding", F.col("embedding").cast("array<double>")).mapInArrow(bound, "candidate_id long, embedding array<double>, needs boolean, rank int, least double").write.option("maxRecordsPerFile", block).parquet(folder)
    parts = max(1, -(-n * (dim * 8 + 32) // PART_BYTES))
    dealt = placed.drop("away").repartitionByRange(parts, "cell", F.xxhash64("job_id")).sortWithinPartitions("cell")
    near = dealt.mapInArrow(_searcher(folder, cells, k, digits, counts), "candidate_id long, job_id long, cosine_score double")
    order = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("cosine_score"), "job_id"))
    best = near.withColumn("rank", order).where(F.col("rank") <= k)
    if not shared:
        return best
    lists = best.groupBy(F.col("candidate_id").alias("lead")).agg(F.collect_list(F.struct("job_id", "cosine_score", "rank")).alias("found"))  # k of each
    members = asked.join(leads, alike).select("candidate_id", "lead").repartition(max(spark.sparkContext.defaultParallelism, -(-n_asked * k // TASK_PAIRS)), "candidate_id")
    return members.join(bounded(staged(lists, "lists")), "lead").select("candidate_id", F.inline("found"))


def _first_of_equals(k: int, most: int = EQUALS):
    """Of the rows (job_id, embedding, open, degree) of a task the k of smallest job_id of each group that is equal in the
    rest; it holds about `most` rows, and gives out what it has and begins anew if these are not enough."""

    def first(code, ids):
        order = np.lexsort((ids, code))
        code, ids = code[order], ids[order]
        place = np.arange(len(code)) - np.maximum.accumulate(np.where(np.r_[True, code[1:] != code[:-1]], np.arange(len(code)), 0))
        return code[place < k], ids[place < k], (code[place == k - 1], ids[place == k - 1])

    def given(groups, code, ids, dim):
        keys = np.frombuffer(b"".join(groups), np.uint8).reshape(len(groups), dim * 8 + 5)
        for i in range(0, len(code), 10_000):
            some = keys[code[i : i + 10_000]]
            flat = np.ascontiguousarray(some[:, : dim * 8]).view(np.float64).reshape(-1)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(flat))
            degree = np.ascontiguousarray(some[:, dim * 8 + 1 :]).view(np.int32).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 10_000]), vectors, pa.array(some[:, dim * 8].astype(bool)), pa.array(degree)], names=["job_id", "embedding", "open", "degree"])

    def run(batches):
        groups, bar, codes, held, n, dim = {}, np.empty(0, np.int64), [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            dim, width = x.shape[1], x.shape[1] * 8 + 5
            parts = x.astype(np.float64), _flags(batch, "open").astype(np.uint8)[:, None], batch.column("degree").to_numpy(zero_copy_only=False).astype(np.int32)[:, None]
            keys = np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(batch.num_rows, -1) for p in parts], axis=1).tobytes()
            code = np.fromiter((groups.setdefault(keys[i : i + width], len(groups)) for i in range(0, len(keys), width)), np.int64, batch.num_rows)
            bar = np.r_[bar, np.full(len(groups) - len(bar), np.iinfo(np.int64).max)]
            ids = batch.column("job_id").to_numpy(zero_copy_only=False)
            low = ids < bar[code]  # below the k-th of its group so far
            codes, held, n = [*codes, code[low]], [*held, ids[low]], n + int(low.sum())
            if n > most or len(groups) * width > PART_BYTES:
                code, ids, (full, kth) = first(np.concatenate(codes), np.concatenate(held))
                bar[full] = kth
                if 2 * len(code) > most or len(groups) * width > PART_BYTES:
                    yield from given(groups, code, ids, dim)
                    groups, bar, code, ids = {}, np.empty(0, np.int64), code[:0], ids[:0]
                codes, held, n = [code], [ids], len(code)
        if n:
            code, ids, _ = first(np.concatenate(codes), np.concatenate(held))
            yield from given(groups, code, ids, dim)

    return run


def _left_of(sample: pa.Table, n: int, k: int) -> float:
    """The share that is left of `n` vectors if k of each group of equal ones are, judged by a sample; one that occurs once
    there counts as the only one."""
    x = np.ascontiguousarray(_column(sample, "embedding").flatten().to_numpy(zero_copy_only=False)).reshape(len(sample), -1)
    sizes = Counter((v.tobytes(), o, d) for v, o, d in zip(x, sample.column("open").to_pylist(), sample.column("degree").to_pylist(), strict=True))
    share = 1 / len(sample)
    return sum(min(k / n, m * share) if m > 1 else share for m in sizes.values())


def _column(t, name: str):
    c = t.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _flags(t, name: str) -> np.ndarray:
    return _column(t, name).to_numpy(zero_copy_only=False).astype(bool)


def _searcher(folder: str, cells: Cells, k: int, digits: int, counts: tuple | None):
    schema = pa.schema([("candidate_id", pa.int64()), ("job_id", pa.int64()), ("cosine_score", pa.float64())])

    def run(batches):
        own = [b for b in batches if b.num_rows]  # of one task's vectors
        if not own:
            return
        mine = pa.Table.from_batches(own).combine_chunks()
        ids, cell, degree = (_column(mine, c).to_numpy(zero_copy_only=False) for c in ("job_id", "cell", "degree"))
        x, open_ = _unit(_column(mine, "embedding")), _flags(mine, "open")
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
        held = {int(cell[a]): (ids[a:b], x[a:b], slice(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)}
        store = Objects(folder)
        for name in store.names(""):
            if not name.endswith(".parquet"):
                continue
            block = pq.read_table(io.BytesIO(store.get(name.lstrip("/"))))
            if not len(block):
                continue
            needs, rank = _flags(block, "needs"), _column(block, "rank").to_numpy(zero_copy_only=False)
            allowed = lambda rows, at: eligible(open_[at], degree[at], needs[rows], rank[rows])  # noqa: B023, E731
            best, seen, passed = search(_unit(_column(block, "embedding")), allowed, _column(block, "least").to_numpy(zero_copy_only=False), held, cells, k, digits)
            if counts:
                counts[0].add(seen)
                counts[1].add(passed)
            row, col = np.nonzero(np.isfinite(best.score) & (best.score >= _column(block, "least").to_numpy(zero_copy_only=False)[:, None]))
            people = _column(block, "candidate_id").to_numpy(zero_copy_only=False)
            for i in range(0, len(row), 200_000):
                r, c = row[i : i + 200_000], col[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(people[r]), pa.array(best.ids[r, c]), pa.array(best.score[r, c])], schema=schema)

    return run


def recall(candidates: DataFrame, jobs: DataFrame, embeddings: DataFrame, k: int = V.TOP_K, version: int = 3, countries: DataFrame | None = None) -> DataFrame:
    """Pairs (candidate_id, job_id, cosine_score, rank) of candidates and the k nearest eligible jobs.

    Only `jobs` with structured_jd_version of at least `version`, an embedding in `embeddings` (job_id, embedding; of
    the active target) and, if `countries` (job_id) is given, a place there take part.
    """
    live = jobs.where(F.coalesce("structured_jd_version", F.lit(0)) >= version)
    if countries is not None:
        live = live.join(countries, "job_id", "left_semi")
    return top_k(candidates, live.select("job_id", "sponsorship_not_available", "min_degree_rank").join(embeddings.select("job_id", "embedding"), "job_id"), k)


def match(candidates: DataFrame, jobs: DataFrame, embeddings: DataFrame, minimum: float = V.MIN_COSINE, k: int = V.TOP_K, top_n: int = V.TOP_N, max_gap: int = 1, digits: int = 6) -> DataFrame:
    """The best `top_n` jobs of each candidate, from recall to rerank.

    candidates: candidate_id, embedding, needs_sponsorship, user_degree_rank, user_years, user_skills, user_domain,
    user_seniority. jobs: job_id, title, sponsorship_not_available, min_degree_rank, jd_experience_years, job_domain,
    required_skills, preferred_skills, structured_jd_version and, if it is known, seniority_level. Eligibility comes
    before the k nearest, then the threshold, the gap in experience, the weighted score.
    """
    pairs = recall(candidates, jobs, embeddings, k).where(F.col("cosine_score") >= minimum)
    full = pairs.join(jobs, "job_id").join(candidates.drop("embedding"), "candidate_id")
    hard = reject_reasons(full.withColumns({"needs_sponsorship": F.lit(False), "__rank": F.col("user_degree_rank"), "user_degree_rank": F.lit(-1)}), max_gap)
    return rerank(hard.where(F.size("reasons") == 0).withColumn("user_degree_rank", F.col("__rank")).drop("__rank", "reasons"), top_n, digits)


def reject_reasons(pairs: DataFrame, max_gap: int = 1) -> DataFrame:
    """`pairs` with `reasons`: sponsorship, degree, experience; unknown values pass."""
    if max_gap < 0:
        raise ValueError("max_gap must be >= 0")
    rules = {
        "sponsorship": F.col("needs_sponsorship") & (F.lower(F.trim("sponsorship_not_available")) == "yes"),
        "degree": (F.col("min_degree_rank") >= 0) & (F.col("user_degree_rank") >= 0) & (F.col("min_degree_rank") > F.col("user_degree_rank")),
        "experience": F.col("jd_experience_years") > F.col("user_years") + max_gap,
    }
    return pairs.withColumn("reasons", F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules.items())), lambda x: x.isNotNull()))


def stage_summary(marked: DataFrame, by: str) -> DataFrame:
    reasons = ("sponsorship", "degree", "experience")
    return marked.groupBy(by).agg(F.count(F.lit(1)).alias("input_count"), F.count_if(F.size("reasons") == 0).alias("passed_count"), F.count_if(F.size("reasons") > 0).alias("rejected_count"), *(F.count_if(F.array_contains("reasons", r)).alias(f"rejected_{r}") for r in reasons))


JOB_TERMS = ("__level", "__required", "__preferred")


def with_job_terms(jobs: DataFrame) -> DataFrame:
    """`jobs` (or pairs) with what `rerank` works out of a job alone, JOB_TERMS: its level and its skills' tokens. Worked out
    before jobs are joined to pairs, it is done once a job."""
    level = N.seniority(F.col("title"), F.col("jd_experience_years"))
    if "seniority_level" in jobs.columns:
        level = F.coalesce(N.clean(F.col("seniority_level")), level)
    return jobs.withColumns({"__level": level, "__required": N.skill_tokens(F.col("required_skills")), "__preferred": N.skill_tokens(F.col("preferred_skills"))})


def rerank(pairs: DataFrame, top_n: int = V.TOP_N, digits: int = 6) -> DataFrame:
    """The best `top_n` of each candidate by weighted score, with the parts of the score.

    pairs: candidate_id, job_id, cosine_score, rank, title, jd_experience_years, min_degree_rank, job_domain,
    required_skills, preferred_skills, user_years, user_degree_rank, user_skills, user_domain, user_seniority; and
    JOB_TERMS, if they are worked out already.
    """
    if not set(JOB_TERMS) <= set(pairs.columns):
        pairs = with_job_terms(pairs)
    gap = F.greatest(F.lit(0), F.coalesce(F.col("jd_experience_years") - F.col("user_years"), F.lit(0)))
    education = F.greatest(F.lit(0), F.coalesce("min_degree_rank", F.lit(-1)) - F.col("user_degree_rank"))
    scored = (
        pairs.withColumn("skill_overlap_score", N.token_overlap(F.col("user_skills"), F.col("__required"), F.col("__preferred")))
        .withColumn("domain_match_score", N.domain_affinity(F.col("user_domain"), F.col("job_domain")))
        .withColumn("seniority_match_score", N.seniority_affinity(F.col("user_seniority"), F.col("__level")))
        .withColumns({"experience_gap": gap, "education_gap": education})
        .withColumn("experience_penalty", F.least(F.lit(V.EXPERIENCE_MOST), gap * V.EXPERIENCE_STEP))
        .withColumn("education_penalty", F.least(F.lit(V.EDUCATION_MOST), education * V.EDUCATION_STEP))
    )
    parts = {"cosine": "cosine_score", "skill": "skill_overlap_score", "domain": "domain_match_score", "seniority": "seniority_match_score"}
    parts = {name: F.lit(V.WEIGHTS[name]) * F.col(c) for name, c in parts.items()}
    lost = F.col("experience_penalty") + F.col("education_penalty")
    final = parts["cosine"] + parts["skill"] + parts["domain"] + parts["seniority"] - F.col("experience_penalty") - F.col("education_penalty")
    scored = scored.withColumns({
        "final_score": F.bround(final, digits),
        "score_breakdown": F.struct(*(F.bround(x, digits).alias(f"{name}_component") for name, x in parts.items())),
        "penalties": F.struct(F.bround("experience_penalty", digits).alias("experience_penalty"), F.bround("education_penalty", digits).alias("education_penalty"), F.bround(lost, digits).alias("total_penalty")),
    })
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("final_score"), "rank"))
    return scored.withColumn("place", place).where(F.col("place") <= top_n).drop(*JOB_TERMS)


def domain_vote(votes: DataFrame, by: str) -> DataFrame:
    """(by, domain) with most weight in `votes` (by, ordinal, weight, domain); ties go to the earliest; `unknown`
    votes don't count, and decide only where there is no other."""
    known = F.col("domain") != "unknown"
    each = votes.groupBy(by, "domain").agg(F.sum("weight").alias("w"), F.min("ordinal").alias("first"))
    order = F.struct(F.col("w").cast("double").alias("a"), (-F.col("first")).alias("b"))
    return each.groupBy(by).agg(F.coalesce(F.max_by(F.when(known, F.col("domain")), F.when(known, order)), F.lit("unknown")).alias("domain"))


#: What a label adds to a score.
LABEL_ADJUSTMENT = {"strong_yes": 0.03, "yes": 0.015, "maybe": 0.0, "stretch": -0.015, "no": -0.03}


def cosine_threshold(pairs: DataFrame, minimum: float) -> tuple[DataFrame, DataFrame]:
    """(pairs at or over `minimum`, candidate_id with n_input, n_passed and n_rejected). A null score is rejected."""
    if not 0 <= minimum <= 1:
        raise ValueError("a cosine threshold lies between 0 and 1")
    passed = F.coalesce(F.col("cosine_score") >= minimum, F.lit(False))
    counts = pairs.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_input"), F.count_if(passed).alias("n_passed"), F.count_if(~passed).alias("n_rejected"))
    return pairs.where(passed), counts


def label_rerank(ranked: DataFrame, labels: DataFrame, window: int, digits: int = 6) -> DataFrame:
    """`ranked` (candidate_id, job_id, final_score, rank, ...) with label, adjustment, adjusted_score, enriched,
    place and reorder_applied, which tells whether any of the candidate's rows changed places. Labels (candidate_id, job_id, label; one each) count for the first `window` ranks, which are sorted anew by
    adjusted and final score; the tail keeps its places. A row without a label keeps its score."""
    got = ranked.join(labels.select("candidate_id", "job_id", F.col("label").alias("__label")), ["candidate_id", "job_id"], "left")
    inside = F.col("rank") <= window
    label = F.when(inside, F.col("__label"))
    added = F.lit(0.0)
    for name, value in LABEL_ADJUSTMENT.items():
        added = F.when(F.col("label") == name, value).otherwise(added)
    got = got.withColumn("label", label).drop("__label").withColumn("adjustment", added)
    got = got.withColumn("adjusted_score", F.bround(F.col("final_score") + F.col("adjustment"), digits)).withColumn("enriched", F.col("label").isNotNull())
    order = [(~inside).cast("int"), F.when(inside, -F.col("adjusted_score")), F.when(inside, -F.col("final_score")), F.col("rank")]
    placed = got.withColumn("place", F.row_number().over(Window.partitionBy("candidate_id").orderBy(*order)))
    # a candidate has at most top_n ranked rows
    return placed.withColumn("reorder_applied", F.bool_or(F.col("place") != F.col("rank")).over(Window.partitionBy("candidate_id")))
