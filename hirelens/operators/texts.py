"""Texts to embed, of postings and candidates, and what a candidate's profile tells."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions import normalize as N
from hirelens.functions import vocabulary as V

MAX_CHARS = 2200


HEADINGS = {label: re.compile(pattern, re.I).fullmatch for label, pattern in V.SECTION_HEADINGS.items()}
DROPPED = re.compile(rf"\b(?:{'|'.join(V.DROPPED_LINES)})\b", re.I).search
BLANKS, BESIDE = re.compile(r"\s+"), re.compile(r"[^a-z0-9#+./ ]+")
EVIDENCE = "struct<" + ", ".join(f"{label}: array<string>" for label in V.SECTION_LINES) + ">"
#: Characters of descriptions whose lines are held as a table at once.
TOGETHER = 4_000_000


def _key(text: str) -> str:
    return " ".join(BESIDE.sub(" ", text.lower()).split())


@lru_cache(200_000)
def _line(raw: str) -> tuple[str, str | None, str, bool, int, tuple[int, ...]]:
    """(line, section that it heads, key, whether it is dropped, its points, points for each domain) of a raw line."""
    line = BLANKS.sub(" ", raw.strip().lstrip("-*• ").strip())
    bare = line.lstrip("#*-_ ").rstrip(":*-_ ").strip()
    head = next((label for label, fits in HEADINGS.items() if fits(bare)), None)
    key = _key(line)
    points = sum(any(w in key for w in words) for words in (V.ACTION_WORDS, V.ABILITY_WORDS))
    return line, head, key, bool(DROPPED(line)), points, tuple(2 * sum(h in key for h in hints) for hints in V.DOMAIN_HINTS.values())


def _evidence(rows: pd.DataFrame) -> list[dict[str, list[str]]]:
    """Of each row (description, required, preferred, domain) its sections' lines, all rows' lines as one table."""
    lines = pd.DataFrame([(i, *_line(raw)) for i, text in enumerate(rows["description"]) for raw in (text or "").splitlines()], columns=["row", "line", "head", "key", "dropped", "points", "hints"])
    out: list[dict[str, list[str]]] = [{label: [] for label in V.SECTION_LINES} for _ in range(len(rows))]
    lines = lines[lines["line"] != ""].reset_index(drop=True)
    if lines.empty:
        return out
    heads = lines["head"].notna()
    lines["block"] = (heads | (lines["row"] != lines["row"].shift())).cumsum()
    lines["label"] = lines.groupby("block")["head"].transform("first").fillna("body")
    lines = lines[~heads & ~lines["dropped"] & lines["label"].isin(V.SECTION_LINES)]
    # keys of a row's skills, once for the row
    listed = [[(k, points) for skills, most, points in ((r.required, 12, 4), (r.preferred, 8, 2)) for s in ([] if skills is None else skills[:most]) if s is not None and (k := _key(s))] for r in rows.itertuples()]
    domains = {name: k for k, name in enumerate(V.DOMAIN_HINTS)}
    place = [domains.get(d, -1) for d in rows["domain"]]
    lines["score"] = [p + (h[place[i]] if place[i] >= 0 else 0) + sum(n for k, n in listed[i] if k in key) for i, key, p, h in zip(lines["row"], lines["key"], lines["points"], lines["hints"], strict=True)]
    # best lines of a block first, then as they stand
    lines = lines.sort_values(["block", "score"], ascending=[True, False], kind="stable")
    limit = lines["label"].map(V.SECTION_LINES)
    sizes = lines.groupby("block").agg(row=("row", "first"), label=("label", "first"), size=("row", "size"))
    before = sizes.groupby(["row", "label"])["size"].cumsum() - sizes["size"]
    # a block adds lines until the section is full, and one at least even if it is
    room = (limit - lines["block"].map(before)).clip(lower=1)
    kept = lines[lines.groupby("block").cumcount() < room]
    kept = kept[kept["key"] != ""].drop_duplicates(["row", "label", "key"])
    kept = kept[kept.groupby(["row", "label"]).cumcount() < kept["label"].map(V.SECTION_LINES)]
    for row, label, line in zip(kept["row"], kept["label"], kept["line"], strict=True):
        out[row][label].append(line)
    return out


def evidence(description: Column, required: Column, preferred: Column, domain: Column) -> Column:
    """A struct of each kept section's lines that say most of the job, at most SECTION_LINES. Headings carry down to the
    lines below them, lines are ranked within their block by score, then place, and blocks of one section fill it in
    order: one pass over an Arrow batch's lines as a table, without an exchange. Null lists have no skills."""

    def select(texts: pd.Series, required: pd.Series, preferred: pd.Series, domains: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame({"description": texts, "required": required, "preferred": preferred, "domain": domains})
        cut = (texts.str.len().fillna(0).cumsum() // TOGETHER).astype(int)
        return pd.DataFrame([x for _, some in rows.groupby(cut, sort=True) for x in _evidence(some)], columns=[*V.SECTION_LINES])

    return F.pandas_udf(select, EVIDENCE)(description, required, preferred, domain)


def evidence_lines(postings: DataFrame) -> DataFrame:
    """(job_id, label, lines) of `postings` (job_id, description, required_skills, preferred_skills, job_domain), of
    sections with lines; see `evidence`."""
    found = postings.select("job_id", evidence(*map(F.col, ("description", "required_skills", "preferred_skills", "job_domain"))).alias("e"))
    each = F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"e.{label}").alias("lines")) for label in V.SECTION_LINES))
    return found.select("job_id", F.explode(each).alias("x")).select("job_id", "x.*").where("size(lines) > 0")


def job_texts(postings: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(job_id, text) to embed of `postings` (as for `evidence_lines`, and title, seniority_level). Longer texts are cut
    and end with an ellipsis."""
    got = postings.withColumn("__e", evidence(*map(F.col, ("description", "required_skills", "preferred_skills", "job_domain"))))
    skills = F.array_join(F.slice("required_skills", 1, 10), ", ")
    parts = [
        F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("Title: "), N.strip(F.col("title")))),
        F.when(F.coalesce("job_domain", F.lit("unknown")) != "unknown", F.concat(F.lit("Domain: "), F.replace("job_domain", F.lit("_"), F.lit(" ")))),
        F.concat(F.lit("Seniority: "), F.nullif("seniority_level", F.lit(""))),
        F.when(skills != "", F.concat(F.lit("Required skills: "), skills)),
        *(F.when(F.size(f"__e.{x}") > 0, F.concat(F.lit(f"{t}:\n- "), F.array_join(f"__e.{x}", "\n- "))) for x, t in V.SECTION_TITLES.items()),
    ]
    made = got.select("job_id", N.strip(F.concat_ws("\n\n", *parts)).alias("text"))
    cut = F.concat(F.rtrim(F.substring("text", 1, max_chars - 1)), F.lit("…"))
    return made.select("job_id", F.when(F.length("text") <= max_chars, F.col("text")).otherwise(cut).alias("text"))


def candidate_texts(candidates: DataFrame, max_chars: int) -> DataFrame:
    """(candidate_id, text) to embed of `candidates` (candidate_id, summary, skills, work_history of title, company,
    bullets)."""
    tidy = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), N.strip), lambda x: x.isNotNull() & (x != ""))
    one = lambda w: F.concat_ws(" | ", N.clean(w["title"]), N.clean(w["company"]), F.nullif(F.array_join(tidy(w["bullets"]), " "), F.lit("")))
    held = F.filter(F.transform(F.coalesce("work_history", F.array().cast(candidates.schema["work_history"].dataType)), one), lambda x: x != "")
    work = F.array_join(F.transform(held, lambda x: F.concat(F.lit("- "), x)), "\n")
    text = F.concat(F.lit("User Summary:\n"), F.coalesce(N.strip(F.col("summary")), F.lit("")), F.lit("\n\nSkills:\n"), F.array_join(tidy(F.col("skills")), ", "), F.lit("\n\nWork Highlights:\n"), work)
    return candidates.select("candidate_id", F.substring(N.strip(text), 1, max_chars).alias("text"))


def candidate_features(candidates: DataFrame) -> DataFrame:
    """(candidate_id, needs_sponsorship, user_degree_rank, user_skills, user_years, user_seniority) of `candidates`
    (candidate_id, work_authorization, education of degree, skills, total_years, work_history of title)."""
    says = F.lower(N.strip(F.coalesce("work_authorization", F.lit(""))))
    ranks = F.transform(F.col("education"), lambda e: N.degree_rank(N.degree_level(F.coalesce(e["degree"], F.lit("")))))
    skills = F.array_distinct(F.filter(F.transform(F.coalesce("skills", F.array().cast("array<string>")), N.skill_token), lambda t: t.isNotNull() & (t != "")))
    levels = F.filter(F.transform("work_history", lambda w: N.seniority(w["title"], F.lit(None).cast("int"))), lambda x: x.isNotNull())
    return candidates.select(
        "candidate_id", N.contains_any(says, V.NEEDS_SPONSORSHIP).alias("needs_sponsorship"), F.greatest(F.lit(-1), F.coalesce(F.array_max(ranks), F.lit(-1))).alias("user_degree_rank"),
        skills.alias("user_skills"), F.coalesce("total_years", F.lit(0)).alias("user_years"),
        F.when(F.col("total_years").isNotNull(), N.seniority_of_years(F.col("total_years"))).otherwise(F.get(levels, F.lit(0))).alias("user_seniority"),
    )
