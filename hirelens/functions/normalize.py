"""Column expressions that bring free values into fixed terms. All are built-in functions: no Python per row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions import vocabulary as V

SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Stripped text; null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def contains_any(c: Column, markers: Iterable[str]) -> Column:
    """One pattern, and not a test for each marker: `c` then stands in the plan once, and its code stays small."""
    return F.coalesce(c.rlike("|".join(map(re.escape, markers))), F.lit(False))


def first_marked(c: Column, table: Mapping[str, Iterable[str]], otherwise: Column) -> Column:
    """The first key of `table` with a marker in `c`."""
    out = None
    for value, markers in table.items():
        test = contains_any(c, markers)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def sponsorship(c: Column) -> Column:
    """yes (not available), no or unknown."""
    t = F.lower(strip(c))
    return (
        F.when(t.isin(*V.SPONSORSHIP_EXACT["yes"]), "yes")
        .when(t.isin(*V.SPONSORSHIP_EXACT["no"]), "no")
        .when(contains_any(t, V.SPONSORSHIP_DENIED), "yes")
        .when(contains_any(t, V.SPONSORSHIP_OFFERED), "no")
        .otherwise("unknown")
    )


def job_domain(c: Column) -> Column:
    t = F.lower(strip(c))
    earlier = F.lit(None).cast("string")
    for old, new in V.EARLIER_DOMAINS.items():
        earlier = F.when(t == old, new).otherwise(earlier)
    return F.when(t.isin(*V.DOMAIN_MARKERS, "unknown"), t).otherwise(F.coalesce(earlier, first_marked(t, V.DOMAIN_MARKERS, F.lit("unknown"))))


def with_domain(rows: DataFrame, text: str, name: str, held: Callable[[DataFrame], DataFrame] = lambda known: known) -> DataFrame:
    """`rows` with the job domain of a text column, found once for each distinct text; null texts have `unknown`. `held`
    may put the texts' table where its size is known before the join, so that few texts don't deal all rows by text."""
    known = held(rows.select(F.col(text).alias("__text")).distinct().select("__text", job_domain(F.col("__text")).alias("__domain")))
    out = rows.join(known, rows[text] == known["__text"], "left").withColumn(name, F.coalesce("__domain", F.lit("unknown")))
    return out.drop("__text", "__domain")


def degree_level(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin(*V.DEGREE_RANK), t).otherwise(first_marked(t, V.DEGREE_MARKERS, F.lit("unknown")))


def degree_rank(level: Column) -> Column:
    out = F.lit(-1)
    for name, rank in V.DEGREE_RANK.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def seniority(title: Column, years: Column) -> Column:
    """From the title, else the years; null if neither tells."""
    t = F.lower(strip(F.coalesce(title, F.lit(""))))
    by_years = F.when(years <= 1, "junior").when(years >= 8, "senior").when(years.isNotNull(), "mid")
    return first_marked(t, V.SENIORITY_MARKERS, by_years)


def seniority_of_years(years: Column) -> Column:
    """A candidate's level."""
    return F.when(years <= 1, "junior").when(years <= 4, "mid").when(years <= 8, "senior").when(years.isNotNull(), "director")


def seniority_rank(level: Column) -> Column:
    return F.create_map(*(F.lit(x) for item in V.SENIORITY_RANK.items() for x in item))[level]


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of(value)`, where `value` is computed once however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def employment_type(c: Column) -> Column:
    """A canonical term; null if blank, `other` if no rule fits."""

    def term(t: Column) -> Column:
        exact = F.lit(None).cast("string")
        for label, value in V.EMPLOYMENT_EXACT.items():
            exact = F.when(t == label, value).otherwise(exact)
        rules = None
        for needle, value in V.EMPLOYMENT_CONTAINS.items():
            rules = F.when(t.contains(needle), value) if rules is None else rules.when(t.contains(needle), value)
        return F.when(t.isNotNull(), F.coalesce(exact, F.when(t.contains("full") & t.contains("part"), "mixed").when(t.rlike(r"\btemp\b"), "temporary").otherwise(rules.otherwise("other"))))

    spelt = F.regexp_replace(F.lower(clean(c)), r"[_/-]+", " ")
    return let(F.trim(F.regexp_replace(F.regexp_replace(spelt, r"(?U)[^a-z0-9\s&+-]", " "), SPACE, " ")), term)


def flexible_timestamp(c: Column) -> Column:
    """Seconds or milliseconds since 1970 (as a number or its text), or ISO 8601; else null."""

    def moment(x: Column) -> Column:
        t, n = x["t"], x["n"]
        seconds = F.when(n > 1e11, n / 1000).otherwise(n)
        return F.when(n.isNotNull(), F.timestamp_micros((seconds * 1e6).try_cast("bigint"))).otherwise(F.try_to_timestamp(t))

    return let(F.trim(c.cast("string")), lambda t: let(F.struct(t.alias("t"), t.try_cast("double").alias("n")), moment))


def best_int(c: Column, default: int | None = None) -> Column:
    """A number, or its text, cut to an integer; else the default."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("double").try_cast("int"), F.lit(default).cast("int"))


def skill_token(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", " "))


def skill_text(c: Column) -> Column:
    t = F.regexp_replace(F.lower(c), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[_/.-]+", " "), SPACE, " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def location_key(country: Column, region: Column, city: Column) -> Column:
    """country-region-city as slugs, without the parts that are missing; `unknown` if all are."""
    parts = [F.nullif(slug(c), F.lit("")) for c in (country, region, city)]
    return F.coalesce(F.nullif(F.concat_ws("-", *parts), F.lit("")), F.lit("unknown"))


def display_name(city: Column, region: Column, country: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(", ", *(clean(c) for c in (city, region, country))), F.lit("")), F.lit("Unknown"))


def workplace(hints: Column, default: str | None = None) -> Column:
    """remote before hybrid before onsite, over an array of hints."""
    found = lambda t: F.when(t.contains("remote"), "remote").when(t.contains("hybrid"), "hybrid").when(t.contains("onsite") | t.contains("on-site") | t.contains("on site"), "onsite")
    return let(F.lower(F.concat_ws(" ", hints)), lambda t: found(t).otherwise(F.lit(default).cast("string")))


def source_key(platform: Column, identifier: Column) -> Column:
    return F.concat_ws(":", platform, F.trim(identifier))


LINES, YEARS = V.LINES, V.YEARS


def experience(text: Column) -> Column:
    """struct(years, lines): the largest of the low bounds in lines about experience, and the first two such lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINES), strip), lambda x: contains_any(F.lower(x), V.EXPERIENCE_CONTEXT) & x.rlike(YEARS))
    lows = F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(YEARS), F.lit(1)), lambda y: y.cast("int"))))
    return F.struct(F.array_max(lows).alias("years"), F.slice(F.array_distinct(lines), 1, 2).alias("lines"))


def clean_list(values: Column, cap: int | None = None) -> Column:
    """Stripped, without blanks; of values that differ in case only the first."""
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))
    lowered = F.transform(kept, F.lower)
    out = F.filter(kept, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return out if cap is None else F.slice(out, 1, cap)


def content_fingerprint(title: Column, description: Column) -> Column:
    """cfp:v1: and the SHA-256 of title and description with white space collapsed, as JSON with sorted keys."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))
    return F.concat(F.lit("cfp:v1:"), F.sha2(F.to_json(F.struct(tidy(description).alias("description_plain"), tidy(title).alias("title"))), 256))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def skill_tokens(skills: Column) -> Column:
    """The distinct tokens of a list of skills; none of a null list."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(skills, F.array().cast("array<string>")), skill_token), lambda t: t.isNotNull() & (t != "")))


def token_overlap(own: Column, r: Column, p: Column) -> Column:
    """Shares of the required and preferred tokens that are among `own`, weighted over those that are given."""
    def share(tokens: Column) -> Column:
        return F.size(F.array_intersect(tokens, own)) / F.size(tokens)

    wr, wp = F.when(F.size(r) > 0, V.REQUIRED_WEIGHT).otherwise(0.0), F.when(F.size(p) > 0, V.PREFERRED_WEIGHT).otherwise(0.0)
    total = F.when(F.size(r) > 0, wr * share(r)).otherwise(0.0) + F.when(F.size(p) > 0, wp * share(p)).otherwise(0.0)
    return F.when(wr + wp > 0, total / (wr + wp)).otherwise(0.0)


def domain_affinity(a: Column, b: Column) -> Column:
    near = F.lit(False)
    for x, others in V.DOMAIN_NEIGHBOURS.items():
        near = near | ((a == x) & b.isin(*others)) | ((b == x) & a.isin(*others))
    return F.when((a == "unknown") | (b == "unknown") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when(near, 0.5).otherwise(0.0)


def seniority_affinity(a: Column, b: Column) -> Column:
    d = F.abs(seniority_rank(a) - seniority_rank(b))
    return F.coalesce(F.get(F.array(F.lit(1.0), F.lit(0.7), F.lit(0.4)), d), F.lit(0.0))
