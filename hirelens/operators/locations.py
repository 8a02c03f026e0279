"""Places: country and city resolution, parsing of place texts, links between postings and places.

All of it works on tables of distinct texts that are joined back, so a text is resolved once however often it occurs.
Reference data come as dimensions: countries (code, iso3, fips, name), admin1 (country_code, code, name, ascii), cities
(geonames_id, name, ascii, country_code, admin1_code, population).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.functions import normalize as N
from hirelens.functions import vocabulary as V
from hirelens.sources.store import bounded
from hirelens.functions.fold import compact, lookup_key

RESULT = ("country_code", "confidence", "source", "is_ambiguous", "multi_country", "matched")
_US = "US"


def country_terms(countries: DataFrame, use_fips: bool = True) -> DataFrame:
    """(key, code) of every code and name that a country goes by. Two-letter codes of different lists clash, and then
    a key has several countries; without FIPS codes fewer do."""
    names = ["code", "iso3", *(["fips"] if use_fips else []), "name"]
    spread = countries.select("code", F.explode(F.array(*(F.col(n).cast("string") for n in names))).alias("term")).where(F.trim("term") != "")
    keyed = spread.select("code", lookup_key(F.col("term")).alias("k"))
    return keyed.select("code", F.explode(F.array("k", compact(F.col("k")))).alias("key")).where("key <> ''").distinct()


def _result(code=None, confidence="none", source="unknown", ambiguous=False, multi=False, matched=None) -> Column:
    values = (F.lit(code) if code is None else code, F.lit(confidence) if isinstance(confidence, str) else confidence, F.lit(source) if isinstance(source, str) else source, F.lit(ambiguous), F.lit(multi))
    matched = F.array().cast("array<string>") if matched is None else matched
    return F.struct(*(v.cast("boolean" if n in ("is_ambiguous", "multi_country") else "string").alias(n) for n, v in zip(RESULT, values, strict=False)), matched.alias("matched"))


def _resolve_plain(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """`texts` (text, explicit; distinct) with `r`, by whole-text rules alone."""
    one = texts.select("text").distinct().withColumn("k", lookup_key(F.col("text")))
    keys = one.select("text", F.explode(F.array_distinct(F.array("k", compact(F.col("k"))))).alias("key")).where("key <> ''")
    codes = keys.join(terms, "key").groupBy("text").agg(F.array_sort(F.collect_set("code")).alias("codes"))  # at most all countries
    t = F.trim("text")
    letters, upper = F.regexp_replace(F.upper(t), "[^A-Z]", ""), F.upper(t)
    how = F.when(F.col("explicit"), "explicit_field")
    sure = F.when(F.col("explicit"), "high").otherwise("low")
    exceptional = F.lit(None).cast("string")
    for a, b in V.EXCEPTIONAL_ALPHA2.items():
        exceptional = F.when(letters == a, b).otherwise(exceptional)
    n = F.coalesce(F.size("codes"), F.lit(0))
    r = (
        F.when(F.coalesce(t, F.lit("")) == "", _result())
        .when(F.lower(t).isin(*V.REGION_WORDS), _result(ambiguous=True))
        .when(exceptional.isNotNull(), _result(exceptional, sure, F.coalesce(how, F.lit("code_match")), matched=F.array(exceptional)))
        .when(~F.col("explicit") & upper.isin(*V.AMBIGUOUS_ALPHA2), _result(ambiguous=True))
        .when(n == 1, _result(F.get("codes", F.lit(0)), sure, F.coalesce(how, F.lit("geonames_match")), matched=F.col("codes")))
        .when(n > 1, _result(ambiguous=True, multi=True, matched=F.col("codes")))
        .otherwise(_result())
    )
    return texts.join(codes, "text", "left").select("text", "explicit", r.alias("r"))


def resolve_countries(texts: DataFrame, countries: DataFrame, use_fips: bool = True) -> DataFrame:
    """(text, explicit, RESULT columns) of the distinct rows of `texts` (text, explicit).

    explicit: the text is a country field, and not a place text. Region words and, unless explicit, two letters that
    are a state's or province's code are ambiguous; a text with one country has its code; one with more is ambiguous.
    An explicit field of several parts has the country that its parts agree on. Null and blank: nothing.
    """
    terms = country_terms(countries, use_fips)
    asked = texts.select("text", "explicit").distinct()
    plain = _resolve_plain(asked, terms)
    lowered = F.lower(F.trim("text"))
    several = F.col("explicit") & F.col("r.country_code").isNull() & (F.size("r.matched") == 0) & lowered.rlike(",| and |/") & ~F.col("r.is_ambiguous")
    parts = plain.where(several).select("text", F.explode(F.split(lowered, r",|\band\b|/")).alias("part"))
    known = _resolve_plain(parts.select(F.col("part").alias("text"), F.lit(False).alias("explicit")).distinct(), terms).select(F.col("text").alias("part"), F.col("r.country_code").alias("code"))
    found = parts.join(known, "part").where("code IS NOT NULL").groupBy("text").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    n = F.coalesce(F.size("codes"), F.lit(0))
    r = F.when(several & (n == 1), _result(F.get("codes", F.lit(0)), "high", "explicit_field", matched=F.col("codes"))).when(several & (n > 1), _result(ambiguous=True, multi=True, matched=F.col("codes"))).otherwise(F.col("r"))
    return plain.join(found, "text", "left").select("text", "explicit", r.alias("r")).select("text", "explicit", "r.*")


def with_valid_country(rows: DataFrame, column: str, countries: DataFrame) -> DataFrame:
    """`rows` with `valid_country`: the column, stripped, is a country's two-letter code in either case."""
    codes = countries.select(F.upper("code").alias("__code")).distinct().withColumn("__hit", F.lit(True))
    upper = F.upper(F.trim(column))
    return rows.join(bounded(codes), F.when(F.length(upper) == 2, upper) == F.col("__code"), "left").withColumn("valid_country", F.coalesce("__hit", F.lit(False))).drop("__code", "__hit")


def resolve_cities(asked: DataFrame, cities: DataFrame, admin1: DataFrame) -> DataFrame:
    """(city, region, country_code, geonames_id, found_country, found_admin1, population) of the distinct rows of
    `asked` (city, region, country_code) that have an answer.

    Candidates bear the name, and are of the country and region if these are given (a region by code or name). A
    single one is the answer; of several in one country the largest, if country or region is given or if it has
    200,000 people and eight times those of the next.
    """
    q = asked.select("city", "region", "country_code").distinct().withColumn("key", lookup_key(F.col("city"))).where("key <> ''").withColumn("rk", lookup_key(F.col("region")))
    names = F.array_distinct(F.array(lookup_key(F.col("name")), lookup_key(F.coalesce("ascii", "name"))))
    c = cities.select("geonames_id", F.col("country_code").alias("cc"), F.upper(F.coalesce("admin1_code", F.lit(""))).alias("a1"), F.coalesce("population", F.lit(0)).alias("population"), F.explode(names).alias("key"))
    a = admin1.select(F.col("country_code").alias("cc"), F.upper("code").alias("a1"), F.array(lookup_key(F.col("name")), lookup_key(F.coalesce("ascii", "name"))).alias("admin_names"))
    given = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    by_country = ~given(F.col("country_code")) | (F.upper(F.trim("country_code")) == F.col("cc"))
    by_region = ~given(F.col("region")) | ((F.col("a1") != "") & ((F.upper(F.trim("region")) == F.col("a1")) | F.coalesce(F.array_contains("admin_names", F.col("rk")), F.lit(False))))
    met = q.join(c, "key").join(a, ["cc", "a1"], "left").where(by_country & by_region)
    by = ["city", "region", "country_code"]
    once = met.groupBy(*by, "geonames_id").agg(F.max(F.struct("population", "cc", "a1")).alias("x"))
    top = F.struct(F.col("x.population").alias("population"), (-F.col("geonames_id")).alias("id"), F.col("x.cc").alias("cc"), F.col("x.a1").alias("a1"))
    best = once.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x.cc").alias("countries"), F.slice(F.sort_array(F.collect_list(top), False), 1, 2).alias("two"))
    one, two = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    sure = (F.col("n") == 1) | ((F.col("countries") == 1) & (given(F.col("region")) | given(F.col("country_code")) | (one["population"] >= F.greatest(F.lit(200_000), two["population"] * 8))))
    return best.where(sure).select(*by, (-one["id"]).alias("geonames_id"), one["cc"].alias("found_country"), one["a1"].alias("found_admin1"), one["population"].alias("population"))


def _null_safe(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def parse_locations(texts: DataFrame, countries: DataFrame, cities: DataFrame, admin1: DataFrame, use_fips: bool = True) -> DataFrame:
    """(location_text, city, region, country_code, workplace_type, remote_scope) of the distinct texts of `texts`
    (location_text); null and empty texts have nothing but an unknown workplace.

    A remote text's scope, or a part of it, may name the country. Otherwise the last of its comma-separated parts may,
    with the city in front of it; else city and region, a US state's code, or a single city may tell.
    """
    t = F.col("location_text")
    scope = r"(?iU)remote\s*[-–(]\s*([a-zA-Z\s,]+)[)]?"
    one = texts.select("location_text").distinct().withColumns({
        "workplace_type": N.workplace(F.array("location_text"), "unknown"),
        "scope": F.when(t.rlike(scope), N.strip(F.regexp_extract(t, scope, 1))),
        "dashed": F.transform(F.split(t, "[-–]"), N.strip),
        "parts": F.transform(F.split(t, ","), N.strip),
    })
    remote = F.col("workplace_type") == "remote"
    n = F.size("parts")
    first, second, last = F.get("parts", F.lit(0)), F.get("parts", F.lit(1)), F.element_at("parts", -1)
    ask = lambda role, pos, x: F.struct(F.lit(role).alias("role"), pos.alias("pos"), x.alias("text"))
    dashes = F.transform(F.col("dashed"), lambda x, i: ask("dash", i, F.when(F.lower(x) != "remote", x)))
    asks = F.concat(F.array(ask("last", F.lit(0), last), ask("scope", F.lit(0), F.when(remote, F.col("scope")))), F.when(remote & F.col("scope").isNull(), dashes).otherwise(F.slice(dashes, 1, 0)))
    spread = one.where("location_text <> ''").select("location_text", F.explode(asks).alias("a")).select("location_text", "a.*").where("text <> ''")
    known = resolve_countries(spread.select("text", F.lit(False).alias("explicit")), countries, use_fips).where("country_code IS NOT NULL").select("text", F.col("country_code").alias("code"))
    got = spread.join(known, "text").groupBy("location_text").agg(
        F.max(F.when(F.col("role") == "last", F.col("code"))).alias("last_code"), F.max(F.when(F.col("role") == "scope", F.col("code"))).alias("scope_code"),
        F.min(F.when(F.col("role") == "dash", F.struct("pos", "code", "text"))).alias("dash"),
    )
    one = one.join(got, "location_text", "left").withColumn("code", F.coalesce("scope_code", "dash.code"))
    needs = F.col("code").isNull() & (F.coalesce(t, F.lit("")) != "")
    none = F.lit(None).cast("string")
    wanted = F.when(needs & (n == 2) & F.col("last_code").isNotNull(), F.struct(first.alias("city"), none.alias("region"), F.col("last_code").alias("country_code"))).when(
        needs & (n >= 2) & F.col("last_code").isNull(), F.struct(first.alias("city"), second.alias("region"), none.alias("country_code"))
    ).when(needs & (n == 1) & F.col("last_code").isNull() & (F.length(first) > 3), F.struct(first.alias("city"), none.alias("region"), none.alias("country_code")))
    one = one.withColumn("w", wanted).select("*", *(F.col(f"w.{c}").alias(f"w_{c}") for c in ("city", "region", "country_code")))
    met = resolve_cities(one.where("w IS NOT NULL").select("w.*"), cities, admin1)
    met = met.select(F.col("city").alias("w_city"), F.col("region").alias("w_region"), F.col("country_code").alias("w_country_code"), "found_country", "found_admin1")
    one = one.join(met, _null_safe(one, met, ["w_city", "w_region", "w_country_code"]), "left").drop(met["w_city"], met["w_region"], met["w_country_code"])
    states = admin1.where(F.col("country_code") == _US).select(F.col("code").alias("state")).distinct()
    state = F.when(needs & (n >= 2) & second.rlike("^[A-Z]{2}$"), second)
    one = one.join(states, state == F.col("state"), "left")
    by_country, by_city = needs & F.col("last_code").isNotNull(), needs & F.col("last_code").isNull() & F.col("found_country").isNotNull()
    by_state = needs & F.col("last_code").isNull() & F.col("found_country").isNull() & F.col("state").isNotNull()
    city = F.when(by_country & (n >= 2), first).when(by_city | by_state, first)
    region = F.when(by_country & (n >= 3), second).when(by_country & (n == 2), F.nullif("found_admin1", F.lit(""))).when(by_city & (n >= 2), second).when(by_city, F.nullif("found_admin1", F.lit(""))).when(by_state, second)
    code = F.when(by_country, F.col("last_code")).when(by_city, F.col("found_country")).when(by_state, F.lit(_US)).otherwise(F.col("code"))
    return one.select("location_text", city.alias("city"), region.alias("region"), code.alias("country_code"), "workplace_type", F.coalesce(F.when(remote, F.col("scope")), F.col("dash.text")).alias("remote_scope"))


def jobs_without_location(jobs: DataFrame, links: DataFrame, locations: DataFrame) -> DataFrame:
    """(job_id, problem) of `jobs`: `unlinked`, `no_primary`, or `no_country` of the primary place."""
    linked = links.groupBy("job_id").agg(F.max(F.when(F.col("is_primary"), F.col("location_id"))).alias("location_id"))
    place = locations.select(F.col("id").alias("location_id"), "country_code")
    got = jobs.select("job_id").join(linked.withColumn("__linked", F.lit(True)), "job_id", "left").join(place, "location_id", "left")
    problem = F.when(F.col("__linked").isNull(), "unlinked").when(F.col("location_id").isNull(), "no_primary").when(F.col("country_code").isNull(), "no_country")
    return got.withColumn("problem", problem).where("problem IS NOT NULL").select("job_id", "problem")


def upsert_links(held: DataFrame, new: DataFrame) -> DataFrame:
    """The links (job_id, location_id, is_primary, source_raw, created_at) after `new` (the same, and seq) has been
    applied: of several for a pair the last counts; a job's old primary gives way to a new one, and of several new ones
    the last stays; held pairs keep created_at. Links are never taken away."""
    pair = ["job_id", "location_id"]
    last = new.groupBy(*pair).agg(F.max_by(F.struct("is_primary", "source_raw", "created_at", "seq"), "seq").alias("n"))
    primary = last.where("n.is_primary").groupBy("job_id").agg(F.max_by("location_id", "n.seq").alias("primary_id"))
    both = held.select(*pair, F.struct("is_primary", "source_raw", "created_at").alias("h")).join(last, pair, "full").join(primary, "job_id", "left")
    own = F.coalesce(F.col("n.is_primary"), F.col("h.is_primary"))
    is_primary = F.when(F.col("primary_id").isNull(), own).otherwise(F.col("primary_id").eqNullSafe(F.col("location_id")))
    return both.select(*pair, is_primary.alias("is_primary"), F.coalesce("n.source_raw", "h.source_raw").alias("source_raw"), F.coalesce("h.created_at", "n.created_at").alias("created_at"))


def set_primary(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """`links` where `chosen` (job_id, location_id) are primary; jobs not in it, or not linked to the place, stay."""
    c = links.select("job_id", "location_id").join(chosen, ["job_id", "location_id"], "left_semi").select("job_id", F.col("location_id").alias("__chosen"))
    got = links.join(c, "job_id", "left")
    return got.withColumn("is_primary", F.when(F.col("__chosen").isNull(), F.col("is_primary")).otherwise(F.col("__chosen") == F.col("location_id"))).drop("__chosen")


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone, ["job_id", "location_id"], "left_anti")


def nested_locations(jobs: DataFrame, links: DataFrame, locations: DataFrame) -> DataFrame:
    """`jobs` with `locations`: its places as structs, the primary first, then in the order of linking; none: an empty
    array. A job has few places."""
    place = locations.select(F.col("id").alias("location_id"), "city", "region", "country_code", "display_name")
    fields = F.struct("source_raw", "is_primary", "city", "region", "country_code", "display_name")
    key = F.struct((~F.col("is_primary")).alias("a"), F.col("created_at").alias("b"), F.col("location_id").alias("c"), fields.alias("x"))
    got = links.join(place, "location_id", "left").groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["x"]).alias("locations"))
    empty = F.array().cast(got.schema["locations"].dataType)
    return jobs.join(got, "job_id", "left").withColumn("locations", F.coalesce("locations", empty))


def posting_view(jobs: DataFrame, sources: DataFrame, links: DataFrame, locations: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Postings as they are read: with `source` (platform:identifier), nested places, and `content` of the store
    (sha256, content) where a row points there."""
    keyed = sources.select(F.col("id").alias("source_id"), N.source_key(F.col("platform"), F.col("identifier")).alias("source"))
    out = nested_locations(jobs, links, locations).join(keyed, "source_id", "left")
    return out if store is None else out.join(store.select("sha256", "content"), "sha256", "left")


def country_filter(jobs: DataFrame, links: DataFrame, locations: DataFrame, code: str) -> DataFrame:
    """`jobs` that have a place in the country."""
    here = links.join(locations.where(F.col("country_code") == code).select(F.col("id").alias("location_id")), "location_id", "left_semi")
    return jobs.join(here.select("job_id"), "job_id", "left_semi")
