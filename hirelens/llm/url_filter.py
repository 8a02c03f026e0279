"""URL filters by a Bloom filter cascade (exact over the corpus's own keys), with explicit rules on top.

Level 0 encodes the listed keys. Level 1 encodes those unlisted keys of the corpus that level 0 lets through,
level 2 the listed keys that level 1 lets through, and so on until a level lets nothing through. A key's answer
is the side of the first level that rejects it. As the levels were built against every key of the corpus, the
answer is exact for each of them, without a join: a page is judged by bit tests on constants of the plan. A list
whose filters would be too large for that is split into segments by the keys' hash, each with a cascade of its own;
pages are then judged segment by segment, by the same bit tests.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.shared import LOWER, UPPER, materialize, table

#: (verdict, host, path); a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Domains that the query blocks, each with its subdomains.
LISTED_DOMAINS = tuple(
    f"{name}.example.{tld}"
    for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for tld in ("com", "net", "org")
)
#: Rules in one expression; more are tried in turn, by further passes.
RULES_AT_ONCE = 200
PER_BYTE, BYTES = 7, 8  # bits in a byte of the constant (so that it is ASCII), bytes in a collected long


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; null or no `://`: empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def ranked(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Rules, those first that win over others."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits (then that of the longer host, then the first in
    text order); null if none fits."""
    found = F.when(F.lit(False), F.lit(None).cast("struct<rule:string,verdict:string>"))
    for verdict, h, p in ranked(rules):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = found.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    return found


def page_keys(host: Column, path: Column) -> Column:
    """What of a page can be listed: its host, each parent domain, and host + path. Empty host: nothing."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.when(path == "", domains).otherwise(F.array_append(domains, F.concat(host, path))))
    )


@dataclass(frozen=True)
class Level:
    number: int
    n_bits: int
    n_hashes: int
    bits: bytes

    def positions(self, key: Column) -> Column:
        return _positions(key, self.number, self.n_hashes, self.n_bits)

    def has(self, key: Column) -> Column:
        """True for every encoded key, and for some others."""
        bits, hit = F.lit(self.bits), F.lit(True)
        for j in range(self.n_hashes):
            p = _position(key, self.number, j, self.n_bits)
            byte = F.ascii(F.substring(bits, F.floor(p / F.lit(PER_BYTE)).cast("int") + 1, F.lit(1)).cast("string"))
            hit = hit & (F.getbit(byte, (p % PER_BYTE).cast("int")) == 1)
        return hit


def _position(key: Column, level: int, j: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * 100 + j), key), F.lit(n_bits))


def _positions(key: Column, level: int, n_hashes: int, n_bits: int) -> Column:
    return F.array(*(_position(key, level, j, n_bits) for j in range(n_hashes)))


class Cascade:
    """Levels of Bloom filters; `contains(key)` is exact for every key of the universe it was built over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)  # the last level has no false positives left
        for level in reversed(self.levels):
            answer = F.when(~level.has(key), F.lit(level.number % 2 == 1)).otherwise(answer)
        return answer

    @property
    def n_bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def first_bits(n_listed: int, n_unlisted: int, least: float = 10.0) -> float:
    """Bits per key of level 0, so many that it lets no more unlisted keys through than half as many as are listed."""
    return max(least, math.log2(max(1.0, 2 * n_unlisted / max(1, n_listed))) / math.log(2))


def build_cascade(keys: DataFrame, bits_per_key: float | None = None, later_bits_per_key: float = 4.0) -> Cascade:
    """Builds a cascade from the key universe `keys` (key, listed), one row per key, no null key. bits_per_key: of level
    0, by default `first_bits`. Later levels are no larger, since each encodes what the one before let through."""
    sides = {True: keys.where("listed").select("key"), False: keys.where("NOT listed").select("key")}
    levels: list[Level] = []
    encoded, other = sides[True], sides[False]
    if bits_per_key is None:
        bits_per_key = first_bits(encoded.count(), other.count())
    while True:
        number, n = len(levels), encoded.count()
        if n == 0:
            return Cascade(levels)
        per_key = later_bits_per_key if number else bits_per_key
        n_bits = max(64, math.ceil(n * per_key))
        n_hashes = max(1, round(per_key * math.log(2)))
        bits = _bits(encoded, number, n_hashes, n_bits)
        levels.append(Level(number, n_bits, n_hashes, bits))
        passed = materialize(other.where(levels[-1].has(F.col("key"))), "cascade")
        encoded, other = passed, encoded


def _bits(keys: DataFrame, number: int, n_hashes: int, n_bits: int) -> bytes:
    """The level's bits, seven in a byte; aggregated on the executors, at most `n_bits` bits reach the driver."""
    p, per_long = F.explode(_positions(F.col("key"), number, n_hashes, n_bits)), PER_BYTE * BYTES
    longs = (
        keys.select(p.alias("p"))
        .groupBy(F.floor(F.col("p") / F.lit(per_long)).alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % per_long).cast("int"))).alias("bits"))
    )
    out = bytearray((n_bits // per_long + 1) * BYTES)
    for at, bits in longs.collect():
        for k in range(BYTES):
            out[at * BYTES + k] = bits >> (PER_BYTE * k) & 0x7F
    return bytes(out)


def _segment(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("segment"), key), F.lit(n))


def _of_segment(keys: Column, number: int, n: int) -> Column:
    return F.filter(keys, lambda k: _segment(k, n) == number) if n > 1 else keys


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bytes: int = 1 << 20) -> DataFrame:
    """Judges every url of `pages` (page_id, url): page_id, host, path, rule, verdict.

    listed: a DataFrame whose column `key` holds blocked domains (with their subdomains) or host + path.
    The longest fitting rule decides; without one, a page with a listed key is blocked and any other allowed.
    Null urls and urls without `://` have empty host and path, no rule, and are allowed. Repeated rows are
    judged each. Null or repeated listed keys change nothing. Columns other than page_id and url are ignored.
    max_bytes: of a level's constant. There are as many segments, and passes over the pages, as that asks for.
    """
    h, p = F.col("host"), F.col("path")
    judged = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    own = judged.select(F.explode(page_keys(h, p)).alias("key"), F.lit(True).alias("own"), F.lit(False).alias("listed"))
    marked = listed.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.lit(False).alias("own"), F.lit(True).alias("listed"))
    universe = own.unionByName(marked).groupBy("key").agg(F.bool_or("own").alias("own"), F.bool_or("listed").alias("listed"))
    universe = materialize(universe.where("own").select("key", "listed"), "url-keys")
    n_listed, n_all = universe.agg(F.count_if("listed"), F.count(F.lit(1))).first()
    per_key = first_bits(n_listed, n_all - n_listed)
    segments = max(1, math.ceil(n_listed * per_key / PER_BYTE / max_bytes))
    judged = judged.withColumns({"found": F.lit(None).cast("struct<rule:string,verdict:string>"), "hit": F.lit(False)})
    for number in range(segments):
        mine = universe.where(_segment(F.col("key"), segments) == number)
        cascade = build_cascade(mine, per_key)
        keys = _of_segment(page_keys(h, p), number, segments)
        judged = judged.withColumn("hit", F.col("hit") | F.exists(keys, cascade.contains))
        judged = materialize(judged, "judged") if segments > 1 else judged
    order = ranked(rules)
    for at in range(0, len(order), RULES_AT_ONCE):
        judged = judged.withColumn("found", F.coalesce("found", matching_rule(h, p, order[at : at + RULES_AT_ONCE])))
        judged = materialize(judged, "judged") if len(order) > RULES_AT_ONCE else judged
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("hit"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED_DOMAINS))).alias("key"))
    return filter_urls(table(spark, sf_dir, "pages"), listed)


def oracle() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in order)
    listed = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in LISTED_DOMAINS)
    return f"""
    WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM p"""
