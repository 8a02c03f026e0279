"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Short test items are sought inside long documents, so the measure is containment: the share of an item's distinct
shingles that a document has. Items are partitioned by size (classes of a power of two); an item's MinHash sketch is its
smallest shingle hashes, as many as its class needs: an item of q shingles may miss at most floor((1 - threshold) q)
of them, so one more than that of the class's largest size always meets a document that contains enough. A class's
largest sketched hash is its rate: a document's sketch for the class is its own hashes up to that rate, drawn from the
whole text, so that a passage is as well sketched in a long document as in a short one. A document is sketched only for
the classes whose least item it could contain. The rate grows with the number of items, so a Bloom filter of all sketched
hashes, a constant of the plan, leaves of a document's sketch what an item may have: what is searched for depends on what
documents contain and not on how many items there are. Candidates are then counted exactly, on the shingles' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.shared import bounded_broadcast, materialize, row_key, table
from hirelens.llm.url_filter import Level, _bits

SHINGLE, THRESHOLD = 5, 0.8
#: Bits of the sketched hashes' filter: for each of them, and in all (a megabyte). Beyond, more passes by chance.
BITS_PER_HASH, MAX_BITS = 16, 7 << 20


def norm_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, so that punctuation and case don't hide a passage."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _shingles(w: Column, n: int, of) -> Column:
    """`of(i)` for each place i where a shingle of n words starts; a text of fewer words has none."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, of)


def shingle_hashes(w: Column, n: int = SHINGLE) -> Column:
    return _shingles(w, n, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))


def shingle_texts(w: Column, n: int = SHINGLE) -> Column:
    return F.array_distinct(_shingles(w, n, lambda i: F.array_join(F.slice(w, i + 1, n), " ")))


def _by_width(of) -> Column:
    out = of(SHINGLE)
    for n in range(1, SHINGLE):
        out = F.when(F.col("width") == n, of(n)).otherwise(out)
    return out


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, item_key, width, shingles, n, need, size_class, sketch) of `items` (item_id, text); items without a word: none.
    width: words of a shingle; an item of fewer than five words is one shingle of all of them."""
    items = items.select("item_id", "text").distinct()
    w = items.select("item_id", F.xxhash64("text").alias("item_key"), norm_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.lit(SHINGLE), F.size("w")))
    sized = (
        w.select("item_id", "item_key", "width", _by_width(lambda n: shingle_texts(F.col("w"), n)).alias("shingles"), F.array_distinct(_by_width(lambda n: shingle_hashes(F.col("w"), n))).alias("hashes"))
        .withColumn("n", F.size("shingles"))
        .withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
        .withColumn("size_class", F.floor(F.log2("n") + F.lit(1e-9)).cast("int"))
    )
    most = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    keep = F.floor(most * F.lit(1 - threshold) + F.lit(1e-9)).cast("int") + 1
    return sized.select("item_id", "item_key", "width", "shingles", "n", "need", "size_class", F.slice(F.array_sort("hashes"), F.lit(1), keep).alias("sketch"))


def _filter_of(hashes: DataFrame) -> Level:
    """A Bloom filter of the distinct `hashes` (h)."""
    n = max(1, hashes.count())
    n_bits = min(MAX_BITS, max(64, BITS_PER_HASH * n))
    n_hashes = max(1, min(4, round(n_bits / n * 0.7)))
    return Level(0, n_bits, n_hashes, _bits(hashes.select(F.col("h").alias("key")), 0, n_hashes, n_bits))


def _up_to(hashes: Column, rate: Column, listed: Level) -> Column:
    return F.filter(hashes, lambda h: (h <= rate) & listed.has(h))


def _doc_sketch(w: Column, classes: list, listed: Level) -> Column:
    """The hashes that a document is searched by: of each width, those up to the largest rate of the size classes
    whose least item it could contain, as far as they may be an item's."""
    out = []
    for width in sorted({c["width"] for c in classes}):
        rate = F.lit(None).cast("long")
        for c in classes:
            if c["width"] == width:
                rate = F.greatest(rate, F.when(F.size(w) - width + 1 >= c["need"], F.lit(c["rate"])))
        out.append(_up_to(shingle_hashes(w, width), rate, listed))
    return F.concat(*out) if out else F.array().cast("array<bigint>")


def sketched_share(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> float:
    """What share of the five-word shingles of `docs` is searched for, as `contained_items` does."""
    sketched = materialize(item_sketches(items, threshold), "sketches")
    classes = sketched.groupBy("width", "size_class").agg(F.min("need").alias("need"), F.max(F.array_max("sketch")).alias("rate")).collect()
    listed = _filter_of(materialize(sketched.select(F.explode("sketch").alias("h")).distinct(), "sketch-hashes"))
    split = docs.select(norm_words(F.col("text")).alias("w"))
    searched, every = split.agg(F.sum(F.size(_doc_sketch(F.col("w"), classes, listed))), F.sum(F.size(shingle_hashes(F.col("w"))))).first()
    return (searched or 0) / max(1, every or 0)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(k, id, item_id, n_item_shingles, n_found) of each row of `docs` (doc_id, text) and each item that it contains;
    k is the row's `row_key`, id its doc_id."""
    sketched = materialize(item_sketches(items, threshold), "sketches")
    # a row for each width and power of two that occurs
    classes = sketched.groupBy("width", "size_class").agg(F.min("need").alias("need"), F.max(F.array_max("sketch")).alias("rate")).collect()
    sketches = materialize(sketched.select(F.explode("sketch").alias("h")).distinct(), "sketch-hashes")
    listed = _filter_of(sketches)
    sketches = bounded_broadcast(sketches)
    split = docs.select(row_key().alias("k"), F.col("doc_id").alias("id"), norm_words(F.col("text")).alias("w"))
    # explode_outer: for explode, Spark infers a filter on the array's size and would split every text anew for it
    tried = split.select("k", "id", F.explode_outer(_doc_sketch(F.col("w"), classes, listed)).alias("h"))
    candidates = bounded_broadcast(materialize(tried.join(sketches, "h", "left_semi").select("k", "id").distinct(), "candidates"))
    text = docs.select(row_key().alias("k"), F.col("doc_id").alias("id"), F.col("text"))
    whole = text.join(candidates, (text["k"] == candidates["k"]) & text["id"].eqNullSafe(candidates["id"]), "left_semi").dropDuplicates(["k", "id"])
    own = [shingle_texts(F.col("w"), width) for width in sorted({c["width"] for c in classes})]
    # shingles of different widths differ, since each has as many words as its width
    exact = whole.select("k", "id", norm_words(F.col("text")).alias("w")).select("k", "id", F.explode(F.concat(*own) if own else F.array().cast("array<string>")).alias("s"))
    wanted = materialize(sketched.select(F.explode("shingles").alias("s"), "item_id", "item_key", "n", "need"), "item-shingles")
    counted = exact.join(bounded_broadcast(wanted), "s").groupBy("k", "id", "item_id", "item_key", "n", "need").agg(F.count(F.lit(1)).alias("n_found"))
    return counted.where("n_found >= need").select("k", "id", "item_id", F.col("n").cast("long").alias("n_item_shingles"), "n_found")


def find_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document (doc_id, text) and an item (item_id, text) that it contains: doc_id, item_id,
    n_item_shingles, n_found, containment (n_found / n_item_shingles >= threshold).

    Null and empty texts have no shingles: no pair. An item of fewer than five words is sought as one shingle of all
    its words. Repeated rows give one pair; if rows share an id, the one with most found counts. A
    null id is reported as null. Items that share an id are told apart by their texts, and one pair is given for those
    of equal size. Columns other than these are ignored.
    """
    found = contained_items(docs, items, threshold).groupBy(F.col("id").alias("doc_id"), "item_id", "n_item_shingles").agg(F.max("n_found").alias("n_found"))
    return found.withColumn("containment", F.col("n_found") / F.col("n_item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that contain no item, with all their columns as they are. Each row is judged by its own text:
    others that share its id, or have none as it has, stay if theirs is clean."""
    found = materialize(contained_items(docs, items, threshold).select(F.col("k").alias("found"), F.col("id").alias("found_id")).distinct(), "contaminated")
    found = bounded_broadcast(found)
    return docs.join(found, (row_key(docs["doc_id"], docs["text"]) == found["found"]) & docs["doc_id"].eqNullSafe(found["found_id"]), "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w"
    return f"""
    WITH i AS (SELECT item_id, least({SHINGLE}, len(w)) AS k, w FROM (SELECT item_id, {words} FROM benchmark) WHERE len(w) > 0),
    b AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[x : x + k - 1], ' ') for x in range(1, len(w) - k + 2)]) AS s FROM i),
    d AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[x : x + k - 1], ' ') for x in range(1, len(w) - k + 2)]) AS s
      FROM (SELECT doc_id, {words} FROM documents), (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
    n AS (SELECT item_id, count(*) AS n_item_shingles FROM b GROUP BY item_id)
    SELECT doc_id, item_id, n_item_shingles, count(*) AS n_found, count(*) / n_item_shingles AS containment
    FROM d JOIN b USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item_shingles
    HAVING count(*) >= ceil(n_item_shingles * {THRESHOLD} - 1e-9)"""
