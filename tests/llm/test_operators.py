"""Each operator against brute force, an exact round trip or its SQL, and on awkward rows."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hirelens.llm import chat, decontaminate, encoding, graph, lang_id, line_dedup, near_copies, packing, pipeline, quality, queries, shared, simhash, token_blocks, toxicity, url_filter
from tests.compare import assert_same

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, k string, fp string, part string, tie string, key string"
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(30_000))
AWKWARD = [
    (None, "the quick brown fox jumps over the lazy dog and runs far away", "en", "a", 1),
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\n ", "en", "b", 0),
    (4, "one", "en", "c", 3),
    (5, "the quick brown fox jumps over the lazy dog and runs far away", "en", "d", 1),
    (5, "the quick brown fox jumps over the lazy dog and runs far away", "en", "d", 1),
    (5, "another text under the same id with some other words in it", "en", "e", 1),
    (6, LONG, "en", "a", len(LONG)),
    (7, "日本語のテキスト 漢字 éà <|endoftext|> 12345", "ja", "a", 9),
    (8, "line that is long enough to count\nline that is long enough to count\nshort", "en", "a", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *"xxxxxx") for r in AWKWARD], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def texts(spark, sf=SMALL):
    return shared.table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), SF, queries.ORACLES[name])


# encoding and token files


ENCODED = [
    "a  b", "a \nb", "a\n  b", "  lead", "trail  ", " ", "", "a\t\tb c's don't  'll", "e\u0301 \u0300a", "x\u0085 b\u3000 c", "\x1c a", "foo.\n\nbar\n\n\nbaz\n",
    "a <|endoftext|> b", "x<|startoftext|>", "İstanbul İ ǅ Straße ẞ ŉ ſ", "n1b22 3c 44 12345 ²³ ½", "日本語 漢字 éà", "$$$ %%a! ^_` {x} ~", "“Так” — й… €5", "𝒜 𐐀 ß Σας", "a\r\nb c\r\n",
]


@pytest.mark.parametrize("stretch", [40, 4_000_000])
@pytest.mark.parametrize(("file", "space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_texts_encode_as_by_the_library(spark, monkeypatch, file, space, stretch):
    monkeypatch.setattr(encoding, "STRETCH", stretch)
    own, whole = encoding.ChunkEncoder(public_tokenizers.path(file), space, max_words=50), Tokenizer.from_file(public_tokenizers.path(file))
    some = [r.text for r in texts(spark)[:60]] + [t or "" for _, t, *_ in AWKWARD] + ENCODED
    rng, letters = np.random.default_rng(8), list("abÉé'sstre .,\n!3 4<|>_\t İßǆ×ɏ漢\u0301²“”…€Яй\u00a0")
    some += ["".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(0, 60))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)] == [e.ids for e in whole.encode_batch(some, add_special_tokens=False)]
    assert [len(x) for x in own.encode([None, "", "a b"], 7)] == [4, 4, 12]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_000, 5000), np.zeros(700), np.full(513, 2**32 - 1), np.where(rng.random(2000) < 0.03, 2**32 - 1, rng.integers(5, 9, 2000)), np.arange(1), np.arange(0)):
        ids = ids.astype(np.uint32)
        assert (token_blocks.unpack(b"".join(token_blocks.pack(ids))) == ids).all()


def read_back(spark, docs):
    uri = shared.fresh_path(spark, "tokens")
    token_blocks.write_tokens(docs, uri, public_tokenizers.path("byte_bpe_50k.json"))
    return uri, token_blocks.read_tokens(spark, uri).collect()


def test_token_files(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    uri, got = read_back(spark, shared.table(spark, SMALL, "documents"))
    start, want = 0, []
    for r in texts(spark):
        ids = whole.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == want
    root = pafs.FileSystem.from_uri(uri)[1]
    first = sorted(f.base_name for f in pafs.FileSystem.from_uri(uri)[0].get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".pfr"))[0]
    reader = token_blocks.Reader(uri, first)
    everything = reader.ids(0, reader.n_tokens)
    assert (reader.ids(700, 600) == everything[700:1300]).all()  # by the block index


def test_token_files_awkward(spark, docs, none):
    got = read_back(spark, docs)[1]
    assert len(got) == len(AWKWARD) and sum(r.doc_id is None for r in got) == 1
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(itertools.accumulate([0] + [r.n_tokens for r in ordered[:-1]]))
    assert [r.doc_id or 0 for r in ordered] == sorted(r.doc_id or 0 for r in ordered)
    assert read_back(spark, none)[1] == []


# url filter


def test_cascade_is_exact(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys, bits_per_key=3)
    assert len(cascade.levels) > 2
    assert keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    usual = url_filter.build_cascade(keys)
    assert all(x.n_bits <= usual.levels[0].n_bits for x in usual.levels) and keys.where(usual.contains(F.col("key")) != F.col("listed")).count() == 0
    assert url_filter.first_bits(100, 10**10) > 35  # so that level 1 encodes dozens of keys, not many millions


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Spam.org?x"), (5, "http://spam.org/p#f"), (6, "x://notspam.org/en/"), (7, "http://ok.com/en/7"), (7, "http://ok.com/bad/page"), (8, "http://b.example.com/en/71/")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, key string")
    listed = spark.createDataFrame([("spam.org",), ("ok.com/bad/page",), (None,), ("spam.org",)], "key string")
    want = {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.spam.org", "", None, "block"), (5, "spam.org", "/p", None, "block"), (6, "notspam.org", "/en/", None, "allow"), (7, "ok.com", "/en/7", "com/en/", "block"), (7, "ok.com", "/bad/page", None, "block"), (8, "b.example.com", "/en/71/", "example.com/en/7", "allow")}
    for most in (1 << 20, 1):  # one segment, and many
        assert {tuple(r) for r in url_filter.filter_urls(pages, listed, max_bytes=most).collect()} == want
    many = [*url_filter.RULES, *(("block", f"h{i}.io", "/") for i in range(450))]
    more = pages.unionByName(spark.createDataFrame([(9, "http://a.h7.io/x", "z"), (10, "http://h449.io/", "z"), (11, "http://h450.io/" + "y" * 200_000, "z")], pages.schema))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(more, listed, many).where("page_id > 8").collect()}
    assert got == {9: ("h7.io/", "block"), 10: ("h449.io/", "block"), 11: (None, "allow")}
    assert url_filter.filter_urls(pages.where("false"), listed).count() == 0
    assert url_filter.filter_urls(pages, listed.where("false")).where("rule IS NULL AND verdict = 'block'").count() == 0


# language


def test_language_held_out(spark):
    got = lang_id.op3_language(spark, SF).join(shared.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    n, right = got.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right / n > 0.97


def slow_counts(text):
    """Counts by bucket of the n-grams of 1 to 4 letters and spaces."""
    norm = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).lstrip(" ") + " "
    out, mask = {}, 2**64 - 1
    for n in range(1, 5):
        for i in range(len(norm) - n + 1):
            code = 0
            for k in range(n):
                code = (code * 0x9E3779B97F4A7C15 & mask) ^ (ord(norm[i + k]) + k + 1)
            at = (code * 0xD6E8FEB86659FD93 & mask) >> 51
            out[at] = out.get(at, 0) + 1
    return out


def test_language_is_that_of_the_nearest_centroid(spark):
    model = lang_id.train(shared.table(spark, SMALL, "documents"), max_rows=100)
    got = {r.doc_id: r for r in lang_id.identify(shared.table(spark, SMALL, "documents"), model).collect()}
    for r in texts(spark)[:60]:
        v = {at: float(np.log1p(n)) * float(model.idf[at]) for at, n in slow_counts(r.text).items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        cosines = [sum(x * float(c[at]) for at, x in v.items()) / norm for c in model.vectors]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(got[r.doc_id].score - min(1.0, max(0.0, cosines[best]))) < 1e-4
        assert got[r.doc_id].lang_pred == model.langs[model.lang_of[best]] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4
        assert got[r.doc_id].rejected == (cosines[best] < model.floors[best]) or abs(cosines[best] - model.floors[best]) < 1e-4


def test_language_sample_of_any_size(spark):
    for n in (10, 10**5, 10**10, 10**12):
        limit = spark.range(1).select(F.lit("en").alias("lang")).select(lang_id.limit_by_language({"en": n, "de": 5}, 750)).first()[0]
        assert abs((limit + 1) / 2**63 * n - min(n, 750)) <= 1e-3 * n
    assert spark.range(1).select(F.lit("xx").alias("lang")).select(lang_id.limit_by_language({"en": 5}, 750)).first()[0] == -1


def test_language_awkward(spark, docs, none):
    model = lang_id.train(shared.table(spark, SMALL, "documents"))
    got = {(r.doc_id, r.text): r for r in lang_id.identify(docs, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in ((1, None), (2, ""), (3, "  \n\n ")))
    assert got[(4, "one")].lang_pred in model.langs and all(0 <= r.score <= 1 for r in got.values())
    assert got[(7, AWKWARD[9][1])].rejected  # far from every centroid
    assert lang_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in lang_id.identify(docs, lang_id.train(none)).collect()} == {"und"}


# decontamination


def test_containment(spark, docs, none):
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(10, f"before {item.upper()}, after"), (11, " ".join(item.split()[:27])), (12, " ".join(item.split()[:20])), (13, LONG + " " + item), (14, " ".join(item.split()[::-1])), (15, item.replace(" ", ", "))]
    own = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, w string").unionByName(docs.select("doc_id", "text", F.lit("z").alias("w")))
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "one"), (5, "lazy dog, AND runs")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_found) for r in decontaminate.find_contaminated(own, items).collect()}
    assert got == {(10, 1, 26), (11, 1, 23), (13, 1, 26), (15, 1, 26), (4, 4, 1), (None, 5, 1), (5, 5, 1)}
    left = decontaminate.decontaminate(own, items)
    assert left.columns == own.columns and left.count() == own.count() - 8
    clash = own.withColumns({"found": F.lit(1), "k": F.lit("z"), "id": F.lit(7), "found_id": F.lit(2)})
    assert sorted(map(str, decontaminate.decontaminate(clash, items).select("doc_id", "text").collect())) == sorted(map(str, left.select("doc_id", "text").collect()))
    assert decontaminate.find_contaminated(none, items).count() == 0 and decontaminate.find_contaminated(own, items.where("false")).count() == 0


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    dirty, clean = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    rows = [(i, t) for i in (None, 5) for t in (dirty, clean, clean)]
    left = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, dirty)], "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.text[:2]) for r in left.collect()) == [(0, "y0"), (0, "y0"), (5, "y0"), (5, "y0")]


def test_sketches_miss_no_passage(spark):
    """Recall is 1 against brute force, at exactly the threshold too."""
    rng = np.random.default_rng(11)
    items = {i: [f"i{i}w{k}" for k in range(rng.integers(1, 90))] for i in range(60)}
    docs = []
    for i, w in items.items():
        for cut in (0.7, 0.79, 0.8, 0.81, 1.0):
            n = max(1, round(cut * max(1, len(w) - 4))) + min(4, len(w) - 1)
            fill = [f"f{x}" for x in rng.integers(0, 10**6, rng.integers(0, 300))]
            docs.append((len(docs), " ".join(fill + w[:n] + fill[::-1])))

    def cut(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = set()
    for d, t in docs:
        for i, w in items.items():
            own = cut(w, min(5, len(w)))
            if len(own & cut(t.split(), min(5, len(w)))) >= 0.8 * len(own) - 1e-9:
                want.add((d, i))
    got = decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 150


# lines


def test_lines(spark, docs, none):
    line = "a line that is found on many sites"
    rows = [(i, f"own text {i}\n {line} \nend", f"s{i % 6}") for i in range(12)] + [(20, "a line on four sites, no more", f"t{i}") for i in range(4)] + [(None, line, "q")]
    own = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, n_removed long, key string")
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(own).collect()]
    assert (0, f"own text 0\n {line} \nend", 0) in got and (3, "own text 3\nend", 1) in got and (None, "", 1) in got
    assert sum(t == "a line on four sites, no more" for _, t, _ in got) == 4
    same = line_dedup.dedup_lines(docs)
    assert same.count() == len(AWKWARD) and same.where("n_removed > 0").count() == 0
    assert same.where("doc_id = 1").first().n_lines == 0
    assert line_dedup.dedup_lines(none).count() == 0
    clash = own.withColumns({c: F.lit("c") for c in ("__row", "__k", "__cut", "k", "own", "cut", "row", "pos", "line", "sites", "keeper")})
    again = line_dedup.dedup_lines(clash)
    assert [(r.doc_id, r.text, r.n_removed) for r in again.collect()] == got and set(clash.columns) <= set(again.columns)


# simhash


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash(spark):
    rows = texts(spark, SF)
    fps = [slow_fingerprint(r.text) for r in rows]
    want = dict(zip((r.doc_id for r in rows), zip((f"{x:016x}" for x in fps), slow_components([r.doc_id for r in rows], fps), strict=True), strict=True))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("shard", [1, 8, 512])
def test_near_links_connect_dense_and_hot_groups(spark, shard):
    rng = np.random.default_rng(5)
    fps = set()
    for center in rng.integers(0, 2**63, 6):
        x = int(center)
        for _ in range(60):  # chains of near fingerprints
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), shard=shard)
    roots = {r.node: r.root for r in graph.components(links).collect()}
    want = slow_components(signed, fps)
    assert [roots.get(x, x) for x in signed] == want


def test_simhash_awkward(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(AWKWARD)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    empty = "0" * 16
    assert by[(1, empty)] == by[(2, empty)] == by[(3, empty)] == 1
    same = f"{slow_fingerprint(AWKWARD[0][1]):016x}"
    assert by[(None, same)] == by[(5, same)] == 5
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(docs).where("doc_id IN (2, 3)").count() == 0


def slow_near(rows, least=0.8):
    """Pairs of places in `rows` whose five-word shingle sets have a Jaccard of `least` or more."""
    sets, by = [], {}
    for i, t in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
        for x in sets[-1]:
            by.setdefault(x, []).append(i)
    pairs = {p for at in by.values() if len(at) > 1 for p in itertools.combinations(at, 2)}
    return sorted((a, b) for a, b in pairs if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9)


@pytest.mark.parametrize("part", [3, 256])
def test_stage_drops_near_copies_as_brute_force(spark, part):
    rng = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in texts(spark, SF)]
    for n in (12, 40, 150, 600, 2500):  # edited in so many places that some copies are near and some are not
        base = [f"u{x}" for x in rng.integers(0, 10**6, n)]
        for c in range(14):
            own = list(base)
            for at in rng.choice(n, max(1, c * n // 300), replace=False):
                own[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((10_000 * n + c, " ".join(own)))
    left = near_copies.drop_near_copies(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string"), part)
    root = list(range(len(rows)))
    links = slow_near([t for _, t in rows])
    for _ in rows:
        before = list(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert len(links) > 50 and sorted(r.doc_id for r in left.collect()) == sorted(rows[i][0] for i in set(root))


def slow_print(text):
    """128 majority bits of a text's five-word shingles, as a number."""
    sets = near_copies.shingle_set(text)
    return int("".join(str(int(2 * sum(int(h) >> b & 1 for h in some) > len(some))) for some in (sets, near_copies._mix(sets ^ near_copies._STEP)) for b in range(63, -1, -1)), 2)


@pytest.mark.parametrize(("part", "radius"), [(3, 16), (256, 16), (256, -1)])
def test_stage_links_what_trees_of_fingerprints_find(spark, part, radius):
    rng = np.random.default_rng(6)
    rows = []
    for n in (60, 200, 900):
        base = [f"u{x}" for x in rng.integers(0, 10**6, n)]
        for c in range(20):
            own = list(base)
            for at in rng.choice(n, max(1, c * n // 400), replace=False):
                own[at] = f"e{rng.integers(0, 10**6)}"
            rows.append(" ".join(own))
    prints, root = [slow_print(t) for t in rows], list(range(len(rows)))
    links = [(a, b) for a, b in slow_near(rows) if (prints[a] ^ prints[b]).bit_count() <= radius]
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    left = near_copies.drop_near_copies(docs, part, radius)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(root))
    assert 0 < len(set(root)) < len(rows) if radius > 0 else not links


def test_trees_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(8)
    base = [f"u{x}" for x in range(300)]
    texts_ = ["", "a b", " ".join(base), " ".join(base), *(" ".join(base[: int(n)]) for n in rng.integers(1, 300, 60))]
    prints = [near_copies.fingerprint(near_copies.shingle_set(t)) for t in texts_]
    values = [slow_print(t) for t in texts_]
    assert [int.from_bytes(x) for x in prints] == values
    for radius in (0, 20, 48):
        near = {(i, j) for i, x in enumerate(values) for j, y in enumerate(values) if (x ^ y).bit_count() <= radius}
        assert set(near_copies.found_near(prints, prints, radius)) == {(i, j) for i, j in near if i < j}
        assert set(near_copies.found_near(prints[:30], prints[30:], radius)) == {(i, j - 30) for i, j in near if i < 30 <= j}


def test_stage_tells_rows_apart_by_their_text(spark):
    words, other, alone = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, words), (2, other), (2, words), (2, other), (None, alone), (None, alone + " more"), (None, words)]
    clash = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, row int, own int, stays int")
    left = near_copies.drop_near_copies(clash).collect()
    assert sorted((r.doc_id or 0, r.text[:2]) for r in left) == [(0, "c0"), (1, "a0"), (2, "b0")]


def test_bk_tree_finds_all_within_radius():
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.integers(0, 1 << 12, 300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1 << 12, 97):
        assert set(tree.near(q)) == {v for v in values if (v ^ q).bit_count() <= 3}


# quality


def slow_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    spots, covered = {}, set()
    for i in range(len(w) - 4):
        spots.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in spots.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality(spark):
    got = {r.doc_id: r for r in quality.op7_quality(spark, SF).collect()}
    for r in texts(spark, SF):
        q, want = got[r.doc_id], slow_base(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (q.base_failed and q.kept)
    assert sum(r.kept for r in got.values()) > 0.85 * len(got)


def test_quality_verdict_by_brute_force(spark):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = shared.table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    got, rows = {r.doc_id: r for r in quality.op7_quality(spark, SF).collect()}, {}
    for r in docs:
        ids, q = whole.encode(r.text), got[r.doc_id]
        n = np.unique(ids, return_counts=True)[1] / max(1, len(ids))
        chars, entropy = (len(r.text) / len(ids), float(-(n * np.log2(n)).sum())) if ids else (0.0, 0.0)
        share = sum(map(whole.IsByte, ids)) / max(1, len(ids))
        assert abs(q.chars_per_token - chars) < 1e-9 and abs(q.byte_share - share) < 1e-9 and abs(q.token_entropy - entropy) < 1e-9
        assert q.script == "latin" or not any(c.isalpha() for c in r.text)
        band = quality.BANDS[q.script]
        fine = bool(ids) and band.min_chars_per_token <= chars <= band.max_chars_per_token and share <= band.max_byte_share
        fine &= len(ids) < band.entropy_from or entropy >= min(band.enough_entropy, band.min_entropy * np.log2(max(2, len(ids))))
        rows[r.doc_id] = (r.lang, min(quality.LONGEST, max(1, len(ids)).bit_length() - 1), chars, entropy, fine and not q.base_failed)
    groups = {}
    for lang, length, chars, entropy, fine in rows.values():
        if fine:
            groups.setdefault((lang, length), set()).add((chars, entropy))
    for d, (lang, length, chars, entropy, fine) in rows.items():
        own = sorted(groups.get((lang, length), ()))
        if len(own) >= quality.FENCE_TEXTS:
            for value, values, (below, above, least) in zip((chars, entropy), zip(*own, strict=True), quality.FENCES.values(), strict=True):
                low, high = np.percentile(np.round(values, 3), [25, 75])
                spread = max(high - low, least)
                fine &= value >= low - below * spread and (above is None or value <= high + above * spread)
        assert got[d].kept == fine, d


def test_quality_bands_and_awkward(spark, docs, none):
    rows = {r.doc_id: r for r in quality.measure_quality(docs).collect()}
    assert (rows[1].n_words, rows[1].kept) == (0, False) and rows[2].base_failed
    judge = lambda t: quality.measure_quality(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    blob = " ".join(xxhash.xxh64_hexdigest(str(i)).upper() for i in range(60))
    assert not judge(blob).base_failed and not judge(blob).kept
    assert quality.measure_quality(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.repeated_words([f"w{i}" for i in range(9000)] * 2) == 18_000  # codes beyond 63 bits are renumbered


def test_quality_separates_labelled_junk(spark):
    large = "/root/testdata/sf0.1"
    got = quality.op7_quality(spark, large).join(shared.table(spark, large, "labels"), "doc_id").where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n[0, False] > 0.85 * (n[0, False] + n[0, True]) and n[1, True] > 0.995 * (n[1, False] + n[1, True])


# packing


def check_packed(rows, sizes, limits):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for x in by_seq.values():
        x.sort(key=lambda r: r.offset)
        assert [r.offset for r in x] == list(itertools.accumulate([0] + [r.length for r in x[:-1]]))
        assert sum(r.length for r in x) <= limits.tokens and len(x) <= limits.segments and sum(r.loss_tokens for r in x) <= limits.loss
    assert sum(r.length for r in rows) == sum(sizes)
    return by_doc, by_seq


def test_packing(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.op8_packing(spark, SMALL).collect()
    ids = {r.doc_id: whole.encode(r.text, add_special_tokens=False).ids + [1] for r in texts(spark)}
    by_doc, by_seq = check_packed(rows, map(len, ids.values()), packing.INSTRUCTIONS)
    for d, x in by_doc.items():
        x.sort(key=lambda r: r.start)
        assert [r.start for r in x] == list(itertools.accumulate([0] + [r.length for r in x[:-1]])) and x[0].doc_tokens == len(ids[d])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes()) for r in x)
    assert len(by_seq) <= -(-sum(map(len, ids.values())) // 2048) + 1
    assert any(sum(r.loss_tokens for r in x) > 1500 for x in by_seq.values())  # the limit binds


def test_packing_limits_and_awkward(spark, docs, none):
    path, limits = public_tokenizers.path("word_bpe_49k.json"), packing.Limits(256, 3, 100)
    some = docs.withColumn("share", F.lit(0.5))
    rows = packing.pack_documents(some, path, limits, loss_share=F.col("share")).collect()
    once = packing.pack_documents(docs, path).collect()
    total = sum(r.length for r in once)
    check_packed(rows, [total], limits)
    assert {r.doc_id for r in rows} == {r[0] for r in AWKWARD}
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize(("least", "most", "rare"), [(1, 2, 0), (5, 15, 0), (2, 9, 0.1)])
def test_many_short_documents_leave_little_padding(least, most, rare):
    rng, limits = np.random.default_rng(7), packing.Limits()
    sizes = np.where(rng.random(20_000) < rare, rng.integers(100, 800, 20_000), rng.integers(least, most, 20_000)).tolist()
    packer = packing.Packer(limits)
    pieces = (packing.Piece(i, 0, bytes(4 * n), n, 0) for i, n in enumerate(sizes))
    got = [s for p in pieces for s in packer.add(p)] + list(packer.rest())
    assert sum(p.length for s in got for p in s) == sum(sizes)
    assert all(len(s) <= limits.segments and sum(p.length for p in s) <= limits.tokens for s in got)
    assert len(got) <= 1.01 * max(sum(sizes) / limits.tokens, len(sizes) / limits.segments) + 2


# chat


NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def slow_cost(roles):
    """Cheapest repair by trying all: a turn is kept (0), relabelled (2) or merged into the last one (1, and 2 more if
    it is of another role); an empty turn put in costs 3; the last turn is the assistant's."""
    best = {None: 0.0}
    for r in roles:
        for _ in range(2):  # at most two empty turns help before a turn
            for a, c in list(best.items()):
                for b in NEXT[a]:
                    best[b] = min(best.get(b, 99e9), c + 3)
        new = {}
        for a, c in best.items():
            for b in NEXT[a]:
                new[b] = min(new.get(b, 99e9), c + (0 if b == r else 2))
            if a:
                new[a] = min(new.get(a, 99e9), c + (1 if a == r else 3))
        best = new
    return min(c + {"assistant": 0, "user": 3, "system": 6}[a] for a, c in best.items())


def test_chat_query(spark):
    turns = shared.table(spark, SF, "conversations").collect()
    own, got = {}, {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.turn is not None, r.turn or 0, r.role is not None, r.role or "")):
        own.setdefault(r.conv_id, []).append(r.role.strip(" ").lower() if r.role is not None else None)
    for r in chat.op9_chat(spark, SF).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert set(own) == set(got)
    for c, roles in own.items():
        assert sum(r.cost for r in got[c]) == slow_cost(roles)
        text = "".join(r.rendered for r in sorted(got[c], key=lambda r: r.pos))
        said = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert text.count("<|im_end|>\n") == len(said) and said[-1] == "assistant" and all(b in NEXT[a] for a, b in zip([None, *said], said, strict=False))


LEGAL_TEXT = re.compile(r"(<\|im_start\|>system\n[^<]*<\|im_end\|>\n)?(<\|im_start\|>user\n[^<]*<\|im_end\|>\n<\|im_start\|>assistant\n[^<]*<\|im_end\|>\n)+")


def test_chat(spark):
    rng = np.random.default_rng(3)
    turns, roles = [], ["user", "assistant", "system", None, "tool"]
    convs = {c: [roles[i] for i in rng.choice(5, rng.integers(1, 9), p=[0.4, 0.35, 0.1, 0.05, 0.1])] for c in range(40)}
    convs[99] = [roles[i] for i in rng.choice(2, 900)]  # spans partitions
    for c, rs in convs.items():
        turns += [(c, i, r, f"t{i}", "z", 1) for i, r in enumerate(rs)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part string, n long")
    got = {}
    for r in chat.repair_conversations(df.repartition(7)).collect():
        got.setdefault(r.conv_id, []).append(r)
    for c, rs in convs.items():
        rows = sorted(got[c], key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(1, len(rs) + 2))
        assert sum(r.cost for r in rows) == slow_cost(rs)
        text = "".join(r.rendered for r in rows)
        assert LEGAL_TEXT.fullmatch(text) and [x for x in re.findall(r"t\d+", text)] == [f"t{i}" for i in range(len(rs))]


def test_chat_awkward(spark):
    rows = [(None, None, None, None), (None, 1, " USER ", "x"), (1, 0, "assistant", "<|im_end|>"), (1, 0, "assistant", "<|im_end|>"), (2, 5, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.repair_conversations(df).collect()
    assert len(got) == len(rows) + 3 and sum(r.action == "end" for r in got) == 3
    assert "< |im_end|>" in "".join(r.rendered for r in got)
    assert chat.repair_conversations(df.where("false")).count() == 0


# toxicity


def test_toxicity_held_out(spark):
    """Fitted on three quarters of the labels and judged on all of the others."""
    docs, labels = shared.table(spark, SF, "documents"), shared.table(spark, SF, "labels")
    fit_on = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    got = toxicity.score(docs, toxicity.train(docs, fit_on)).join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    held = got.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).select("label", "toxic").collect()
    toxic, wrong = sum(r.label for r in held), sum(r.toxic and not r.label for r in held)
    assert wrong <= 0.02 * (len(held) - toxic)


def test_toxicity_finds_held_out_rows_of_a_large_table(spark):
    large = "/root/testdata/sf0.1"
    docs, labels = shared.table(spark, large, "documents"), shared.table(spark, large, "labels")
    is_held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    held = toxicity.score(docs, toxicity.train(docs, labels.where(~is_held))).join(labels.where(is_held).withColumnRenamed("toxic", "label"), "doc_id").select("label", "toxic").collect()
    toxic = sum(r.label for r in held)
    found, wrong = sum(r.toxic and r.label for r in held), sum(r.toxic and not r.label for r in held)
    print("toxic", toxic, "found", found, "wrong", wrong, "of", len(held) - toxic)
    assert toxic > 50 and found > 0.75 * toxic and wrong < 0.03 * (len(held) - toxic)


def test_chain_by_brute_force(spark):
    docs = shared.table(spark, SMALL, "documents")
    model = toxicity.train(shared.table(spark, SF, "documents"), shared.table(spark, SF, "labels"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    weights = [dict(zip(model.known.tolist(), m.words.tolist(), strict=True)) for m in model.models]
    for r in texts(spark):
        words = set(re.findall(r"[^\W\d_]+", r.text.lower()))
        parts = words | {w[:n] + "-" for w in words for n in (3, 4, 5, 6) if n < len(w)}
        hashes = {zlib.crc32(p.encode()) >> 8 for p in parts}
        p = []
        for m, own in zip(model.models, weights, strict=True):
            z = m.bias + sum(own.get(h, 0.0) for h in hashes) + sum(w * x for w, x in zip(m.more, p, strict=True))
            p.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
        q = got[r.doc_id]
        assert abs(q.p_low_quality - p[0]) < 1e-6 and abs(q.p_toxic - p[1]) < 1e-6 and q.toxic == (p[1] >= model.thresholds[1])


def test_later_model_uses_earlier_probability():
    rng = np.random.default_rng(0)
    first = rng.random(600) < 0.4
    hashes = [np.array([1 if f else 2], np.int32) for f in first]
    y = np.column_stack([first, first & (rng.random(600) < 0.9)]).astype(float)
    chain = toxicity.fit(hashes, y, ("a", "b"), np.arange(600) % toxicity.FOLDS)
    assert chain.models[1].more[0] > 0


def test_toxicity_awkward(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, 1), (777, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == len(AWKWARD)
    empty = toxicity.train(none, labels.where("false"))
    assert toxicity.score(docs, empty).where("toxic").count() == 0 and toxicity.score(none, model).count() == 0


# pipeline


def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    docs, item_rows = shared.table(spark, SF, "documents"), shared.table(spark, SF, "benchmark").collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "simhash_dedup", "benchmark_decontamination", "packing"]

    def after(name, before):
        out = shared.materialize(stages[name](spark, before, SF), "stage")
        return out, {r.doc_id: r for r in out.collect()}

    good, rows = after("quality_rules", docs)
    judged = {r.doc_id: r for r in quality.op7_quality(spark, SF).collect()}
    assert good.columns == docs.columns and set(rows) == {d for d, r in judged.items() if r.kept}
    clean = [r.doc_id for r in shared.table(spark, SF, "labels").where("quality = 1").collect() if not judged[r.doc_id].base_failed]
    assert len(clean) > 300 and sum(d in rows for d in clean) >= 0.99 * len(clean)
    lined, by_line = after("line_dedup", good)
    assert set(by_line) == set(rows) and all(r.n_chars == len(r.text) for r in by_line.values())
    once, left = after("simhash_dedup", lined)
    ids = sorted(by_line)
    root = {d: d for d in ids}
    for _ in range(20):
        for a, b in slow_near([by_line[d].text for d in ids]):
            root[ids[a]] = root[ids[b]] = min(root[ids[a]], root[ids[b]])
    assert set(left) == set(root.values())
    clean, kept = after("benchmark_decontamination", once)

    def shingles(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [shingles(r.text) for r in item_rows]
    assert all(items) and set(kept) == {d for d, r in left.items() if not any(len(x & shingles(r.text)) >= 0.8 * len(x) - 1e-9 for x in items)}
    packed, _ = after("packing", clean)
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_pipeline_stages_on_awkward_and_no_rows(spark, docs, none, tmp_path):
    shared.table(spark, SMALL, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, none):
        before = some
        for name, stage in corpus_pipeline.STAGES:
            out = shared.materialize(stage(spark, before, str(tmp_path)), "stage")
            if name != "packing":
                assert out.columns == some.columns
                assert name == "simhash_dedup" or name == "quality_rules" or out.count() == before.count()
            assert stage(spark, some, str(tmp_path)).count() >= 0
            before = out


def test_a_crowd_of_near_copies_is_joined_without_all_pairs(spark, monkeypatch):
    seen = {}
    real = near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", lambda df, label: seen.setdefault(label, real(df, label)))
    base = [f"u{x}" for x in range(400)]
    rows = [(i, " ".join([*base[: i % 390], f"e{i}", *base[i % 390 + 1 :]])) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in near_copies.drop_near_copies(docs, part=50).collect()] == [0]
    assert seen["crowds"].count() == 1 and seen["open-buckets"].count() == 0  # nothing is left to be dealt out as pairs of parts
    assert seen["band-links"].count() <= 32 * len(rows)


@pytest.mark.parametrize("sent_out", [True, False])
def test_a_crowd_moves_only_the_buckets_that_sets_share(spark, monkeypatch, sent_out):
    read, seen, real = {}, {}, near_copies.materialize

    def watched(df, label):
        read[label] = df.inputFiles()
        return seen.setdefault(label, real(df, label))

    monkeypatch.setattr(near_copies, "materialize", watched)
    if not sent_out:
        monkeypatch.setattr(near_copies, "bounded_broadcast", lambda df: df)
    rng, rows = np.random.default_rng(12), [" ".join(f"v{x}" for x in range(20 * i, 20 * i + 20)) for i in range(300)]
    base = [f"u{x}" for x in range(150)]
    for c in range(20):
        own = list(base)
        for at in rng.choice(150, max(1, c), replace=False):
            own[at] = f"e{rng.integers(0, 10**6)}"
        rows.append(" ".join(own))
    root, links = list(range(len(rows))), slow_near(rows)
    for _ in range(20):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs, part=3).collect()) == sorted(set(root))
    assert seen["open-buckets"].count() > 0 and seen["bands"].count() == 32 * len(rows)
    for label in ("open-buckets", "open-members"):  # the 300 sets that share no bucket aren't read for the crowd
        assert not [x for x in read[label] if "/bands-" in x]
    assert seen["crowd-members"].count() <= seen["shared-bands"].count() <= 32 * 20


def test_quality_with_clashing_names(spark):
    names = ["__chars_per_token", "__length", "language", "__own_0", "n_words", "__token_entropy"]
    docs = shared.table(spark, SMALL, "documents").select("doc_id", "text", "lang", *(F.lit(7).alias(c) for c in names))
    got = quality.measure_quality(docs)
    assert {tuple(r) for r in got.select(*(c for c in names if c != "n_words")).distinct().collect()} == {(7,) * 5}
    plain = quality.measure_quality(docs.select("doc_id", "text", "lang"))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "kept").collect())) == sorted(map(tuple, plain.select("doc_id", "n_words", "kept").collect()))


def test_a_stage_keeps_the_documents_own_columns(spark):
    docs = shared.table(spark, SMALL, "documents").select("*", F.lit(7).alias("n_removed"), F.lit(8).alias("n_lines"), F.lit(9).alias("__0"))
    got = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SMALL)
    assert got.columns == docs.columns and {tuple(r) for r in got.select("n_removed", "n_lines", "__0").distinct().collect()} == {(7, 8, 9)}


def test_toxicity_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"))
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    rows = []
    monkeypatch.setattr(toxicity, "fit", lambda hashes, *rest: rows.append(len(hashes)))
    toxicity.train(docs, labels, max_rows=10)
    assert rows == [3]


@pytest.mark.parametrize("n_items", [40, 20_000])
def test_what_is_searched_for_does_not_grow_with_the_items(spark, n_items):
    words = lambda lead, n: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.concat(F.lit(lead), F.col("id"), F.lit("w"), k)), " ")
    items = spark.range(n_items).select(F.col("id").alias("item_id"), words("i", 60).alias("text"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words("f", 400), F.when(F.col("id") < 20, words("i", 55)), words("g", 400)).alias("text"))
    assert decontaminate.sketched_share(docs, items) < 0.02
    found = decontaminate.find_contaminated(docs, items).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found)) == [(i, i) for i in range(20)]


def test_pipeline_workers_remember_few_words(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(pipeline, "keep_good", lambda docs, max_words: held.update(quality=max_words))
    monkeypatch.setattr(pipeline, "pack_instructions", lambda docs, path, max_words: held.update(packing=max_words))
    pipeline.quality_rules(spark, None, SMALL)
    pipeline.packing(spark, None, SMALL)
    assert set(held.values()) == {pipeline.WORDS_HELD} and pipeline.WORDS_HELD < 300_000
    words = [f"w{i}" for i in range(900)]
    path = public_tokenizers.path("word_bpe_49k.json")
    few, many = encoding.ChunkEncoder(path, False, 50), encoding.ChunkEncoder(path, False)
    assert list(few.encode(words)) == list(many.encode(words)) and len(few.young) + len(few.old) <= 100
