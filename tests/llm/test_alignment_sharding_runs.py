"""Token alignment, sharding and periodic runs against brute force, and on awkward rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hirelens.llm import periodic_runs, shared, sharding, token_alignment
from tests.llm.test_operators import AWKWARD, DOCS, ENCODED, SMALL, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *"xxxxxx") for r in AWKWARD], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# token alignment


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner(A, B)


def whole(aligner, text):
    """Groups of ids by the whole text's tokens' bytes."""
    if not text:
        return []
    ids_a, ids_b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    if b"".join(aligner.bytes_a[i] for i in ids_a) != (" " + text).encode() or b"".join(aligner.bytes_b[i] for i in ids_b) != (" " + text).encode():
        return []
    ends_a, ends_b = (np.cumsum([len(known[i]) for i in ids]).tolist() for known, ids in ((aligner.bytes_a, ids_a), (aligner.bytes_b, ids_b)))
    at_a, at_b = ({end: i for i, end in enumerate(ends, 1)} for ends in (ends_a, ends_b))
    out, x, y = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i, j = at_a[end], at_b[end]
        out.append((ids_a[x:i], ids_b[y:j]))
        x, y = i, j
    return out


def shown(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


ODD = ["<s> </s><unk> <|endoftext|> <0x41> x", " ", "  ", "\n", "a▁b", "日本語 éà", "हिन्दी 🧑‍🚀 ﷽", "don't 'll we're", "\x00a b", "𐐀漢𐐀é", "4漢b\rİс"]


@pytest.mark.parametrize("apart", [True, False])
def test_alignment_is_that_of_whole_texts(spark, aligner, apart):
    held = token_alignment.Aligner(A, B, max_parts=500)
    assert held.apart
    held.apart = apart
    rng, letters = np.random.default_rng(8), list("abÉé'sstre .,\n!3 4<|>_\t İßǆ×ɏ漢́²“”…€Яй 🙂𐐀\r▁\x1c　̣")
    some = [r.text for r in texts(spark)[:60]] + [t for _, t, *_ in AWKWARD] + ENCODED + ODD
    some += ["".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(0, 40))) for _ in range(2000)]
    got = [x for k in range(0, len(some), 100) for x in held.align(some[k : k + 100])]
    want = [whole(aligner, t) for t in some]
    assert [g for g, _ in got] == [shown(w) for w in want]
    codes = held.codes
    for (_, links), w in zip(got, want, strict=True):
        assert [(int(codes[p]), n, m) for p, n, m in links.tolist()] == [(a[-1] << 32 | b[-1], len(a), len(b)) for a, b in w]


def counted(aligner, rows):
    """op11's columns of (doc_id, text) rows, sorted."""
    aligned = [(i, whole(aligner, t)) for i, t in rows]
    counts = Counter((a[-1], b[-1]) for _, w in aligned for a, b in w)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, w in aligned:
        links = [(a[-1], b[-1]) for a, b in w]
        out.append((i, sum(len(a) for a, _ in w), sum(len(b) for _, b in w), len(w), len(w), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(shown(w)) if w else ""))
    return sorted(out, key=str)


def test_alignment_query(spark, aligner):
    rows = [(r.doc_id, r.text) for r in texts(spark)]
    assert sorted(map(tuple, token_alignment.op11_token_alignment(spark, SMALL).collect()), key=str) == counted(aligner, rows)


def test_alignment_awkward(spark, docs, aligner):
    odd = docs.select("doc_id", "text", "k").unionByName(spark.createDataFrame([(100 + i, t, "k") for i, t in enumerate(ODD)], "doc_id long, text string, k string"))
    got = token_alignment.align_texts(odd, A, B, keep_groups=True)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.drop("groups").collect()), key=str) == counted(aligner, rows)
    assert got.where("n_a > 0 AND sha2(groups, 256) <> groups_sha256 OR n_a = 0 AND groups <> ''").count() == 0
    assert token_alignment.align_texts(docs.where("false"), A, B).collect() == []


# sharding


def ring_by_brute_force(rows, nodes, bounds):
    """Each row of (place, key) put down one by one: first those whose home has room, then the others, clockwise."""
    free, out, over = list(bounds), {}, []
    order = sorted(range(len(rows)), key=lambda i: rows[i])
    home = {i: next((k for k, (place, _) in enumerate(nodes) if place >= rows[i][0]), 0) for i in order}
    last = nodes[-1][0]
    for i in order:
        s = nodes[home[i]][1]
        if free[s]:
            out[i], free[s] = s, free[s] - 1
        else:
            over.append(i)
    for i in over:
        k = home[i]
        while not free[nodes[k % len(nodes)][1]]:
            k += 1
        out[i] = nodes[k % len(nodes)][1]
        free[out[i]] -= 1
    return [nodes[home[i]][1] for i in range(len(rows))], [out[i] for i in range(len(rows))], last


@pytest.mark.parametrize(("shards", "virtual", "hot"), [(5, 4, 0), (7, 3, 150), (3, 1, 400)])
def test_ring(spark, shards, virtual, hot):
    plain = [(i, f"text {i % 311}") for i in range(400)] + [(1000 + i // 2, "hot") for i in range(hot)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in plain], "doc_id long, text string, node long, place string").repartition(5)
    got = sharding.shard_rows(frame, shards, virtual).join(frame.groupBy("doc_id").agg(F.first("text").alias("text")), "doc_id")
    got = got.select("doc_id", F.xxhash64("text").alias("place"), "text_crc32", "home", "shard", "slot", "size", F.octet_length("text").alias("n")).collect()
    nodes = sorted(tuple(r) for r in spark.range(1).select(sharding.node_places(shards, virtual).alias("x")).select("x.place", "x.shard").collect())
    rows = [(r.place, r.text_crc32, r.doc_id) for r in got]
    home, shard, _ = ring_by_brute_force(rows, nodes, sharding.quotas(len(rows), shards))
    assert [r.home for r in got] == home
    assert Counter((x, s) for x, s in zip(rows, shard, strict=True)) == Counter(((r.place, r.text_crc32, r.doc_id), r.shard) for r in got)
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / shards) < 1
    assert all(r.size == r.n + 16 for r in got)


def test_sharding_query(spark):
    got = sharding.op12_sharding(spark, SMALL).collect()
    known = {r.doc_id: r.text or "" for r in texts(spark)}
    assert sorted(r.doc_id for r in got) == sorted(known)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(known[r.doc_id].encode()) + 16, zlib.crc32(known[r.doc_id].encode()), "rows", None) for r in got)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s, n in enumerate(sharding.quotas(len(got), 40)) for k in range(n)]


def test_a_further_shard_moves_few_rows(spark):
    frame = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    before, after = (sharding.shard_rows(frame, n).select("doc_id", F.col("shard").alias(c)) for n, c in ((40, "a"), (41, "b")))
    moved = before.join(after, "doc_id").where("a <> b").count()
    assert 8000 / 41 <= moved < 0.2 * 8000  # dealing out by a remainder moves 40 of 41


def test_sharding_awkward(spark, docs):
    got = sharding.shard_rows(docs, 4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in AWKWARD)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s, n in enumerate(sharding.quotas(len(AWKWARD), 4)) for k in range(n)]
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (1, 2)} == {(16, 0)}
    assert sharding.shard_rows(docs.where("false")).collect() == []
    assert [r.slot for r in sharding.shard_rows(docs.where("doc_id = 4")).collect()] == [0]


# periodic runs


def runs_by_brute_force(words):
    out, ids = set(), np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
    for q in range(1, len(words) // 4 + 1):
        same = np.concatenate(([0], (ids[q:] == ids[:-q]).astype(int), [0]))
        for i, j in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            run = ids[i : j + q].tolist()
            if len(run) >= max(6, 4 * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.add((int(i), len(run), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_row(doc_id, text, tails):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    if tails and doc_id is not None and h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_brute_force(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_runs():
    rng, some = np.random.default_rng(3), []
    for k in range(3000):
        words = [str(x) for x in rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))]
        for _ in range(3 * (k % 2)):
            period = int(rng.integers(1, 9))
            words += ([str(x) for x in rng.integers(0, 3, period)] * 8)[: int(rng.integers(period, 8 * period))]
        some.append(words)
    got = [x[-1] for k in range(0, len(some), 100) for x in periodic_runs._digests(some[k : k + 100])]
    assert got == [runs_by_brute_force(w) for w in some] and sum(map(len, got)) > 1000


def test_runs_query(spark):
    got = sorted(map(tuple, periodic_runs.op13_periodic_runs(spark, SMALL).collect()))
    want = [runs_row(r.doc_id, r.text, True) for r in texts(spark)]
    assert got == want and sum(x[1] > 0 for x in want) > 5


def test_runs_awkward(spark, docs, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TOGETHER", 20)
    more = [(20, "a " * 6), (21, "a " * 5), (22, "x " + "a b c " * 3 + "a b"), (23, "x " + "a b c " * 4 + "\u00a0 y"), (24, "a a a a a a b b b b b b")]
    rows = docs.select("doc_id", "text", "k").unionByName(spark.createDataFrame([(*r, "k") for r in more], "doc_id long, text string, k string"))
    want = sorted((runs_row(r.doc_id, r.text, False) for r in rows.where("text is null or length(text) < 1000").collect()), key=str)
    got = periodic_runs.periodic_runs(rows, keep_texts=True)
    kept = {r.doc_id: (r.collapsed, r.runs) for r in got.collect()}
    assert kept[22][0] == more[2][1].strip() and kept[23][0] == "x a b c \u00a0 y" and kept[24][0] == "a b" and tuple(kept[23][1][0]) == (1, 12, 3)
    assert sorted((tuple(r) for r in got.where("doc_id is null or doc_id <> 6").drop("collapsed", "runs").collect()), key=str) == want
    assert periodic_runs.periodic_runs(docs.where("false")).collect() == []
