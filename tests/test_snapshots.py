"""The streaming reconcile against the batch one, whatever order files come in."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hirelens.operators import snapshot as S
from hirelens.streaming import snapshots

ROWS = "kind string, source_id string, at timestamp, external_job_id string, seq long, title string"


def day(n):
    return datetime.datetime(2024, 1, n)


def batch_state(spark, events):
    """By `reconcile`, one whole snapshot after the other."""
    state = spark.createDataFrame([], "source_id string, external_job_id string, id string, status string, last_seen_at timestamp, created_at timestamp, updated_at timestamp, title string")
    for n in sorted({at for kind, _, at, *_ in events if kind == "end"}):
        ended = {s for kind, s, at, *_ in events if kind == "end" and at == n}
        rows = [(s, e, q, t) for kind, s, at, e, q, t in events if kind == "row" and at == n and s in ended]
        landed = spark.createDataFrame(rows, "source_id string, external_job_id string, seq long, title string")
        new = S.reconcile(state, S.last_wins(landed), F.lit(day(n)), ["title"]).drop("action")
        state = spark.createDataFrame(new.select(*state.columns).collect(), state.schema)
    return state


def plain(df):
    return sorted(map(tuple, df.select("source_id", "external_job_id", "id", "status", "created_at", "last_seen_at", "updated_at", "title").collect()))


def run(spark, tmp_path, files, calls=1):
    root, path = f"{tmp_path}/state", f"{tmp_path}/landed"
    for k in range(calls):
        for some in files[k * len(files) // calls : (k + 1) * len(files) // calls]:
            spark.createDataFrame([(k, s, day(at), *x) for k, s, at, *x in some], ROWS).coalesce(1).write.mode("append").parquet(path)
        snapshots.reconcile_snapshots(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(path), root, ["title"], 3)
    return root


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_state(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = []
    for source in "ab":
        for n in (1, 2, 3, 4):
            if (source, n) != ("b", 3):  # b's third snapshot never ends
                events.append(("end", source, n, None, None, None))
            events += [("row", source, n, f"k{k}", q, f"{source}{n}{k}{q}") for k in range(12) for q in range(1 + k % 2) if rng.random() < 0.6]
    # a source's snapshot without rows changes nothing in the batch form, which can't tell it from a missing source
    order = events + rng.sample(events, 10)  # some again
    rng.shuffle(order)
    files = [order[k::5] for k in range(5)]
    root = run(spark, tmp_path, files, calls=2)
    assert plain(snapshots.read_reconciled(spark, root, "title string")) == plain(batch_state(spark, events))


def test_only_an_end_mark_closes(spark, tmp_path):
    row = lambda n, key: ("row", "a", n, key, None, f"{key}{n}")
    end, failed = ("end", "a", 1, None, None, None), ("failed", "a", 2, None, None, None)
    root = run(spark, tmp_path, [[row(1, "x")], [row(1, "y"), end], [row(2, "x"), ("end", "b", 2, None, None, None)], [failed], [end, row(1, "x")]])
    changes = snapshots.read_changes(spark, root).orderBy("batch", "external_job_id").select("batch", "external_job_id", "action", "status").collect()
    assert list(map(tuple, changes)) == [(1, "x", "insert", "open"), (1, "y", "insert", "open")]  # one snapshot of two files; nothing later counts
    assert {r.title for r in snapshots.read_reconciled(spark, root, "title string").collect()} == {"x1", "y1"}


def test_closed_form():
    seen = None
    for at, seq, payload in [(3, 1, "c"), (1, None, "a"), (3, None, "d"), (3, 2, "b"), (2, 9, "z")]:
        seen = snapshots.fold(seen, at, seq, payload)
    assert seen == (1, 3, 2, "b")
    assert snapshots.status_of(seen, [1, 3]) == ("open", 3) and snapshots.status_of(seen, [1, 3, 5, 7]) == ("closed", 5)
