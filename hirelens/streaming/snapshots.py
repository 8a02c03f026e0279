"""Full snapshots that arrive in pieces, reconciled as a stream with state per source.

A stream has rows of snapshots and marks: `end` says that a source's snapshot is whole, `failed` that it never will be.
Rows wait until their snapshot's end mark, which alone makes them count and closes what the snapshot lacks. Marks and
rows may come in any order, in one micro-batch or several, more than once, and after later snapshots: what a source's
whole snapshots say about a key is a function of the set of them,

    created_at   the first snapshot that has the key
    last_seen_at the last one, whose row of greatest seq gives the values
    status       closed if a later snapshot is whole, and updated_at is then the first such one

so the state is that of the batch reconcile over the same snapshots by time. State is kept per source and bucket of
keys, so a large source spreads over tasks; marks go to each of a source's buckets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 16
CHANGES = "source_id string, bucket int, external_job_id string, change long, action string, status string, created_at long, last_seen_at long, updated_at long, seq long, payload string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: (created_at, last_seen_at, seq, payload) of a key, in microseconds.
Seen = tuple[int, int, int | None, str | None]


def fold(held: Seen | None, at: int, seq: int | None, payload: str | None) -> Seen:
    """What is known of a key after a row of a whole snapshot. A null seq comes before all others; of equal ones the
    greater payload counts."""
    order = lambda t, s, p: (t, s is not None, s or 0, p is not None, p or "")
    if held is None:
        return at, at, seq, payload
    first, last, old_seq, old_payload = held
    if order(at, seq, payload) > order(last, old_seq, old_payload):
        last, old_seq, old_payload = at, seq, payload
    return min(first, at), last, old_seq, old_payload


def status_of(seen: Seen, ends: list[int]) -> tuple[str, int]:
    """(status, updated_at) by the times of whole snapshots, ascending."""
    k = bisect_right(ends, seen[1])
    return ("open", seen[1]) if k == len(ends) else ("closed", ends[k])


class SnapshotProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "external_job_id string, created_at long, last_seen_at long, seq long, payload string")
        self.waiting = handle.getListState("waiting", "at long, external_job_id string, seq long, payload string")
        self.ends = handle.getListState("ends", "at long")
        self.change = handle.getValueState("change", "n long")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        marks: dict[str, set[int]] = {"end": set(), "failed": set()}
        fresh: list[tuple] = []
        for frame in rows:
            for kind, at, ext, seq, payload in zip(*(frame[c].tolist() for c in ("kind", "at", "external_job_id", "seq", "payload")), strict=True):
                if kind == "row":
                    fresh.append((int(at), ext, None if seq is None else int(seq), payload))
                else:
                    marks[kind].add(int(at))
        before = sorted({int(x[0]) for x in self.ends.get()}) if self.ends.exists() else []
        ends = sorted({*before, *marks["end"]})
        if ends != before:
            self.ends.put([(x,) for x in ends])
        whole = set(ends)
        if not marks["end"] and not marks["failed"] and not any(x[0] in whole for x in fresh):
            if fresh:  # nothing counts yet: what has come waits, without a look at what is known
                self.waiting.appendList(fresh)
            return
        waiting = [tuple(x) for x in self.waiting.get()] + fresh if self.waiting.exists() else fresh
        later = [x for x in waiting if x[0] not in whole and x[0] not in marks["failed"]]
        old: dict[str, Seen] = {x[0]: tuple(x[1:]) for x in self.seen.get()} if self.seen.exists() else {}
        new = dict(old)
        for at, ext, seq, payload in waiting:
            if at in whole:
                new[ext] = fold(new.get(ext), at, seq, payload)
        self.waiting.put(later) if later else self.waiting.clear()
        if new != old:
            self.seen.put([(ext, *x) for ext, x in new.items()])
        changed = []
        for ext, x in new.items():
            now, was = status_of(x, ends), status_of(old[ext], before) if ext in old else None
            if x != old.get(ext) or now != was:
                action = "insert" if was is None else "close" if now[0] == "closed" and was[0] == "open" else "update"
                changed.append((ext, action, *now, x))
        if changed:
            n = int(self.change.get()[0]) + 1 if self.change.exists() else 1
            self.change.update((n,))
            yield pd.DataFrame({
                "source_id": key[0], "bucket": int(key[1]), "external_job_id": [c[0] for c in changed], "change": n, "action": [c[1] for c in changed], "status": [c[2] for c in changed],
                "created_at": [c[4][0] for c in changed], "last_seen_at": [c[4][1] for c in changed], "updated_at": [c[3] for c in changed],
                "seq": pd.array([c[4][2] for c in changed], "Int64"), "payload": [c[4][3] for c in changed],
            })

    def close(self) -> None:
        pass


def changes_of(landed: DataFrame, payload: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The stream of changes of a stream `landed` (kind: row, end or failed; source_id, at; of rows also
    external_job_id, seq and the payload columns). Rows without a source, time or key, and other kinds, are ignored."""
    whole = landed.where("source_id IS NOT NULL AND at IS NOT NULL AND (kind IN ('end', 'failed') OR kind = 'row' AND external_job_id IS NOT NULL)")
    own = F.array(F.pmod(F.xxhash64("external_job_id"), F.lit(buckets)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    dealt = whole.select(
        "source_id", F.explode(F.when(F.col("kind") == "row", own).otherwise(every)).alias("bucket"), "kind", F.unix_micros("at").alias("at"),
        "external_job_id", F.col("seq").cast("long").cast("string").alias("seq"), F.to_json(F.struct(*payload)).alias("payload"),
    )
    return dealt.groupBy("source_id", "bucket").transformWithStateInPandas(SnapshotProcessor(), CHANGES, "Append", "None")


def reconcile_snapshots(landed: DataFrame, root: str, payload: list[str], buckets: int = BUCKETS, partitions: int | None = None) -> None:
    """Brings all that has landed into `root`: each micro-batch's changes are a folder named by its number, which a
    batch that is run again overwrites with the same changes. State stays in `root`/log for the next call.

    partitions: of the state, which the first call fixes (default: the session's shuffle partitions). The session needs
    the RocksDB state store; both are set here for the time of the call."""
    spark = landed.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    held = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={number}")

    try:
        stream = changes_of(landed, payload, buckets).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{root}/log")
        stream.trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in held.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{CHANGES}, batch long").option("basePath", f"{root}/changes").parquet(f"{root}/changes")


def read_reconciled(spark: SparkSession, root: str, payload: str) -> DataFrame:
    """The state: of each key its last change. payload: DDL of the payload columns."""
    rest = F.struct("status", "created_at", "last_seen_at", "updated_at", "payload")
    last = read_changes(spark, root).groupBy("source_id", "external_job_id").agg(F.max_by(rest, "change").alias("x"))  # merged before the shuffle
    times = [F.timestamp_micros(f"x.{c}").alias(c) for c in ("created_at", "last_seen_at", "updated_at")]
    made = F.sha2(F.concat_ws("|", "source_id", "external_job_id"), 256).alias("id")
    return last.select("source_id", "external_job_id", made, "x.status", *times, F.from_json("x.payload", payload).alias("p")).select("*", "p.*").drop("p")
