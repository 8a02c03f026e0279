"""Calls of a service outside the cluster, made once per request and kept in a ledger.

A request's key is a hash of its content. The ledger is a folder: `claims` says what a task has begun to ask, `answers`
what came back, `failures` what went wrong. A task looks its bucket's answers up before it asks, and puts a batch's
answers down before it goes on; so a task that is run again, a later run, and any number of readers repeat no call that
was answered. Only a task that is lost between a call's return and its answers' first byte asks that one batch again; the
claim without an answer tells which.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.sources.store import Objects, staged

ANSWER_TYPES = {"string": pa.string(), "array<float>": pa.list_(pa.float32())}
BUCKETS = 64


def _table(columns: dict, schema: pa.Schema) -> bytes:
    out = io.BytesIO()
    pq.write_table(pa.Table.from_pydict(columns, schema=schema), out)
    return out.getvalue()


def call_once(requests: DataFrame, call: Callable[[list[dict]], list], root: str, answer: str = "string", size: int = 32, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(answers (call_key, answer), failures (call_key, error)) of `requests` (call_key and what `call` needs), with the
    ledger at `root`.

    `call` gets up to `size` requests as dicts and gives as many answers in order, None for none; an exception fails its
    batch, and a later run asks again. Requests of one key are one. As many tasks as buckets at most ask at once; a task
    holds a bucket's answered keys and one batch. All is done when this returns: failures are read from the ledger, and
    answers from a table that the tasks write of their buckets' answers, so that none is read from a file a batch again.
    answer: string or array<float>.
    """
    spark = requests.sparkSession
    answered = pa.schema([("call_key", pa.string()), ("answer", ANSWER_TYPES[answer])])
    failed = pa.schema([("call_key", pa.string()), ("error", pa.string())])

    def ask(store: Objects, bucket: int, rows: list[dict]):
        keys = [r["call_key"] for r in rows]
        name = hashlib.sha256("\n".join(keys).encode()).hexdigest()
        store.put(f"claims/bucket={bucket}/{name}.json", json.dumps(keys).encode())
        try:
            said = list(call(rows))
            if len(said) != len(rows):
                raise ValueError(f"{len(rows)} requests, {len(said)} answers")
            made = pa.RecordBatch.from_pydict({"call_key": keys, "answer": said}, schema=answered)
            data = _table({"call_key": keys, "answer": said}, answered)
        except Exception as e:  # noqa: BLE001  whatever the service does, the batch is on record and others go on
            store.put(f"failures/bucket={bucket}/{name}-{uuid.uuid4().hex}.parquet", _table({"call_key": keys, "error": [repr(e)] * len(keys)}, failed))
        else:
            store.put(f"answers/bucket={bucket}/{name}.parquet", data)
            yield made

    def run(batches):
        store, bucket, done, waiting = Objects(root), None, set(), []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    if waiting:
                        yield from ask(store, bucket, waiting)
                    bucket, waiting, done = row["bucket"], [], set()
                    for x in store.names(f"answers/bucket={bucket}"):
                        held = pq.read_table(io.BytesIO(store.get(x)), schema=answered)
                        done.update(held.column(0).to_pylist())
                        yield from held.to_batches()
                if row["call_key"] not in done:
                    waiting.append({c: x for c, x in row.items() if c != "bucket"})
                if len(waiting) == size:
                    yield from ask(store, bucket, waiting)
                    waiting = []
        if waiting:
            yield from ask(store, bucket, waiting)

    for kind in ("claims", "answers", "failures"):
        Objects(root).make(kind)
    once = requests.where("call_key IS NOT NULL").dropDuplicates(["call_key"]).withColumn("bucket", F.pmod(F.xxhash64("call_key"), F.lit(buckets)).cast("int"))
    answers = staged(once.repartition(buckets, "bucket").sortWithinPartitions("bucket", "call_key").mapInArrow(run, f"call_key string, answer {answer}"), "answers")
    failures = spark.read.schema("call_key string, error string").parquet(f"{root}/failures").join(answers, "call_key", "left_anti")
    return answers, failures.groupBy("call_key").agg(F.max("error").alias("error"))
