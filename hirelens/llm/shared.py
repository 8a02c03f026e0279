"""Helpers that the training-data operators share: the shared folder, cut lineage, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that may be sent to every executor.
MAX_BROADCAST = 48_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset, a local session gets one
    of its own; a cluster must name one, since its executors can't see this machine's folders."""
    path, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if path is None and held.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    if held.isEmpty():
        context.setCheckpointDir(path)
    return path or held.get()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back: lineage ends at the files,
    which outlive any executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _value_bytes(name: str, kind: T.DataType) -> F.Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(c) + 8
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.octet_length(F.array_join(c, "")) + 16 * F.size(c)
    return 8 * F.greatest(F.size(c), F.lit(0)) + 16 if isinstance(kind, T.ArrayType) else F.lit(16)


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST) -> DataFrame:
    """`df` with a broadcast hint if its summed-up size proves that it has at most `max_bytes`, else unchanged: Spark
    then shuffles both sides, and splits a key that is too frequent. `df` should be materialised, since it is read here
    for the sum."""
    each = sum((F.coalesce(_value_bytes(f.name, f.dataType), F.lit(0)).cast("long") for f in df.schema), F.lit(32).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= max_bytes else df


def words(text) -> F.Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column, A-Z lower-cased; null: none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def row_key(doc_id: str | F.Column = "doc_id", text: str | F.Column = "text") -> F.Column:
    """A 64-bit key of a document row. Rows with equal id and text share it, as they share every result. Joins on it
    compare the ids too, so that no other document is ever taken for it."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return F.xxhash64(doc_id.cast("string"), F.coalesce(text, F.lit("")))
