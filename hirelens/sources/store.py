"""The folder that driver and executors share: staged tables, and objects that are put once."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be sent to every executor.
MAX_BROADCAST = 48_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    return path


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again, so that its uses don't compute it anew."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, max_bytes: int = MAX_BROADCAST) -> DataFrame:
    """`df` (staged, since it is read here) with a broadcast hint if its rows' JSON has at most `max_bytes`, else as it
    is, for a join by shuffle."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


class Objects:
    """Named objects below a folder, for use in tasks. An object appears whole or not at all, and is never replaced."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")

    def _there(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.File

    def put(self, name: str, data: bytes) -> bool:
        """Writes an object if there is none of the name; says whether it did."""
        if self._there(name):
            return False
        path, own = f"{self.root}/{name}", f"{self.root}/_{uuid.uuid4().hex}"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(own, compression=None) as out:
            out.write(data)
        if self._there(name):
            self.fs.delete_file(own)
            return False
        self.fs.move(own, path)
        return True

    def get(self, name: str) -> bytes | None:
        if not self._there(name):
            return None
        with self.fs.open_input_stream(f"{self.root}/{name}", compression=None) as found:
            return found.read()

    def names(self, below: str) -> list[str]:
        """Names of the objects right below a folder; none if it isn't there."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{below}", allow_not_found=True))
        return sorted(f"{below}/{x.base_name}" for x in found if x.type == pafs.FileType.File)

    def make(self, below: str) -> None:
        self.fs.create_dir(f"{self.root}/{below}", recursive=True)
