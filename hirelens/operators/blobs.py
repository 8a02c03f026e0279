"""Contents under the hash of what they hold: pointers in rows, gzip objects in a folder that are put once."""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.operators.requirements import canonical_json
from hirelens.sources.store import Objects, staged

# Where contents of a kind lie, and what they are called.
HTML, RAW = ("job-html", ".html.gz"), ("job-raw", ".json.gz")


def payload_text(c: Column) -> Column:
    """The JSON that is stored of a raw payload; null for null, `{}`, `[]` and what is no JSON."""
    made = canonical_json(c)
    return F.when(~made.isin("null", "{}", "[]"), made)


def with_pointers(rows: DataFrame, html: str = "description_html", raw: str = "raw_payload") -> tuple[DataFrame, DataFrame]:
    """(`rows` with description_html_key and _hash and raw_payload_key and _hash in place of the two texts, contents (key,
    sha256, content) of theirs, each once). Blank texts and empty payloads have no pointer."""
    texts = {"description_html": F.when(F.trim(html) != "", F.col(html)), "raw_payload": payload_text(F.col(raw))}
    got = rows.withColumns({f"__{n}": c for n, c in texts.items()})
    contents = None
    for (name, _), (folder, ending) in zip(texts.items(), (HTML, RAW), strict=True):
        sha = F.sha2(f"__{name}", 256)
        got = got.withColumns({f"{name}_hash": sha, f"{name}_key": F.concat(F.lit(f"{folder}/"), sha, F.lit(ending))})
    got = staged(got, "pointed")
    for name in texts:
        own = got.where(F.col(f"{name}_key").isNotNull()).select(F.col(f"{name}_key").alias("key"), F.col(f"{name}_hash").alias("sha256"), F.col(f"__{name}").alias("content"))
        contents = own if contents is None else contents.unionByName(own)
    return got.drop(html, raw, *(f"__{n}" for n in texts)), contents.dropDuplicates(["key"])


def put_contents(contents: DataFrame, folder: str) -> DataFrame:
    """(key, written) of `contents` (key, content), put into `folder` by the tasks that have them. What is there already
    is not written again. All is done when this returns."""

    def run(batches):
        store = Objects(folder)
        for batch in batches:
            pairs = zip(*(batch.column(c).to_pylist() for c in ("key", "content")), strict=True)
            written = [store.put(key, gzip.compress(text.encode(), mtime=0)) for key, text in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(written, pa.bool_())], names=["key", "written"])

    Objects(folder).make("")
    return staged(contents.select("key", "content").mapInArrow(run, "key string, written boolean"), "put")


def read_contents(pointers: DataFrame, folder: str) -> DataFrame:
    """(key, sha256, state, content) of `pointers` (key, sha256): ok, missing, or damaged if what is there doesn't have
    the hash; content only if it is ok."""

    def look(store: Objects, key: str, sha: str) -> tuple[str, str | None]:
        data = store.get(key)
        if data is None:
            return "missing", None
        try:
            raw = gzip.decompress(data)
        except (OSError, EOFError):
            return "damaged", None
        return ("ok", raw.decode()) if hashlib.sha256(raw).hexdigest() == sha else ("damaged", None)

    def run(batches):
        store = Objects(folder)
        for batch in batches:
            found = [look(store, k, s) for k, s in zip(*(batch.column(c).to_pylist() for c in ("key", "sha256")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("sha256"), *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], names=["key", "sha256", "state", "content"])

    return pointers.select("key", "sha256").mapInArrow(run, "key string, sha256 string, state string, content string")
