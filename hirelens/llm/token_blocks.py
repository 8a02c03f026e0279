"""Token ids as binary files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending doc_id order:

    b"PFR1" | blocks | block starts (u64 each) | documents (doc_id i64, has_id u8, n_tokens u64: three arrays)
    | n_tokens u64, n_blocks u64, n_docs u64, n_bytes_of_blocks u64

Each block codes BLOCK ids (the last one fewer): its minimum (u32), count (u16), width (u8), number of exceptions
(u16), the ids less the minimum packed at `width` bits, then exception positions (u16 each) and values (u32
each). The width is that of the percentile in PERCENTILES that makes the block smallest; wider ids are
exceptions. Block starts allow reading any span of ids without what stands before it.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm.encoding import encoder, slices
from hirelens.llm.shared import fresh_path, table

MAGIC, BLOCK = b"PFR1", 512
PERCENTILES = (90, 95, 98, 99, 100)
NONE = np.zeros(0, np.int64)
HEAD, TAIL = struct.Struct("<IHBH"), struct.Struct("<QQQQ")
END_ID, FILE_BLOCKS = 2, 2048
#: Widths whose packed bits are plain little-endian integers.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray) -> list[bytes]:
    """Codes of consecutive blocks of `ids` (unsigned 32-bit)."""
    out: list[bytes] = [b""] * -(-len(ids) // BLOCK)
    whole = len(ids) // BLOCK
    _pack_rows(ids[: whole * BLOCK].reshape(whole, BLOCK), out, 0)
    if whole < len(out):
        _pack_rows(ids[whole * BLOCK :].reshape(1, -1), out, whole)
    return out


def _pack_rows(rows: np.ndarray, out: list[bytes], first: int) -> None:
    if not len(rows):
        return
    n = rows.shape[1]
    low = rows.min(axis=1)
    offsets = rows - low[:, None]
    at = [max(0, -(-n * p // 100) - 1) for p in PERCENTILES]
    widths = _bit_length(np.partition(offsets, sorted(set(at)), axis=1)[:, at])
    past = n - 1 - np.array(at)
    cost = widths * n + past[None, :] * 48
    width = widths[np.arange(len(rows)), cost.argmin(axis=1)]
    for w in np.unique(width):
        picked = np.flatnonzero(width == w)
        some = offsets[picked]
        wide = some >> np.uint32(w) > 0 if w < 32 else np.zeros(some.shape, bool)
        kept, any_wide = np.where(wide, np.uint32(0), some), wide.any(axis=1)
        if int(w) in WHOLE:
            packed = kept.astype(WHOLE[int(w)]).view(np.uint8)
        else:
            bits = np.empty((len(picked), n, w), dtype=np.uint8)
            for k in range(w):
                bits[:, :, k] = kept >> np.uint32(k) & np.uint32(1)
            packed = np.packbits(bits.reshape(len(picked), n * int(w)), axis=1, bitorder="little")
        for j, i in enumerate(picked):
            odd = np.flatnonzero(wide[j]) if any_wide[j] else NONE
            out[first + i] = (
                HEAD.pack(int(low[i]), n, int(w), len(odd)) + packed[j].tobytes() + odd.astype("<u2").tobytes() + some[j, odd].astype("<u4").tobytes()
            )


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def unpack(data: bytes) -> np.ndarray:
    """The ids of consecutive blocks."""
    at, found = 0, []
    while at < len(data):
        low, n, w, odd = HEAD.unpack_from(data, at)
        at += HEAD.size
        size = -(-n * w // 8)
        if w in WHOLE:
            ids = np.frombuffer(data, WHOLE[w], n, at).astype(np.uint32)
        else:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * w].reshape(n, w)
            ids = (bits @ (1 << np.arange(w, dtype=np.uint32)) if w else np.zeros(n)).astype(np.uint32)
        at += size
        ids[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
        at += 6 * odd
        found.append(ids + np.uint32(low))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


class Writer:
    """Writes one file block by block. The name is taken only on close, so that a task that is run again, or
    twice at once, leaves one whole file."""

    def __init__(self, uri: str, name: str):
        self.fs, root = pafs.FileSystem.from_uri(uri)
        self.path, self.own = f"{root}/{name}", f"{root}/_{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(MAGIC)
        self.held: list[bytes] = []
        self.n_held = self.n_tokens = 0
        self.starts, self.at, self.docs = [], len(MAGIC), []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= BLOCK * FILE_BLOCKS:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for code in pack(ids[:n]):
            self.starts.append(self.at)
            self.out.write(code)
            self.at += len(code)
        self.n_tokens += n
        self.held, self.n_held = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> tuple[str, int, int]:
        self._flush(self.n_held)
        ids, known, sizes = zip(*self.docs, strict=True)
        for x, kind in ((self.starts, "<u8"), (ids, "<i8"), (known, "u1"), (sizes, "<u8")):
            self.out.write(np.asarray(x, dtype=kind).tobytes())
        self.out.write(TAIL.pack(self.n_tokens, len(self.starts), len(self.docs), self.at))
        self.out.close()
        self.fs.move(self.own, self.path)
        return self.path, self.n_tokens, len(self.docs)


class Reader:
    """Reads spans of ids, and the documents' sizes, of one file."""

    def __init__(self, uri: str, name: str):
        fs, root = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(f"{root}/{name}")
        end = self.file.size() - TAIL.size
        self.n_tokens, n_blocks, n_docs, at = TAIL.unpack(self.file.read_at(TAIL.size, end))
        tail = self.file.read_at(end - at, at)
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is no token file")
        self.starts = np.append(np.frombuffer(tail, "<u8", n_blocks), np.uint64(at))
        at = 8 * n_blocks
        self.doc_ids = np.frombuffer(tail, "<i8", n_docs, at)
        self.known = np.frombuffer(tail, "u1", n_docs, at + 8 * n_docs)
        self.sizes = np.frombuffer(tail, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)

    def ids(self, start: int, length: int) -> np.ndarray:
        """`length` ids from the file's id `start` on; reads only the blocks that hold them."""
        if not length:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + length - 1) // BLOCK
        a, b = int(self.starts[first]), int(self.starts[last + 1])
        return unpack(self.file.read_at(b - a, a))[start - first * BLOCK :][:length]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of each document, holding some blocks or one document at a time."""
        ends = np.cumsum(self.sizes)
        i = at = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, at + BLOCK * FILE_BLOCKS, "right")))
            ids, base = self.ids(at, int(ends[j - 1]) - at), at
            for k in range(i, j):
                yield (int(self.doc_ids[k]) if self.known[k] else None), at, ids[at - base : int(ends[k]) - base]
                at = int(ends[k])
            i = j


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, leading_space: bool = True, end_id: int = END_ID) -> None:
    """Encodes whole texts of `docs` (doc_id, text) and writes them to the folder `uri`, which driver and
    executors must share, with a `manifest.json` of the files in order.

    Documents are in ascending doc_id order, those without an id first; rows that share an id in the order of a hash
    of their texts, then of the texts, each kept. Null texts are empty; every document ends with `end_id`. No rows: no files. Columns
    other than doc_id and text are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("tie"))
    dealt = dealt.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    pafs.FileSystem.from_uri(uri)[0].create_dir(pafs.FileSystem.from_uri(uri)[1])

    def write(batches):
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for some in slices(batch):
                ids = encoder(tokenizer, leading_space).encode(some.column(1).to_pylist(), end_id)
                writer = writer or Writer(uri, f"part-{part:06d}.pfr")
                for doc_id, x in zip(some.column(0).to_pylist(), ids, strict=True):
                    writer.add(doc_id, x)
        if writer:
            _, n_tokens, n_docs = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "n_tokens": [n_tokens], "n_docs": [n_docs]}, schema=written)

    written = pa.schema([("part", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
    files = sorted(dealt.mapInArrow(write, "part long, n_tokens long, n_docs long").collect())  # a row per file
    start, manifest = 0, []
    for part, n_tokens, n_docs in files:
        manifest.append({"file": f"part-{part:06d}.pfr", "start": start, "n_tokens": n_tokens, "n_docs": n_docs})
        start += n_tokens
    fs, root = pafs.FileSystem.from_uri(uri)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """Reads every file of a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, each
    computed from the decoded ids. One task per file, which holds a few blocks or one document at a time."""
    fs, root = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        files = [(x["file"], x["start"]) for x in json.loads(f.read())]
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list = []
                for doc_id, start, ids in Reader(uri, name).documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=kind)

    listed = spark.createDataFrame(files, "file string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_blocks(spark, sf_dir: str) -> DataFrame:
    uri = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), uri if "://" in uri else f"file://{uri}", public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, uri if "://" in uri else f"file://{uri}")
