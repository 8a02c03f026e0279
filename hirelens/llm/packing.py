"""Vector bin packing of token sequences.

A sequence has three limits at once: tokens, segments (pieces), and loss-bearing tokens. Each task packs the
documents of its partition, some hundreds at a time and as many as a full sequence takes: whole sequences are cut off
long documents first; then, bin by bin, the document with the largest dot product of its demand with the bin's free room is placed, both measured
in shares of the limits. If none fits in whole, one is cut to fill the bin. What stays under-filled at the end of a
task's rows is packed once more with that of other tasks, so few sequences in all need padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.encoding import encoder, slices
from hirelens.llm.shared import materialize, table

END_ID, BUFFER, TASK_SEQUENCES = 1, 256, 256


@dataclass(frozen=True)
class Limits:
    """Of one sequence. Loss-bearing tokens are a document's last ones."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


#: At most three quarters of a sequence bear loss, where half of all tokens do.
INSTRUCTIONS, LOSS_SHARE = Limits(2048, 256, 1536), 0.5


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int
    loss_from: int  # in the document

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def loss(self, length: int | None = None) -> int:
        end = self.start + (self.length if length is None else length)
        return max(0, end - max(self.start, self.loss_from))

    def cut(self, length: int) -> tuple[Piece, Piece]:
        at = 4 * length
        return Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens, self.loss_from), Piece(self.doc_id, self.start + length, self.ids[at:], self.doc_tokens, self.loss_from)

    def fitting(self, tokens: int, loss: int) -> int:
        """The most tokens from the start that keep within both."""
        free = max(0, self.loss_from - self.start)
        return min(self.length, tokens, free + loss)


class Packer:
    def __init__(self, limits: Limits, buffer: int = BUFFER):
        self.limits, self.buffer, self.waiting = limits, buffer, []
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.demand, self.sums = np.zeros((0, 3)), np.zeros(3)  # of the waiting ones; rows beyond them are unused

    def _wait(self, piece: Piece) -> None:
        n = len(self.waiting)
        if n == len(self.demand):
            self.demand = np.concatenate((self.demand, np.zeros((max(n, 512), 3))))
        self.demand[n] = piece.length, 1, piece.loss()
        self.sums += self.demand[n]
        self.waiting.append(piece)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes a document; gives the sequences that are full by it."""
        while (n := piece.fitting(self.limits.tokens, self.limits.loss)) < piece.length:
            head, piece = piece.cut(n)
            if n == self.limits.tokens:
                yield [head]
            else:
                self._wait(head)
        self._wait(piece)
        # few short pieces, however many are looked ahead at, don't fill a sequence: they wait for more
        while len(self.waiting) > self.buffer and (self.sums >= self.caps).any():
            yield self._fill()

    def rest(self) -> Iterator[list[Piece]]:
        while self.waiting:
            yield self._fill()

    def _fill(self) -> list[Piece]:
        caps, pieces = self.caps, self.waiting
        demand = self.demand[: len(pieces)]
        shares = demand / caps
        free, there, placed = caps.copy(), np.ones(len(pieces), bool), []
        while free[0] > 0 and free[1] > 0 and there.any():
            fits = there & (demand <= free).all(axis=1)
            if fits.any():
                i = int(np.where(fits, shares @ (free / caps), -1.0).argmax())
                placed.append(pieces[i])
                free -= demand[i]
                there[i] = False
                continue
            sizes = np.where(there, np.minimum(np.minimum(demand[:, 0], free[0]), demand[:, 0] - demand[:, 2] + free[2]), 0)  # as Piece.fitting
            i = int(sizes.argmax())
            if not sizes[i]:
                break
            head, tail = pieces[i].cut(int(sizes[i]))
            placed.append(head)
            free -= (head.length, 1, head.loss())
            pieces[i] = tail
            demand[i] = (tail.length, 1, tail.loss())
            shares[i] = demand[i] / caps
            if free[0] > 0 and (demand[there] > free).all():
                continue
        left = demand[there]
        self.waiting = [p for p, t in zip(pieces, there, strict=True) if t]
        self.demand[: len(left)], self.sums = left, left.sum(axis=0)
        return placed


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
KIND = pa.schema([(x.split()[0], pa.int64()) for x in FIELDS.split(", ")])
KIND_OPEN = KIND.append(pa.field("ids", pa.binary()))


def _rows(sequence: list[Piece], number: int, with_ids: bool) -> list[tuple]:
    out, offset = [], 0
    for p in sequence:
        out.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, number, offset, p.loss(), p.ids if with_ids else None))
        offset += p.length
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), KIND_OPEN, strict=True)], schema=KIND_OPEN)


def _pack(pieces: Iterator[Piece], limits: Limits, base: int, keep_open: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the packed sequences; with keep_open, under-filled ones carry their ids."""
    packer, number, rows = Packer(limits), base, []

    def sequences():
        for p in pieces:
            yield from packer.add(p)
        yield from packer.rest()

    for sequence in sequences():
        rows += _rows(sequence, number, keep_open and sum(p.length for p in sequence) < limits.tokens)
        number += 1
        if len(rows) >= 4096:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = END_ID, loss_share: Column | None = None, max_words: int = 300_000) -> DataFrame:
    """Packs whole texts of `docs` (doc_id, text) into sequences; one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (all long).

    Null texts are empty: every document ends with `end_id` and so has a piece. loss_share: a column of `docs`
    from 0 to 1, the share of a document's last tokens that bear loss (default: all). Repeated rows and null ids
    are packed as documents of their own. max_words: words that a worker remembers, see `ChunkEncoder`. Sequence ids are unique and have gaps. No rows: no pieces.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"
    share = F.lit(1.0) if loss_share is None else F.coalesce(loss_share.cast("double"), F.lit(1.0))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), share.alias("share"))

    def first(batches):
        def pieces():
            for batch in batches:
                for some in slices(batch):
                    texts = encoder(tokenizer, False, max_words).encode(some.column("text").to_pylist(), end_id)
                    for doc_id, x, y in zip(some.column("doc_id").to_pylist(), texts, some.column("share").to_pylist(), strict=True):
                        n = len(x) // 4
                        yield Piece(doc_id, 0, x, n, n - round(n * min(1.0, max(0.0, y))))

        yield from _pack(pieces(), limits, TaskContext.get().partitionId() << 32, True)

    def again(batches):
        def pieces():
            for batch in batches:
                for r in batch.to_pylist():
                    yield Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"], r["start"] + r["length"] - r["loss_tokens"])

        yield from _pack(pieces(), limits, (1 << 60) + (TaskContext.get().partitionId() << 32), False)

    packed = materialize(plain.mapInArrow(first, fields), "packed")
    under = packed.where(F.col("ids").isNotNull())
    n = under.agg(F.sum("length")).first()[0] or 0
    merged = under.coalesce(max(1, -(-n // (TASK_SEQUENCES * limits.tokens)))).mapInArrow(again, fields)
    return packed.where(F.col("ids").isNull()).drop("ids").unionByName(merged.drop("ids"))


def pack_instructions(docs: DataFrame, tokenizer: str, max_words: int = 300_000) -> DataFrame:
    """`pack_documents` for texts whose second half is the answer and bears loss: a sequence takes INSTRUCTIONS."""
    return pack_documents(docs, tokenizer, INSTRUCTIONS, loss_share=F.lit(LOSS_SHARE), max_words=max_words)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_instructions(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
