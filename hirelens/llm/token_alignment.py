"""Alignment of two tokenizers' tokens of the same texts.

A is a byte-level file of the tokenizers library, B a sentencepiece model with byte fallback. Each text is taken apart
where no token of either can span, and each distinct part is aligned once. Of parts whose characters are bytes the
libraries' own spans of tokens are the cuts; in others tokens may share a character (multibyte characters, byte
fallback), and the spans are refined by the tokens' decoded bytes. Groups of a text are those of its parts in a row.

Two passes: the first writes a row per text with its linked id pairs and, per task, the sums of pairs; the second looks
up what the sums say about each text's pairs. Linked tokens end together, so the shorter one's bytes end the longer
one's: this bounds the pairs by the two vocabularies, whatever the corpus holds.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.encoding import LETTERS, PLAIN, WORDS, byte_characters, only, slices
from hirelens.llm.shared import materialize, table

#: A space between two non-spaces: no token goes on over it.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Parts longer than this are not remembered.
LONG_PART = 64
SPACE = "▁"
#: Pieces of plain texts that lie within one of the words that such texts are taken apart into.
WITHIN = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+| +").fullmatch
#: A piece with a space behind something else, or with a line end.
OVER = re.compile(rf"{SPACE}*[^{SPACE}]+{SPACE}|.*\n", re.S).match


def _breaks(piece: str) -> bool:
    """Whether a text can't be taken apart because of this piece."""
    spaced = piece.replace(SPACE, " ")
    return bool(OVER(piece)) or bool(PLAIN(spaced) and not WITHIN(spaced))


class Aligner:
    """Tokens of texts by both files, and their groups. `max_parts`: parts that are remembered in each of two
    generations; when the younger one is full, the older one is forgotten."""

    def __init__(self, path_a: str, path_b: str, max_parts: int = 250_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in byte_characters().items()}
        words = self.a.get_vocab()
        self.bytes_a = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.bytes_a[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        whole = [i for i in range(len(pieces)) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(pieces)]
        self.apart = not any(_breaks(pieces[i]) for i in whole)
        self.codes = self._pairs()
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in known]) for known in (self.bytes_a, self.bytes_b))
        self.shown = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.characters = byte_characters()
        # a part's groups, and for each (place in codes, A tokens, B tokens); empty where bytes aren't the part's
        self.max_parts, self.groups, self.links = max_parts, {}, {}
        self.old_groups, self.old_links = {}, {}

    def _pairs(self) -> np.ndarray:
        """Codes of all (A id, B id) of which one's bytes end the other's, ascending."""
        found = set()
        for mine, other, turned in ((self.bytes_a, self.bytes_b, False), (self.bytes_b, self.bytes_a, True)):
            by: dict[bytes, list[int]] = {}
            for i, x in enumerate(other):
                by.setdefault(x, []).append(i)
            for i, x in enumerate(mine):
                for k in range(len(x)):
                    found.update((j << 32 | i) if turned else (i << 32 | j) for j in by.get(x[k:], ()))
        return np.array(sorted(found), np.int64)

    def parts(self, text: str) -> list[str]:
        """A space and `text`, cut where no token of either file can span."""
        spaced = " " + text
        if not self.apart:
            return [spaced]
        if PLAIN(spaced) and "  " not in spaced:
            return WORDS[True](spaced)
        return [w for p in CUT.split(spaced) for w in (WORDS[True](p) if PLAIN(p) and "  " not in p else [p])]

    def _tokens_a(self, part: str) -> tuple[list[int], list[int]]:
        """Ids and span ends of a part. Only the latter of ASCII parts count."""
        if self.apart and PLAIN(part) and "\n" not in part and "  " not in part:  # a word: the model is asked for it
            tokens = self.a.model.tokenize(part.encode().decode("latin-1").translate(self.characters))
            lead = part[0] == " "  # the model's spans count the sign for a space as two bytes
            return [t.id for t in tokens], [t.offsets[1] - lead for t in tokens]
        found = self.a.encode(part, add_special_tokens=False)
        return found.ids, [end for _, end in found.offsets]

    def learn(self, parts: list[str]) -> None:
        """Aligns distinct parts of one kind: all ASCII, or none."""
        ascii_only = parts[0].isascii()
        lead, shift, skip = ("\n", 1, 2) if self.apart else ("", -1, 0)  # behind a line end, which no piece spans, a part is encoded as in its text
        texts = [lead + p for p in parts] if self.apart else [p[1:] for p in parts]
        tokens_a = [self._tokens_a(p) for p in parts]
        if ascii_only:
            mapped = self.b.encode(texts, return_type="offset_mapping", num_threads=1)
            tokens_b = [(m["ids"][skip:], [end - shift for _, end in m["offsets"][skip:]]) for m in mapped]
        else:
            tokens_b = [(ids[skip:], None) for ids in self.b.encode(texts, return_type=int, num_threads=1)]
        raw = [p.encode() for p in parts]
        same = [b"".join([self.bytes_a[i] for i in a]) == r == b"".join([self.bytes_b[i] for i in b]) for (a, _), (b, _), r in zip(tokens_a, tokens_b, raw, strict=True)]
        if not all(same):
            for part, ok in zip(parts, same, strict=True):
                if not ok:
                    self.groups[part] = self.links[part] = None
            parts, raw, tokens_a, tokens_b = (list(itertools.compress(x, same)) for x in (parts, raw, tokens_a, tokens_b))
        if not parts:
            return
        ends = np.cumsum([len(r) for r in raw])
        ids_a, ids_b = (np.array(list(itertools.chain.from_iterable(x for x, _ in t))) for t in (tokens_a, tokens_b))
        if ascii_only:
            base = ends - [len(r) for r in raw]
            ends_a, ends_b = (np.repeat(base, [len(x) for x, _ in t]) + list(itertools.chain.from_iterable(y for _, y in t)) for t in (tokens_a, tokens_b))
        else:
            ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        common, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        pairs = np.searchsorted(self.codes, ids_a[at_a] << 32 | ids_b[at_b])
        links = np.stack((pairs, np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)), axis=1).astype("<i4")
        shown_a, shown_b = ([self.shown[i] for i in ids.tolist()] for ids in (ids_a, ids_b))
        x = y = 0
        groups = []
        for i, j in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            groups.append(f"{shown_a[x] if i == x + 1 else ','.join(shown_a[x:i])}|{shown_b[y] if j == y + 1 else ','.join(shown_b[y:j])}")
            x, y = i, j
        x, raw_links = 0, links.tobytes()
        for part, y in zip(parts, (np.searchsorted(common, ends) + 1).tolist(), strict=True):
            self.groups[part], self.links[part] = ";".join(groups[x:y]), raw_links[12 * x : 12 * y]
            x = y

    def align(self, texts: list[str | None]) -> Iterator[tuple[str, np.ndarray]]:
        """Of each text its groups, and for each of them (place in `codes`, A tokens, B tokens); none of a text
        without tokens."""
        cut = [self.parts(t) if t else [] for t in texts]
        seen: set[str] = set().union(*cut)
        fresh = seen.difference(self.groups)
        if len(self.groups) + len(fresh) > self.max_parts:
            self.old_groups, self.old_links, self.groups, self.links = self.groups, self.links, {}, {}
            fresh = seen
        new: tuple[list[str], list[str]] = ([], [])
        for p in fresh:
            if p in self.old_groups:
                self.groups[p], self.links[p] = self.old_groups[p], self.old_links[p]
            else:
                new[p.isascii()].append(p)
        for kind in new:
            for start in range(0, len(kind), 4096):
                self.learn(kind[start : start + 4096])
        for parts in cut:
            groups = list(map(self.groups.__getitem__, parts))
            if not groups or None in groups:
                yield "", np.zeros((0, 3), "<i4")
            else:
                yield ";".join(groups), np.frombuffer(b"".join(map(self.links.__getitem__, parts)), "<i4").reshape(-1, 3)
        for p in fresh:
            if len(p) > LONG_PART:
                del self.groups[p], self.links[p]


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker and pair of files."""
    return only((path_a, path_b), lambda: Aligner(path_a, path_b))


FIRST = pa.schema([("is_sum", pa.bool_()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
FIRST_SQL = "is_sum boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<int>, times array<long>"
LAST = pa.schema([(n, FIRST.field(n).type) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string())])
LAST_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"


def align_texts(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups
    (`a1,a2|b1;a3|b2`, only with keep_groups, else null), groups_sha256.

    A encodes a space and the text, B the text with the space that it adds; special tokens' strings are plain text. Two
    tokens are linked where their byte ranges end together; n_best counts links whose pair is linked as often in all
    texts as any of its B id, count_sum adds up all links' counts. Null and empty texts, and those that either file
    can't give back byte by byte, have no tokens: zeros and an empty groups_sha256. Repeated rows and null ids are rows
    of their own and count each; other columns are ignored; no rows give none.

    A text's pairs are kept as a histogram and a task's sums as one row, both bounded by the pairs that the
    vocabularies allow, as is what reaches the driver and the executors: the sums of the pairs that occur.
    """
    spark = docs.sparkSession

    def first(batches):
        held = aligner(path_a, path_b)
        sums = np.zeros(len(held.codes), np.int64)
        for batch in batches:
            for some in slices(batch, max_bytes=2_000_000):
                rows: list = []
                for doc_id, (groups, links) in zip(some.column(0).to_pylist(), held.align(some.column(1).to_pylist()), strict=True):
                    at, times = np.unique(links[:, 0], return_counts=True)
                    sums[at] += times
                    _, n_a, n_b = links.sum(axis=0, dtype=np.int64).tolist()
                    sha = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                    rows.append((False, doc_id, n_a, n_b, len(links), len(links), groups if keep_groups else None, sha, at, times))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIRST, strict=True)], schema=FIRST)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((True, None, 0, 0, 0, 0, None, "", at, sums[at]), FIRST, strict=True)], schema=FIRST)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = materialize(plain.mapInArrow(first, FIRST_SQL), "aligned")
    sums = aligned.where("is_sum").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("x.pairs").agg(F.sum("x.times").alias("n")).toArrow()
    counts = spark.sparkContext.broadcast((sums.column(0).to_numpy().astype(np.int32), sums.column(1).to_numpy().astype(np.int64)))

    def last(batches):
        at, n = counts.value
        codes = aligner(path_a, path_b).codes
        of = np.zeros(len(codes), np.int64)
        of[at] = n
        most = np.zeros(int((codes & 0xFFFFFFFF).max()) + 1, np.int64)
        np.maximum.at(most, codes & 0xFFFFFFFF, of)
        best = (of > 0) & (of == most[codes & 0xFFFFFFFF])
        for batch in batches:
            pairs, times = (batch.column(k).values.to_numpy(zero_copy_only=False) for k in (6, 7))
            ends = batch.column(6).offsets.to_numpy()
            best_of, count_of = (np.concatenate(([0], np.cumsum(times * x[pairs])))[ends] for x in (best, of))
            arrays = [*(batch.column(k) for k in range(5)), pa.array(np.diff(best_of)), pa.array(np.diff(count_of)), batch.column(5), batch.column(8)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, LAST, strict=True)], schema=LAST)

    texts = aligned.where("NOT is_sum").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "groups_sha256")
    return texts.mapInArrow(last, LAST_SQL)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    aligned = align_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.drop("groups")
