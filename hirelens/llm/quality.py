"""Quality rules from tokeniser fertility: how a public vocabulary takes a text apart.

Text in a language and script that a vocabulary knows takes few tokens per character, needs few single bytes
and uses many different tokens; encoded blobs, wrong decodings and repetition don't. Each measure has a wide band per
script, which holds for any corpus. Within it, characters per token and token entropy have narrow fences per language
and length, from the corpus's own quartiles: words of a language take apart alike, and entropy grows with length
alike, so litter and lists of words stand out. All measures come from one pass over each whole text.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.encoding import ODD, only, slices
from hirelens.llm.shared import bounded_broadcast, materialize, table

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Band:
    """Limits for one script. Token entropy is in bits. `enough_entropy` passes at any length; below it, the
    entropy must be `min_entropy` times the largest possible value for as many tokens, from `entropy_from` tokens
    on."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float = 0.45
    enough_entropy: float = 4.5
    entropy_from: int = 50


#: By script; "other" for scripts not named and texts without a letter. Vocabularies spell Han, kana, Hangul and
#: most other non-Latin scripts by bytes in part, hence their own limits.
BANDS = {
    "latin": Band(1.75, 8.0, 0.15),
    "cyrillic": Band(1.0, 8.0, 0.25),
    "cjk": Band(0.25, 4.0, 0.95),
    "other": Band(0.25, 8.0, 0.95, 0.35),
}
#: Fences lie so many times the spread between quartiles below the first and above the third one (None: no fence).
#: A spread counts as `least` at least, so that copies of one text don't narrow a fence to themselves.
FENCES = {"chars_per_token": (2.5, 2.5, 0.025), "token_entropy": (2.0, None, 0.07)}
#: Texts that a language's length class (tokens by powers of two, the longest together) must have for fences.
FENCE_TEXTS, LONGEST = 40, 12
#: Code points (first, last) of each script's main blocks.
SCRIPTS = {"latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "cyrillic": ((0x400, 0x52F),), "cjk": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))}

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, byte_share double, token_entropy double, script string, base_failed boolean, kept boolean"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list) -> int:
    """Words in windows of five that are found twice or more, the first included."""
    if len(words) <= WINDOW:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    code, n = ids, len(number)
    for k in range(1, WINDOW):
        if code.max() >= (1 << 62) // n:  # else exact in 63 bits
            code = np.unique(code, return_inverse=True)[1].reshape(-1)
        code = code[:-1] * n + ids[k:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(len(code) + WINDOW, dtype=np.int64)
    found = np.zeros(len(code), dtype=bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    at = np.flatnonzero(found)
    np.add.at(twice, at, 1)
    np.add.at(twice, at + WINDOW, -1)
    return int((np.cumsum(twice)[: len(words)] > 0).sum())


class Fertility:
    """Measures texts with a byte-fallback vocabulary. Words recur, so each distinct one is encoded once; the
    memory for them is emptied at `max_words`."""

    def __init__(self, path: str, max_words: int = 300_000):
        import sentencepiece

        self.vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.vocabulary.IsByte(i) for i in range(len(self.vocabulary))])
        self.max_words, self.known = max_words, {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.vocabulary.encode(parts, num_threads=1)]

    def ids(self, text: str) -> np.ndarray:
        if ODD(text):  # runs of white space may be one token
            return np.frombuffer(self._encode([text])[0], np.uint32)
        parts = text.split(" ")
        found = list(map(self.known.get, parts))
        if None in found:
            if len(self.known) > self.max_words:
                self.known.clear()
            new = list(dict.fromkeys(p for p, x in zip(parts, found, strict=True) if x is None))
            self.known.update(zip(new, self._encode(new), strict=True))
            found = [self.known[p] if x is None else x for p, x in zip(parts, found, strict=True)]
        return np.frombuffer(b"".join(found), np.uint32)

    def measure(self, text: str) -> tuple[int, float, float, float]:
        """Tokens, characters per token, share of byte-fallback tokens, and token entropy in bits; a text without
        tokens: zeros."""
        ids = self.ids(text)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0
        share = np.bincount(ids)
        share = share[share > 0] / len(ids)
        return len(ids), len(text) / len(ids), float(self.is_byte[ids].mean()), abs(float((share * np.log2(share)).sum()))


def script_of(text: str) -> str:
    """The script with most letters, over the whole text; without any: other."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = {name: sum(int(((points >= a) & (points <= b)).sum()) for a, b in spans) for name, spans in SCRIPTS.items()}
    others = int(((points > 0x24F) & (points < 0x3040)).sum()) - n["cyrillic"]
    best = max(n, key=n.get)
    return best if n[best] > others and n[best] else "other"


def in_band(band: Band, n_tokens: int, chars: float, byte_share: float, entropy: float) -> bool:
    varied = n_tokens < band.entropy_from or entropy >= min(band.enough_entropy, band.min_entropy * float(np.log2(n_tokens)))
    return n_tokens > 0 and band.min_chars_per_token <= chars <= band.max_chars_per_token and byte_share <= band.max_byte_share and varied




def _measured(docs: DataFrame, path: str, limits: dict[str, Band], carried: list[str], max_words: int) -> DataFrame:
    """The `carried` columns of `docs` and the measures, as each row has them by itself, with __length, the class of
    the text's length in tokens."""
    fields = f"{MEASURES}, __length long"
    kind = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in fields.split(", "))])

    def judge(text: str) -> tuple:
        counts = base_counts(text)
        n_tokens, chars, byte_share, entropy = only(("fertility", path, max_words), lambda: Fertility(path, max_words)).measure(text)
        script = script_of(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        good = not failed and in_band(limits.get(script, limits["other"]), n_tokens, chars, byte_share, entropy)
        return *counts, chars, byte_share, entropy, script, failed, good, min(LONGEST, n_tokens.bit_length() - 1)

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                rows = [judge(t or "") for t in some.column("text").to_pylist()]
                made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in carried), *made], names=[*carried, *kind.names])

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carried).schema)
    return docs.mapInArrow(run, own + fields)


def corpus_fences(measured: DataFrame) -> DataFrame:
    """(language, __length, one array of low and high per measure of FENCES) from the rows that are kept so far.
    Equal texts count once. Quartiles are those of values rounded to thousandths, so a group's are few."""
    texts = measured.where("kept").select("language", "__length", *FENCES).distinct()
    values = texts.select("language", "__length", F.posexplode(F.array(*(F.round(c, 3) for c in FENCES))).alias("at", "value"))
    counted = values.groupBy("language", "__length", "at", "value").agg(F.count(F.lit(1)).alias("n"))
    quarters = counted.groupBy("language", "__length", "at").agg(F.sum("n").alias("texts"), F.percentile("value", [0.25, 0.75], F.col("n")).alias("q")).where(F.col("texts") >= FENCE_TEXTS)

    def fence(at: int, below: float | None, above: float | None, least: float):
        low, high = F.col("q")[0], F.col("q")[1]
        spread = F.greatest(high - low, F.lit(least))
        limits = F.array(F.lit(float("-inf")) if below is None else low - below * spread, F.lit(float("inf")) if above is None else high + above * spread)
        return F.max(F.when(F.col("at") == at, limits))

    return quarters.groupBy("language", "__length").agg(*(fence(i, *x).alias(f"__{c}") for i, (c, x) in enumerate(FENCES.items())))


def _fenced(measured: DataFrame) -> DataFrame:
    """`measured` (materialised, with language) with `kept` by the fences too; without fences it stays."""
    fences = bounded_broadcast(materialize(corpus_fences(measured), "fences"))
    within = F.lit(True)
    for c in FENCES:
        within &= F.coalesce(F.col(c).between(F.col(f"__{c}")[0], F.col(f"__{c}")[1]), F.lit(True))
    got = measured.join(fences, ["language", "__length"], "left").withColumn("kept", F.col("kept") & within)
    return got.drop("language", "__length", *(f"__{c}" for c in FENCES))


def _language(docs: DataFrame):
    """The language that fences are told apart by: the documents' own, else only the script."""
    return F.coalesce(F.col("lang").cast("string"), F.col("script")) if "lang" in docs.columns else F.col("script")


def measure_quality(docs: DataFrame, vocabulary: str | None = None, bands: dict[str, Band] | None = None, with_text: bool = True, max_words: int = 300_000) -> DataFrame:
    """`docs` (with_text: its text too) with the measures of its text column: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), chars_per_token, byte_share, token_entropy, script, base_failed and kept.

    A null text has no words and fails, as any text of under ten words does. Repeated rows are judged alike. The
    fences are those of `docs`, by its column lang if it has one; where a language has too few texts of a length,
    only the bands hold. max_words: words that a worker remembers, see `Fertility`. Columns of `docs` that have the name of a measure are replaced.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    carried = [c for c in docs.columns if c not in names and (with_text or c != "text")]
    # but text and lang the carried columns have names of their own, which no inner column has
    inner = [c if c in ("text", "lang") else f"__own_{i}" for i, c in enumerate(carried)]
    docs = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(carried, inner, strict=True)), *([] if "text" in carried else ["text"]))
    measured = _measured(docs, vocabulary or public_tokenizers.path("piece_bpe_32k.model"), bands or BANDS, inner, max_words)
    judged = _fenced(materialize(measured.withColumn("language", _language(measured)), "measures"))
    return judged.select(*(F.col(a).alias(b) for a, b in zip(inner, carried, strict=True)), *names)


def keep_good(docs: DataFrame, max_words: int = 300_000) -> DataFrame:
    """The rows of `docs` that pass the base rules, their script's band and their language's fences, with their own
    columns. A column that has a measure's name is carried past the measures under another name."""
    safe = docs.select(*(F.col(c).alias(c if c in ("text", "lang") else f"__{i}") for i, c in enumerate(docs.columns)))
    good = measure_quality(safe, max_words=max_words).where("kept")
    return good.select(*(F.col(c if c in ("text", "lang") else f"__{i}").alias(c) for i, c in enumerate(docs.columns)))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return measure_quality(docs, with_text=False).drop("lang")
