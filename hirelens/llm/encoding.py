"""Whole texts to token ids with public tokenizer files: each distinct word is encoded once."""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow.compute as pc

#: A space before white space or at the end.
ODD = re.compile(r" (?:\s|$)").search
#: Letters of plain texts, Latin and Cyrillic: those that have one code point in every normal form and in lower case.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſЀ-џ"
#: What a plain text may hold: these, digits, ASCII and typographic signs, spaces and line ends. The apostrophe isn't
#: plain, since the files treat some endings behind it by themselves.
PLAIN = re.compile(rf"[{LETTERS}0-9 \n!-&(-/:-@\[-`{{-~\u2010-\u2027\u2030-\u205e€]*").fullmatch
#: The files' own rules of what is merged by itself, for plain texts.
WORDS = {
    True: re.compile(rf" ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+").findall,
    False: re.compile(rf"[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+").findall,
}
#: Where a text can be cut: no word spans it.
CUT = re.compile(r" (?=\S)")
#: Characters that are taken apart at once.
STRETCH = 4_000_000


def byte_characters() -> dict[int, str]:
    """The character that byte-level files write for each byte: itself if it is printable and no space, else
    the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}


class ChunkEncoder:
    """Token ids of whole texts, equal to those of one `encode(text, add_special_tokens=False)` each.

    A tokenizer takes a text apart into words, numbers and runs of signs before it merges symbols in each. Of plain
    texts that is done here by the files' own rules, and the library's model is asked for each distinct word once. A
    space that a non-space follows always starts a new word, so any other text is cut into parts at such spaces; its
    plain parts are treated alike, and the others go the library's whole way, as does a text that holds an added
    token's own string.

    Words are remembered in two generations: when the younger one has `max_words`, it becomes the older, whose words
    are forgotten unless they were met again since.
    """

    def __init__(self, path: str, leading_space: bool, max_words: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.leading_space = leading_space
        self.characters = byte_characters()
        self.words_of = WORDS[leading_space]
        self.max_words, self.young, self.old = max_words, {}, {}

    def _word(self, word: str) -> bytes:
        ids = self.young.get(word) or self.old.get(word)  # a word has an id at least
        if ids is None:
            shown = word.encode().decode("latin-1").translate(self.characters)
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self.young) >= self.max_words:
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        words = self.words_of(text if self.leading_space else text.lower())
        ids = list(map(self.young.get, words))
        if None in ids:
            ids = [self._word(w) if x is None else x for w, x in zip(words, ids, strict=True)]
        return b"".join(ids)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    @staticmethod
    def parts(text: str) -> list[str]:
        """`text` cut before each space that a non-space follows."""
        head, *rest = CUT.split(text)
        return [head, *(" " + x for x in rest)]

    def _mixed(self, text: str) -> bytes:
        parts = self.parts(text)
        plain = [PLAIN(p) for p in parts]
        other = iter(self._whole([p for p, x in zip(parts, plain, strict=True) if not x]))
        return b"".join(self._plain(p) if x else next(other) for p, x in zip(parts, plain, strict=True))

    def _stretches(self, text: str) -> Iterator[str]:
        """`text` in stretches, so that a very long one is never held as words at once."""
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + STRETCH)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode(self, texts: Iterable[str | None], end: int | None = None) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Nulls are empty. `end` is put behind each text
        if it is given."""
        last = b"" if end is None else struct.pack("<I", end)
        for text in texts:
            if not text:
                yield last
            elif any(a in text for a in self.added):
                yield self._whole([text])[0] + last
            else:
                yield b"".join(self._plain(x) if PLAIN(x) else self._mixed(x) for x in self._stretches(text)) + last


_held: dict = {}


def only(key: tuple, make: Callable):
    """What `make` gives, kept in this Python worker until another key is asked for: a worker that serves one stage after
    the other holds the words of one tokenizer at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def encoder(path: str, leading_space: bool, max_words: int = 300_000) -> ChunkEncoder:
    """One encoder per Python worker and file."""
    return only((path, leading_space, max_words), lambda: ChunkEncoder(path, leading_space, max_words))


def slices(batch, text: str = "text", max_bytes: int = 8_000_000) -> Iterable:
    """Cuts an Arrow batch by text size, so that a run of long texts is never held twice at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held > max_bytes:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
