"""Whole texts to token ids with a public tokenizer, one chunk of text at a time.

Both vocabularies split a text before they merge bytes, and no token spans such a split. Texts
are cut only where a split is certain, each distinct chunk is encoded once, and chunks are kept
in a table bounded in bytes, which a worker keeps for its later tasks. Texts that hold the string of
a special token go to the library whole. The ids equal those of encoding the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

#: Bytes of chunks that a worker keeps, what one takes besides its characters and ids, and the longest kept.
KEPT, EACH, LONGEST = 48 << 20, 150, 64

_BEFORE_WORD = re.compile(r" (?=\S)")
#: A word and signs after it; both vocabularies split between the two, and nowhere else.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*$%&#|]*)")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else one from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}


class _Uncertain(Exception):
    """A space before white space: where the text splits depends on what follows."""


class _Chunks(dict):
    """What follows a space, up to the next one, to its ids. Those that are missing are encoded and kept.

    When half the bound is reached, this half becomes the older one, from which chunks that are met again return.
    """

    def __init__(self, encode, plain_only: bool):
        super().__init__()
        self.encode, self.plain_only, self.older, self.held = encode, plain_only, {}, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if not chunk or chunk[0].isspace():
                if self.plain_only:
                    raise _Uncertain
                if not chunk:
                    return b""
            ids = self.encode(chunk)
            if len(chunk) > LONGEST:
                return ids
        self.held += EACH + len(chunk) + len(ids)
        if self.held > KEPT // 2:
            self.older, self.held = dict(self), 0
            self.clear()
        self[chunk] = ids
        return ids


class Encoder:
    """``kind`` is "byte" (a space belongs to the word after it) or "word" (white space is dropped, case is folded).

    The strings of special tokens in a text are these tokens, as the library has it by default; with
    ``special_as_text`` they are ordinary text.
    """

    def __init__(self, path: str, kind: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if kind not in ("byte", "word"):
            raise ValueError(f"unknown kind of vocabulary: {kind}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added), re.IGNORECASE) if added and not special_as_text else None
        self.tokenize, self.letters, self.space = self.tokenizer.model.tokenize, _byte_letters(), " " if kind == "byte" else ""
        self.lead = self.letters[32] if self.space else ""
        self.known, self.signs, self.starts = _Chunks(self._chunk, bool(self.space)), {}, {}

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk with the space before it, if the vocabulary keeps spaces."""
        m = _PLAIN.fullmatch(chunk)
        if m is not None:
            word, signs = m.groups()
            return self._known(word) + self._sign(signs) if signs else self._word(word, self.lead)
        if "\n" in chunk and len(chunk) <= LONGEST:  # plain lines
            lines = [_PLAIN.fullmatch(x) for x in chunk.split("\n")]
            if all(lines):
                out = [(self._start(m[1]) if n else self._known(m[1])) + (self._sign(m[2]) if m[2] else b"") for n, m in enumerate(lines)]
                return (self._sign("\n") if self.space else b"").join(out)
        return self._library(self.space + chunk)

    def _word(self, word: str, lead: str) -> bytes:
        """Letters, with the space before them: one unit of the vocabulary's merges."""
        if not self.space:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(lead + word)]).tobytes()

    def _known(self, word: str) -> bytes:
        """``_word`` after a space, which is looked for among the chunks; it is not kept."""
        return self.known.get(word) or self.known.older.get(word) or self._word(word, self.lead)

    def _start(self, word: str) -> bytes:
        """``_word`` at the start of a line; few words are there often."""
        found = self.starts.get(word)
        if found is None:
            if len(self.starts) > 10_000:
                self.starts.clear()
            found = self.starts[word] = self._word(word, "") if self.space else self._known(word)
        return found

    def _sign(self, signs: str) -> bytes:
        found = self.signs.get(signs)
        if found is None:
            if len(self.signs) > 10_000:
                self.signs.clear()
            found = self.signs[signs] = self._library(signs)
        return found

    def one(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not text or self.special is not None and self.special.search(text):
            return self._library(text)
        known = self.known
        try:
            if not self.space:
                return b"".join(map(known.__getitem__, text.split(" ")))
            first, *rest = text.split(" ")
            return b"".join([self._library(first), *map(known.__getitem__, rest)])
        except _Uncertain:
            first, *rest = _BEFORE_WORD.split(text)
            return b"".join([self._library(first), *map(known.__getitem__, rest)])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.one, texts)


@lru_cache(maxsize=2)
def encoder(path: str, kind: str, special_as_text: bool = False) -> Encoder:
    """One for each worker process, with what it has kept from earlier tasks."""
    return Encoder(path, kind, special_as_text)
