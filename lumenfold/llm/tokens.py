"""Encoding whole texts with the ``tokenizers`` library, one distinct white-space unit at a time.

Both vocabularies cut a text at white space before they merge, so a text's ids
are the ids of its units in a row. A worker keeps the ids of units it has met in
a bounded table and asks the library for the others: its model alone for a unit of
letters, which no cut divides, else all of it. Texts for which a cut at
single spaces might differ from the library's own cut (double spaces, rare white
space, strings of special tokens) go to it whole.
"""

from __future__ import annotations

import os
import re
from array import array

from .common import worker_table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units kept by a worker (about 200 MB); when the table is full, further units are encoded each time.
TABLE_UNITS = 1_000_000

_LATIN_END = "\u0250"
#: What a unit must not hold where cuts at single blanks are to be the library's own: a second blank or other white space
#: after the first, control characters or white space beyond ASCII, and the beginning of special tokens' strings.
_ODD = re.compile(r"\A (?:[\t-\r]|\Z)|[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\|")


class _Whole(Exception):
    """A unit whose text goes to the library whole; such units are never kept in the table."""


def _byte_letters() -> dict[int, int]:
    """The code points that byte-level vocabularies write bytes as: printable bytes stand for themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in kept)}


_BYTE_LETTERS = _byte_letters()


class UnitEncoder(dict):
    """The table of units; ``encode`` gives ids as little-endian unsigned 16-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 65_536:
            raise ValueError("ids need more than 16 bits")
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.spaced = self.library.encode("a b", add_special_tokens=False).ids != self.library.encode("a  b", add_special_tokens=False).ids
        self.folds = self.library.encode("A", add_special_tokens=False).ids == self.library.encode("a", add_special_tokens=False).ids
        probes = ["the", "Élan", "ßł", "zqxj"] + [" the", " Élan"] * self.spaced
        self.direct = all(self._ask_model(t) == self._ask(t) for t in probes)  # a byte-level model, as both files hold

    def _ask(self, text: str) -> bytes:
        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _ask_model(self, text: str) -> bytes:
        raw = (text.lower() if self.folds else text).encode().decode("latin-1")
        return array("H", [t.id for t in self.model.tokenize(raw.translate(_BYTE_LETTERS))]).tobytes()

    def __missing__(self, unit: bytes) -> bytes:
        text = unit.decode()
        if _ODD.search(text) if self.spaced else "<|" in text:
            raise _Whole
        stem = text.rstrip(".,;:!?")
        before, line, after = text.partition("\n")
        if before and line and after and len(text.split()) == 2 and before[-1:].strip() and after[0].strip():
            ids = self[before.encode()] + self[b"\n"] + self[after.encode()]  # one line end between two words is a cut of its own
        elif len(stem) < len(text) and stem[-1:].isalnum() and stem[-1] < _LATIN_END:  # both vocabularies cut between letters or digits and such marks
            ids = self[stem.encode()] + self[text[len(stem) :].encode()]
        else:
            word = text[1:] if self.spaced and text[:1] == " " else text
            # letters of the Latin blocks: composed, and letters to any version of Unicode
            letters = self.direct and word.isalpha() and max(word) < _LATIN_END and "\u0130" not in word
            ids = self._ask_model(text) if letters else self._ask(text)
        if len(self) < TABLE_UNITS:
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        if not self.spaced:
            units = (raw.lower() if self.folds else raw).split()
        elif b"\0" in raw:
            return self._ask(text)
        else:
            units = raw.replace(b" ", b"\0 ").split(b"\0")
        try:
            return b"".join(map(self.__getitem__, units))
        except _Whole:
            return self._ask(text)


def encoder(path: str) -> UnitEncoder:
    """One encoder for each worker process and vocabulary file."""
    return worker_table(path, lambda: UnitEncoder(path))
