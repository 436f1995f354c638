"""Ids of a tokenizers file, with one lookup per white-space-delimited string.

The tokenizer of such a file treats what stands between white space on its own, so
a worker asks the library for each distinct string once and keeps a bounded number of
answers.  A string of plain letters goes straight to the library's merge model;
anything else (digits, marks, other scripts) takes the library's whole path.
"""

from __future__ import annotations

import os
import struct

import numpy as np

WORD_ENTRIES, CORE_ENTRIES = 350_000, 250_000
CACHED_BYTES = 64
TRAILING = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
# First bytes of the combining marks that may fuse with a letter of one case only.
MARKS = (b"\xcc", b"\xcd")
# Below this code point composition and case mapping of letters have no exceptions.
PLAIN_LETTERS = "\u0250"


def _byte_characters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a visible character: itself, or the next free one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: 256 + k for k, byte in enumerate(b for b in range(256) if b not in visible)}


BYTE_CHARACTERS = _byte_characters()


class _Cache(dict):
    """Packed ids by string; asks ``find`` for what is missing.

    When full, the entries become the older generation and the one before is forgotten;
    what is used again moves to the new one.
    """

    def __init__(self, find, entries: int) -> None:
        super().__init__()
        self.find, self.entries, self.older = find, entries, {}

    def __missing__(self, word: bytes) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = self.find(word)
            if len(word) > CACHED_BYTES:
                return packed
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed


class WordTokenizer:
    """Packed little-endian unsigned 32-bit ids of whole texts, without special tokens added."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Strings that the file lists as tokens of their own; texts with them are not taken apart.
        self.listed = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cores = _Cache(self._core, CORE_ENTRIES)
        self.words = _Cache(self._word, WORD_ENTRIES)

    def _library(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def _plain(word: bytes) -> str | None:
        """Lower-case letters of a word that consists of nothing else and has no special cases."""
        text = word.decode()
        if text.isalpha() and (text.isascii() or max(text) < PLAIN_LETTERS):
            lowered = text.lower()
            if lowered.isascii() or lowered.isalpha() and max(lowered) < PLAIN_LETTERS:
                return lowered
        return None

    def _core(self, word: bytes) -> bytes:
        plain = self._plain(word)
        if plain is None:
            return self._library(word)
        shown = plain.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        ids = [token.id for token in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        core = word.rstrip(TRAILING)
        if core and len(core) < len(word) and (core[-1:].isalpha() or self._plain(core) is not None):
            return self.cores[core] + self.cores[word[len(core) :]]
        return self.cores[word]

    def encode(self, text: bytes) -> bytes:
        if any(token in text for token in self.listed):
            return self._library(text)
        if not any(mark in text for mark in MARKS):
            lowered = text.lower()
            if not any(token in lowered for token in self.listed):
                text = lowered
        return b"".join(map(self.words.__getitem__, text.split()))


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file; loaded once."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
