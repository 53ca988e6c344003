"""Token ids of whole texts with a public tokenizer, by a cache of words inside each Python worker.

White space always ends a word in both tokenizers used here, so the ids of a text are the ids of its words one after
the other. A word met again costs one look-up. Texts with other white space than single spaces and line breaks take
the tokenizer's own way.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

CACHE_WORDS = 1_000_000  # then the cache starts anew; a bound of memory (about 200 MB), not of results
LONGEST_CACHED = 64
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTERS_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*()\[\]{}\"-]+)")
_ENCODERS: dict[str, WordEncoder] = {}


def _byte_letters() -> dict[str, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(b): chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = str.maketrans(_byte_letters())


def byte_level(word: str) -> str:
    return word.encode().decode("latin-1").translate(_ALPHABET)


class _Words(dict):
    """Word to the bytes of its ids."""

    def __init__(self, encoder: WordEncoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, word: str) -> bytes:
        value = self.encoder.encode_word(self.lead, word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


class WordEncoder:
    """Ids of texts as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])  # then white space is dropped as well
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.first, self.spaced = _Words(self, ""), _Words(self, " ")
        self.newline = self.plain("\n")

    def to_bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def plain(self, text: str) -> bytes:
        return self.to_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode_word(self, lead: str, word: str) -> bytes:
        if len(word) <= LONGEST_CACHED:
            if _LETTERS.fullmatch(word):
                piece = byte_level(lead + (word.lower() if self.lower else word))
                return self.to_bytes([t.id for t in self.model.tokenize(piece)])
            if m := _LETTERS_MARKS.fullmatch(word):
                return (self.spaced if lead else self.first)[m[1]] + self.first[m[2]]
        return self.plain(lead + word)

    def encode(self, text: str) -> bytes:
        words = text.split()
        breaks = text.count(" ") + text.count("\n")
        if len(words) != breaks + 1 or sum(map(len, words)) + breaks != len(text):  # other or doubled white space
            return self.plain(text)
        if self.lower:
            return b"".join(map(self.first.__getitem__, words))
        first, spaced = self.first, self.spaced
        return self.newline.join([
            b"".join(chain((first[line[0]],), map(spaced.__getitem__, line[1:])))
            for line in map(_split_at_spaces, text.split("\n"))])


def _split_at_spaces(line: str) -> list[str]:
    return line.split(" ")


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this file; it outlives a task, and so does its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def resolve(name: str) -> str:
    """A vocabulary file: a path, or the name of one of the public tokenizers installed on every node."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
