"""Encoding with the public tokenizers: plain ids fast, and ids with character offsets."""

from __future__ import annotations

import os
import re
import string
import sys
from array import array
from typing import ClassVar

import numpy as np


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Ids of whole texts for a tokenizer that drops white space.

    Such a tokenizer treats each white-space separated run by itself, so runs are encoded once and
    remembered. Runs of plain Latin words and ASCII punctuation go straight to the tokenizer's own
    model, piece by piece of its split pattern; any other run takes its full path. Words without the
    punctuation after them are remembered apart. Each memory has two generations of bounded size, and
    runs of more than LONGEST characters are not remembered.
    """

    LONGEST = 64

    #: The split pattern of the tokenizer file, for the characters of PLAIN.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    PUNCTUATION = string.punctuation
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")

    _shared: ClassVar[dict[str, WordEncoder]] = {}

    def __init__(self, path: str, most: int = 120_000, most_words: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.most, self.old = most, {}
        self.most_words, self.words, self.old_words = most_words, {}, {}
        self.bytes_as_text = _byte_alphabet()

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        """One encoder for each Python worker, so that its memory serves later tasks too."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __missing__(self, run: str) -> bytes:
        if (got := self.old.get(run)) is None:
            # a letter before punctuation always ends a piece of the split pattern
            core = run.rstrip(self.PUNCTUATION)
            if not core or core[-1] > "ÿ" or not core[-1].isalpha():
                got = self._encode_run(run)
            elif len(core) < len(run):
                got = self._word(core) + self[run[len(core) :]]
            else:
                got = self._word(core)
        if len(run) > self.LONGEST:
            return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        self[run] = got
        return got

    def _word(self, word: str) -> bytes:
        if (got := self.words.get(word)) is None:
            if (got := self.old_words.get(word)) is None:
                got = self._encode_run(word)
            if len(word) > self.LONGEST:
                return got
            if len(self.words) >= self.most_words:
                self.old_words, self.words = self.words, {}
            self.words[word] = got
        return got

    def _encode_run(self, run: str) -> bytes:
        if run.isalpha() and max(run) <= "ÿ":
            pieces = (run.lower(),)
        elif self.PLAIN.fullmatch(run):
            pieces = self.SPLIT.findall(run.lower())
        else:
            return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, np.uint32).tobytes()
        ids = array("I")
        for piece in pieces:
            if not piece.isascii():
                piece = "".join(map(self.bytes_as_text.__getitem__, piece.encode()))
            ids.extend([t.id for t in self.model.tokenize(piece)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand
    for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]
