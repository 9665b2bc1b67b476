"""Batch encoding with a tokenizer whose pre-tokens do not depend on what stands around them.

The library encodes about 0.7 MB a second; words repeat.  So a text is cut at ASCII white space, words seen before come
from a memory of the process (two generations of at most `MEMORY` and one block), and the library encodes the rest, many at a time.  Cutting there is safe because
the vocabulary drops white space, and none of its normalizers (NFC, lower case) works across it.  Words of characters
below U+0300 are also lowered and cut into letters, digits and other signs before the library sees them, as its own
pattern does, so that `Word`, `word` and `word,` share one entry; other words are passed whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from tidewall.llm.common import kept, utf8

#: Fixed: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+"
MEMORY = 400_000


class WordPieces:
    def __init__(self, vocabulary: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._find = regex.compile(PATTERN).findall
        self._memory = memory
        self._words: dict[bytes, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._old_words: dict[bytes, bytes] = {}
        self._old_parts: dict[str, bytes] = {}
        ends = [id for token, id in self._tokenizer.get_vocab().items() if token.endswith("</w>")]
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._ends[ends] = True

    @classmethod
    def shared(cls, vocabulary: str) -> "WordPieces":
        """One per process: the memory outlives a task, until a task of another operator starts."""
        return kept("tokenfile", ("words", vocabulary), lambda: cls(vocabulary))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        block, size = [], 0
        for text in utf8(texts):
            block.append(text.split())
            size += len(text)
            if size > 1 << 20:
                yield from self._encode(block)
                block, size = [], 0
        yield from self._encode(block)

    def _encode(self, block: list[list[bytes]]) -> Iterator[bytes]:
        if len(self._words) > self._memory:
            self._words, self._old_words = {}, self._words
        if len(self._parts) > self._memory:
            self._parts, self._old_parts = {}, self._parts
        words, old = self._words, self._old_words
        new = []
        for word in set().union(*block).difference(words):
            known = old.get(word)
            if known is None:
                new.append(word)
            else:
                words[word] = known
        if new:
            self._learn(new)
        for split in block:
            yield b"".join(map(words.__getitem__, split))

    def _learn(self, new: list[bytes]) -> None:
        cut, whole, unknown, parts, find = [], [], {}, self._parts, self._find
        for word in new:
            string = word.decode()
            if "<|" in string or not string.isascii() and max(string) >= "\u0300":
                whole.append((word, string))
                continue
            string = string.lower()
            # As the pattern cuts it; the two common shapes without the pattern.
            if string.isalpha():
                pieces = (string,)
            elif string[-1] in ".,;:!?" and string[:-1].isalpha():
                pieces = (string[:-1], string[-1])
            else:
                pieces = find(string)
            cut.append((word, pieces))
            for piece in pieces:
                if piece not in parts:
                    if piece in self._old_parts:
                        parts[piece] = self._old_parts[piece]
                    else:
                        unknown[piece] = None
        if unknown:
            # Many new parts in one text: the library's cost per call is larger than that per word.
            names = list(unknown)
            texts = [" ".join(names[i : i + 64]) for i in range(0, len(names), 64)]
            encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.array([i for e in encoded for i in e.ids], "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(names):
                raise ValueError("the vocabulary does not mark the end of every word")
            raw, last = ids.tobytes(), 0
            for name, end in zip(names, (ends * 4).tolist()):
                parts[name] = raw[last:end]
                last = end
        for word, pieces in cut:
            self._words[word] = parts[pieces[0]] if len(pieces) == 1 else b"".join([parts[piece] for piece in pieces])
        if whole:
            encoded = self._tokenizer.encode_batch([s for _, s in whole], add_special_tokens=False)
            for (word, _), e in zip(whole, encoded):
                self._words[word] = np.array(e.ids, "<u4").tobytes()
