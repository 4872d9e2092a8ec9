"""Installed tokenizers behind caches of words, so that a frequent word is encoded once.

Both classes return exactly what the library gives for the whole text. They rely on places
where a text may be cut without changing its tokens, and hand a text to the library as it
is where that does not hold.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np

CACHE_WORDS = 1_000_000
JOIN = 64


def file_digest(path: str) -> str:
    """Digest of a tokenizer file: its version."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


class WordIds:
    """Ids of a word-level BPE of the ``tokenizers`` library, as little-endian 32-bit bytes.

    Its pre-tokenizer drops white space and never joins an ASCII letter with ASCII
    punctuation other than an apostrophe, and it lower-cases; so a text may be cut at spaces
    and at those borders. Texts that hold the opening of a special token are encoded whole.
    """

    # Between a letter and punctuation other than the apostrophe.
    BORDER = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")
    SPECIAL = b"<|"

    def __init__(self, path: str, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = words
        self.known: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        if self.SPECIAL in raw:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        found = self.BORDER.sub(b" ", raw.lower()).split()
        missing = set(found).difference(self.known)
        if missing:
            if len(self.known) + len(missing) > self.words:
                self.known.clear()
                missing = set(found)
            self._learn(sorted(missing))
        return b"".join(map(self.known.__getitem__, found))

    def _learn(self, words: list[bytes]) -> None:
        """Encode ``words`` in lines of a few; the offsets tell which ids are whose."""
        lines = [[w.decode() for w in words[i : i + JOIN]] for i in range(0, len(words), JOIN)]
        encoded = self.tokenizer.encode_batch([" ".join(line) for line in lines], add_special_tokens=False)
        for line, got in zip(lines, encoded):
            starts = np.cumsum([0] + [len(w) + 1 for w in line])
            ids = np.array(got.ids, dtype="<u4")
            at = np.searchsorted(np.array([o[0] for o in got.offsets], dtype=np.int64), starts)
            for word, lo, hi in zip(line, at[:-1].tolist(), at[1:].tolist()):
                self.known[word.encode()] = ids[lo:hi].tobytes()


class PieceCounts:
    """Token counts of a ``sentencepiece`` model.

    If no piece holds a space after another character, no merge crosses the border before
    a space, so single-spaced texts are counted word by word. Other texts, and all texts of
    a model that normalises or has such pieces, are encoded whole.
    """

    SPACE = "▁"

    def __init__(self, path: str, words: int = CACHE_WORDS):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.words = words
        self.known: dict[str, int] = {}
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        probe = "  AÅﬁ ①"
        plain = self.model.normalize(probe) == self.SPACE + probe.replace(" ", self.SPACE)
        self.by_word = plain and not any(self.SPACE in p.lstrip(self.SPACE) for p in pieces)

    def counts(self, texts: Iterable[str]) -> Iterator[int]:
        for text in texts:
            parts = text.split(" ")
            if not self.by_word or self.SPACE in text or "" in parts:
                yield len(self.model.encode(text)) if text else 0
                continue
            missing = set(parts).difference(self.known)
            if missing:
                if len(self.known) + len(missing) > self.words:
                    self.known.clear()
                    missing = set(parts)
                fresh = list(missing)
                self.known.update(zip(fresh, map(len, self.model.encode(fresh, num_threads=1))))
            yield sum(map(self.known.__getitem__, parts))


class WholeCounts:
    """Token counts of a ``tokenizers`` file, each text encoded whole with its defaults."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def counts(self, texts: Iterable[str]) -> Iterator[int]:
        for text in texts:
            yield len(self.tokenizer.encode(text, add_special_tokens=False))


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounts | WholeCounts:
    return PieceCounts(path) if path.endswith(".model") else WholeCounts(path)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
