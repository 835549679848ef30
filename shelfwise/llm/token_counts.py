"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Texts up to ``chunk`` characters are counted word by word: the tokenizer's pre-tokens hold no blank and its
normalisation joins nothing across one, so the tokens of a text are those of its words (runs between ASCII blanks) one
after the other. Each different word is encoded once per worker and remembered.

Longer texts are encoded in chunks that overlap, with offsets. Two neighbours are spliced at a boundary inside their
overlap that is proven stable: it follows an ASCII blank or an ASCII digit (a digit is a pre-token by itself, composes with no mark and
occurs in no special token), no token of either encoding crosses it, and from there to the end of the safe part of the
overlap both encodings hold the same tokens at the same offsets. If there is none, the overlap is doubled; when it reaches the
whole chunk, the chunk is doubled too, at the last up to the whole text, which is plain encoding.

Null and empty texts have 0 tokens. Rows with equal ids are independent. Texts of any length are counted whole; memory
follows the longest text.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import pick

CHUNK = 16_384
OVERLAP = 512
#: Words remembered by one worker before it starts anew.
REMEMBERED = 500_000
_STABLE_AFTER = frozenset(" \t\n\x0b\x0c\r0123456789")


class TokenCounter:
    """Counts tokens with the library's own encoder."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.widened = 0

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Tokens of every text, in order."""
        short = [None if text is not None and len(text) > self.chunk else (text or "").encode().split() for text in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        words = set().union(*(words for words in short if words)).difference(self.known)
        again = words.intersection(self.older)
        self.known.update((word, self.older[word]) for word in again)
        self._learn(list(words - again))
        look = self.known.__getitem__
        return [
            self.count_long(text) if words is None else sum(map(look, words))
            for text, words in zip(texts, short, strict=True)
        ]

    def _learn(self, words: list[bytes], together: int = 300) -> None:
        """Token counts of new words, many joined by blanks in one encoding, told apart by the offsets."""
        plain = [word.decode() for word in words]
        groups = [plain[start : start + together] for start in range(0, len(plain), together)]
        counts: list[int] = []
        for begin in range(0, len(groups), 20):
            part = groups[begin : begin + 20]
            for group, encoding in zip(part, self.tokenizer.encode_batch([" ".join(g) for g in part], add_special_tokens=False), strict=True):
                starts = np.cumsum([0] + [len(word) + 1 for word in group[:-1]])
                offsets = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(encoding))
                counts += np.bincount(np.searchsorted(starts, offsets, "right") - 1, minlength=len(group)).tolist()
        self.known.update(zip(words, counts, strict=True))

    def _encode(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        encoding = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return [(a + start, b + start, i) for (a, b), i in zip(encoding.offsets, encoding.ids, strict=True)]

    def count_long(self, text: str) -> int:
        """Tokens of one text, encoded chunk by chunk."""
        total, begin, left_start, left_end = 0, 0, 0, min(len(text), self.chunk)
        left = self._encode(text, left_start, left_end)
        while left_end < len(text):
            overlap, chunk = self.overlap, self.chunk
            while True:
                right_start = max(begin, left_end - overlap)
                right_end = min(len(text), right_start + chunk)
                right = self._encode(text, right_start, right_end)
                cut = self._splice(text, left, right, right_start, left_end)
                if cut is not None:
                    break
                self.widened += 1
                overlap *= 2
                if overlap >= left_end - begin:  # nothing to align with: take both chunks as one
                    chunk *= 2
                    left_end = min(len(text), left_end + chunk)
                    left = self._encode(text, begin, left_end)
                    if left_end == len(text):
                        return total + sum(1 for a, _, _ in left if a >= begin)
                chunk = max(chunk, 2 * overlap)
            total += sum(1 for a, b, _ in left if a >= begin and b <= cut)
            begin, left, left_end = cut, right, right_end
        return total + sum(1 for a, _, _ in left if a >= begin)

    @staticmethod
    def _splice(text: str, left: list, right: list, start: int, end: int) -> int | None:
        """A stable boundary common to both encodings of ``text[start:end]``, or None.

        The first stable boundary bounds what the cut at the start of the right chunk may have changed, the last one
        what the cut at the end of the left chunk may have changed; between the two the tokens must be equal.
        """
        stable = [p for p in range(start + 1, end) if text[p - 1] in _STABLE_AFTER]
        if not stable:
            return None
        first, last = stable[0], stable[-1]
        for tokens in (left, right):
            if any(a < first < b or a < last < b for a, b, _ in tokens):
                return None
        if [t for t in left if t[0] >= first and t[1] <= last] != [t for t in right if t[0] >= first and t[1] <= last]:
            return None
        return first


@functools.lru_cache(maxsize=2)
def _counter(path: str, chunk: int, overlap: int) -> TokenCounter:
    return TokenCounter(path, chunk, overlap)


def tokenizer_path(name: str) -> str:
    """Where this machine keeps the named public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the name of a public vocabulary file, which each worker opens for itself.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizer_path(tokenizer), chunk, overlap)
        for texts in batches:
            values = [None if text is None else text for text in texts]
            counts: list[int] = []
            for begin in range(0, len(values), 500):
                counts += counter.count_all(values[begin : begin + 500])
            yield pd.Series(counts, dtype="int64")

    table = pick(docs, doc_id=id_col, text=text_col)
    counted = table.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        tokens("text").alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
