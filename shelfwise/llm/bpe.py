"""BPE encoding and decoding by speculation and verification.

A vocabulary with word ends (``word_bpe_49k.json``) is applied to the pre-tokens of a text:

1. *Propose*: greedy longest match over the vocabulary splits a word into tokens.
2. *Verify*: a split is the merges' own result exactly if every adjacent pair of tokens is compatible, that is if
   merging the symbols of just these two tokens ends with the two tokens again. (The first merge that crossed a
   boundary in the word would also happen in the pair alone, because the merges inside two neighbours do not depend on
   what lies around them before that.) All pairs of a batch are looked up at once in a sorted table of judged pairs;
   pairs seen for the first time are judged and added.
3. *Repair*: only words with an incompatible pair are merged exactly, by rank.

Words repeat, so a worker remembers the outcome per word between ASCII blanks; nothing in the tokenizer acts across one.

Null texts count as empty: no ids, an empty decoded text. Special strings inside texts become their special ids, as the
library does by default. Rows with equal ids are independent; texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import fresh, pick, quoted, remembered, small_batches, some_at_a_time
from shelfwise.llm.token_counts import tokenizer_path

#: Words (with their bytes and ids) and token pairs remembered by one worker before it starts anew, in bytes; of words the memory before is kept as well.
WORD_BYTES, PAIR_BYTES = 18 << 20, 6 << 20
#: Bytes that a remembered word takes besides its own and its ids' (two objects and their place in a dictionary).
ENTRY_BYTES = 150
#: Characters of the texts that are split into words at a time; a longer text goes alone.
AT_ONCE = 1 << 20
END = "</w>"
# Fixed values of the vocabulary file: white space of Unicode, and the pattern of its pre-tokens.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


@functools.cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        if model["end_of_word_suffix"] != END:
            raise ValueError("a vocabulary with word ends is needed")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.special = {token["content"]: token["id"] for token in data["added_tokens"]}
        self.tokens = {number: token for token, number in [*self.vocab.items(), *self.special.items()]}
        self.longest: dict[str, int] = {}  # longest token by its first two characters
        for token in self.vocab:
            size = len(token.removesuffix(END)) or len(token)
            self.longest[token[:2]] = max(size, self.longest.get(token[:2], 1))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        self.pair_keys = np.zeros(0, np.int64)
        self.pair_fits = np.zeros(0, bool)
        self.checked = self.repaired = 0

    # exact merging

    def symbols(self, piece: str) -> list[str]:
        letters = [self.letters[b] for b in piece.encode()]
        letters[-1] += END
        return letters

    def merge(self, parts: list[str]) -> list[str]:
        """Merges by rank, the leftmost first among equals."""
        parts, look, never = list(parts), self.ranks.get, 1 << 60
        ranks = [look(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = look((parts[at - 1], parts[at]), never)
            if at < len(ranks):
                ranks[at] = look((parts[at], parts[at + 1]), never)
        return parts

    # speculation

    def propose(self, parts: list[str]) -> list[int]:
        """Greedy longest match; parts are single symbols, so every step finds a token."""
        text, vocab, longest = "".join(parts), self.vocab.get, self.longest.get
        found, at, size = [], 0, len(parts)
        while at < size:
            end = at + longest(text[at : at + 2], 1)
            if end >= size:
                end = size
                number = vocab(text[at:])
                if number is not None:
                    found.append(number)
                    break
                end -= 1
            while (number := vocab(text[at:end])) is None:
                end -= 1
            found.append(number)
            at = end
        return found

    def _split_token(self, number: int) -> list[str]:
        token = self.tokens[number]
        if token.endswith(END) and len(token) > len(END):
            return [*token[: -len(END) - 1], token[-len(END) - 1 :]]
        return list(token)

    def _judge(self, key: int) -> bool:
        left, right = divmod(key, 1 << 32)
        return self.merge(self._split_token(left) + self._split_token(right)) == [self.tokens[left], self.tokens[right]]

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each key (left id * 2^32 + right id) whether the pair stays as it is."""
        different = np.unique(keys)
        new = different[~np.isin(different, self.pair_keys, assume_unique=True)]
        if len(new):
            if 9 * len(self.pair_keys) > PAIR_BYTES:
                self.pair_keys, self.pair_fits, new = np.zeros(0, np.int64), np.zeros(0, bool), different
            fits = np.fromiter((self._judge(int(key)) for key in new), bool, len(new))
            keys_all = np.concatenate([self.pair_keys, new])
            order = np.argsort(keys_all, kind="stable")
            self.pair_keys, self.pair_fits = keys_all[order], np.concatenate([self.pair_fits, fits])[order]
        return self.pair_fits[np.searchsorted(self.pair_keys, keys)]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of every (different) pre-token."""
        parts = [self.symbols(piece) for piece in pieces]
        ids = [self.propose(part) for part in parts]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((number for word in ids for number in word), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(ids)), sizes)
        inside = owner[1:] == owner[:-1]
        # a word that is one token needs no check: the merges reach every token of such a vocabulary
        keys = (flat[:-1][inside] << 32) | flat[1:][inside]
        if len(keys):
            wrong = np.unique(owner[1:][inside][~self.compatible(keys)])
            self.checked += len(pieces)
            self.repaired += len(wrong)
            for at in wrong:
                ids[at] = [self.vocab[part] for part in self.merge(parts[at])]
        return ids

    # texts

    def pieces(self, word: str) -> list[str | int]:
        """Pre-tokens of one word, special strings as their ids."""
        if word.isascii() and word.isalpha():
            return [word.lower()]
        found: list[str | int] = []
        for part in self.specials.split(word) if "<|" in word else (word,):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                # lower case letter by letter: a final sigma is no special case here
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += _PIECES.findall(plain)
        return found

    def learn(self, words: set[bytes]) -> None:
        """Encode words that are not remembered yet.

        When the memory is full, what it holds becomes the older half, from which words still in use come back.
        """
        if self.held > WORD_BYTES:
            self.older, self.words, self.held = self.words, {}, 0
        new = words.difference(self.words)
        again = new.intersection(self.older)
        for word in again:
            self.words[word] = ids = self.older[word]
            self.held += ENTRY_BYTES + len(word) + len(ids)
        new = list(new - again)
        split = [self.pieces(word.decode()) for word in new]
        different = list({piece for word in split for piece in word if isinstance(piece, str)})
        ids = dict(zip(different, self.encode_pieces(different), strict=True))
        for word, parts in zip(new, split, strict=True):
            numbers = [n for part in parts for n in ([part] if isinstance(part, int) else ids[part])]
            self.words[word] = pack(f"<{len(numbers)}I", *numbers)
            self.held += ENTRY_BYTES + len(word) + 4 * len(numbers)

    def decode(self, ids) -> str:
        """The library's decoding without a decoder: token texts joined by blanks."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of every text."""
        split = [(text or "").encode().split() for text in texts]
        self.learn(set().union(*split) if split else set())
        look = self.words.__getitem__
        for words in split:
            ids = b"".join(map(look, words))
            yield ids, self.decode(np.frombuffer(ids, "<u4").tolist())


def _coder(tokenizer: str, digest: bool):
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids array<int>, decoded string"

    @F.pandas_udf(kind)
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        path = tokenizer_path(tokenizer)
        bpe = remembered(("bpe", path), lambda: WordBpe(path))
        for texts in batches:
            rows = []
            for part in some_at_a_time(texts, AT_ONCE):
                for ids, decoded in bpe.encode_all(part):
                    if digest:
                        rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        rows.append((len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32), decoded))
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
            yield pd.DataFrame(rows, columns=names)

    return code


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (array of int), decoded (text)."""
    small_batches(docs.sparkSession)
    coded = pick(docs, doc_id=id_col, text=text_col).select("doc_id", _coder(tokenizer, False)("text").alias("c"))
    return coded.select("doc_id", "c.n_tokens", "c.ids", "c.decoded")


def encoding_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents`` with SHA-256 sums, built where the ids are: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(docs.sparkSession)
    coded = pick(docs, doc_id=id_col, text=text_col).select("doc_id", _coder(tokenizer, True)("text").alias("c"))
    return coded.select("doc_id", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


def with_encoding(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and n_tokens, ids_sha256, decoded_sha256 (renamed where the table has such columns)."""
    small_batches(docs.sparkSession)
    name = fresh(docs, "_coded")
    coded = docs.withColumn(name, _coder(tokenizer, True)(quoted(text_col)))
    added = [quoted(name)[field].alias(fresh(docs, field)) for field in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return coded.select(*[quoted(column) for column in docs.columns], *added)
