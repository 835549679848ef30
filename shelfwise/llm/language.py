"""Language identification by spans.

Letters are sorted into scripts by code-point ranges, and the script of a word narrows the languages that can own it to
those whose training texts use that script. Each remaining language scores the word by naive Bayes over the word's letter
trigrams (with its edges) and the word itself. A Viterbi pass over the words, with a penalty for every change of
language, labels spans; the document gets the language that owns most letters.

The classifier is fitted on a bounded sample: at most ``per_language`` labelled documents of each language (drawn by a
hash of the id), never held-out ones. The model has (number of languages) x (``FEATURES`` + scripts) numbers.
Prediction sees the text only, and the whole of it.

Texts that are null or hold no letter get ``und`` with score 0 and no spans; so does everything when nothing was
labelled. Ties go to the language first in alphabetical order. Rows with equal ids are independent.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import fresh, pick, quoted, remembered, small_batches

FEATURES = 1 << 15
#: Labelled documents per language that the classifier is fitted on.
PER_LANGUAGE = 4_000
#: What a change of language costs, in nats.
SWITCH = 14.0
UNDETERMINED = "und"
#: Words remembered by one worker before it starts anew.
REMEMBERED = 150_000
#: Texts whose words a worker holds as separate objects at a time.
SPLIT_AT_ONCE = 200
# First code points of the ranges of some scripts; "other" between them.
SCRIPTS = [
    (0x41, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
    (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "other"), (0xB80, "tamil"),
    (0xC00, "telugu"), (0xC80, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [start for start, _ in SCRIPTS]
_NAMES = [name for _, name in SCRIPTS]
SCRIPT_NAMES = sorted(set(_NAMES))
_NUMBER = {name: number for number, name in enumerate(SCRIPT_NAMES)}
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def script_of(letter: str) -> int:
    """Number of the script of a letter in ``SCRIPT_NAMES``."""
    at = bisect.bisect_right(_STARTS, ord(letter)) - 1
    return _NUMBER[_NAMES[at]] if at >= 0 else _NUMBER["other"]


def letters_of(word: str) -> str:
    """The letters of a word in lower case."""
    return "".join(_LETTERS.findall(word)).lower()


def features_of(letters: str) -> list[int]:
    """Feature numbers of a word: itself and its trigrams with edges."""
    edged = f"^{letters}$"
    parts = [edged, *[edged[i : i + 3] for i in range(len(edged) - 2)]]
    return [zlib.crc32(part.encode()) % FEATURES for part in parts]


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # FEATURES x languages, logarithms
    allowed: np.ndarray  # scripts x languages, true where the language uses the script
    words: dict[bytes, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def __getstate__(self):
        return {"languages": self.languages, "scores": self.scores, "allowed": self.allowed}

    def __setstate__(self, state):
        self.__init__(**state)

    def _learn(self, words: list[bytes]) -> None:
        """Scores of words seen for the first time; rows of zeros for words without letters."""
        letters = [letters_of(word.decode()) for word in words]
        features = [features_of(x) if x else [] for x in letters]
        counts = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter((f for word in features for f in word), np.int64, int(counts.sum()))
        rows = np.zeros((len(words), len(self.languages)), np.float32)
        some = np.flatnonzero(counts)
        if len(some):
            rows[some] = np.add.reduceat(self.scores[flat], np.concatenate([[0], np.cumsum(counts[some])[:-1]]), axis=0)
            candidates = self.allowed[[script_of(letters[i][0]) for i in some]]
            candidates |= ~candidates.any(axis=1, keepdims=True)
            rows[some] = np.where(candidates, rows[some] - rows[some].max(axis=1, keepdims=True), -1e3)
        self.words.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.table = np.concatenate([self.table.reshape(-1, len(self.languages)), rows])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, letters), np.int32, len(letters))])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of letters, spans of words [first, last) in one language) of every text."""
        if len(self.words) > REMEMBERED:
            self.words, self.table, self.sizes = {}, np.zeros((0, 0), np.float32), np.zeros(0, np.int32)
        numbers: list[np.ndarray] = []
        for begin in range(0, len(texts), SPLIT_AT_ONCE):  # words as objects are many times as large as their numbers
            split = [(text or "").encode().split() for text in texts[begin : begin + SPLIT_AT_ONCE]]
            missing = list(set().union(*split).difference(self.words))
            if missing:
                self._learn(missing)
            look = self.words.__getitem__
            numbers += [np.fromiter(map(look, words), np.int32, len(words)) for words in split]
        nothing = (UNDETERMINED, 0.0, [])
        if not self.languages:
            return [nothing for _ in texts]
        found: list = [nothing] * len(texts)
        lettered = [n[self.sizes[n] > 0] if len(n) else n for n in numbers]
        order = sorted((i for i, n in enumerate(lettered) if len(n)), key=lambda i: len(lettered[i]))
        start = 0
        while start < len(order):  # texts of like length side by side, at most about a million words with padding
            stop = start + 1
            while stop < len(order) and (stop - start + 1) * len(lettered[order[stop]]) <= 1 << 20:
                stop += 1
            part = order[start:stop]
            for i, labels in zip(part, self._label([lettered[i] for i in part]), strict=True):
                where = np.flatnonzero(self.sizes[numbers[i]] > 0)
                owned = np.bincount(labels, weights=self.sizes[lettered[i]], minlength=len(self.languages))
                best = int(owned.argmax())
                edges = np.flatnonzero(np.diff(labels)) + 1
                firsts, lasts = [0, *edges], [*edges, len(labels)]
                spans = [(int(where[a]), int(where[b - 1]) + 1, self.languages[labels[a]]) for a, b in zip(firsts, lasts, strict=True)]
                found[i] = (self.languages[best], float(owned[best] / owned.sum()), spans)
            start = stop
        return found

    def _label(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi for many texts at once: the best language of every word."""
        size, width = max(map(len, texts)), len(self.languages)
        words = np.full((len(texts), size), -1, np.int32)
        for row, numbers in zip(words, texts, strict=True):
            row[: len(numbers)] = numbers
        table = np.concatenate([self.table, np.zeros((1, width), np.float32)])  # the last row is for padding
        same = np.arange(width, dtype=np.int16)
        back = np.empty((size, len(texts), width), np.int16)
        value = table[words[:, 0]].astype(np.float64)
        for step in range(1, size):
            best = value.argmax(axis=1)
            switched = value[np.arange(len(texts)), best][:, None] - SWITCH
            stays = value >= switched
            back[step] = np.where(stays, same, best[:, None])
            value = np.where(stays, value, switched) + table[words[:, step]]
        label = value.argmax(axis=1)
        labels = np.empty((size, len(texts)), np.int16)
        for step in range(size - 1, -1, -1):
            labels[step] = label
            if step:
                label = back[step, np.arange(len(texts)), label]
        return [labels[: len(numbers), i] for i, numbers in enumerate(texts)]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of (language, feature); features from FEATURES on are scripts, counted by letters."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            own = totals.setdefault(lang, np.zeros(FEATURES + len(SCRIPT_NAMES), np.int64))
            words: Counter[bytes] = Counter()
            for text in texts:
                words.update(text.encode().split())
            for word, count in words.items():
                letters = letters_of(word.decode())
                if letters:
                    for feature in features_of(letters):
                        own[feature] += count
                    own[FEATURES + script_of(letters[0])] += count
    for lang, own in totals.items():
        some = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "feature": some, "count": own[some]})


def train(docs: DataFrame, learnable: Column, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit the classifier on a bounded sample of the rows where ``learnable`` holds.

    The driver sees the number of rows per language and the model itself.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(learnable & quoted(lang_col).isNotNull() & quoted(text_col).isNotNull() & quoted(id_col).isNotNull())
    rows = pick(rows, key=id_col, text=text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string"))
    sizes = {row["lang"]: row["count"] for row in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], np.zeros((FEATURES, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    counts = sample.mapInPandas(_counts, "lang string, feature long, count long")
    table = counts.groupBy("lang", "feature").agg(F.sum("count").alias("count")).toPandas()
    languages = sorted(sizes)
    number = {lang: i for i, lang in enumerate(languages)}
    dense = np.zeros((FEATURES + len(SCRIPT_NAMES), len(languages)))
    dense[table["feature"].to_numpy(np.int64), table["lang"].map(number).to_numpy(np.int64)] = table["count"]
    words, scripts = dense[:FEATURES] + 0.3, dense[FEATURES:]
    scores = np.log(words / words.sum(axis=0))
    allowed = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(languages, scores.astype(np.float32), allowed)


def predictor(model: LanguageModel, with_spans: bool = True):
    """A column function text -> struct(lang, score, spans), or without the spans where nobody reads them."""
    kind = "lang string, score double" + ", spans array<struct<first:int,last:int,lang:string>>" * with_spans
    key = hashlib.sha256(repr(model.languages).encode() + model.scores.tobytes() + model.allowed.tobytes()).digest()

    @F.pandas_udf(kind)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = remembered(("language", key), lambda: model)
        for texts in batches:
            rows = []
            for begin in range(0, len(texts), 2_000):
                found = own.predict(list(texts[begin : begin + 2_000]))
                rows += found if with_spans else [(lang, score) for lang, score, _ in found]
            frame = pd.DataFrame(rows, columns=["lang", "score", "spans"][: 2 + with_spans])
            if with_spans:
                frame["spans"] = [[{"first": a, "last": b, "lang": c} for a, b, c in spans] for spans in frame["spans"]]
            yield frame

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose ids the classifier never learns from (false for null ids)."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, spans (ranges of words and their language)."""
    model = train(docs, ~held_out(id_col), id_col, text_col, lang_col, per_language)
    found = pick(docs, doc_id=id_col, text=text_col).select("doc_id", predictor(model)("text").alias("p"))
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"),
        F.col("p.spans").alias("spans"),
    )


def keep_identified(
    docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` whose text has a language that owns at least ``min_score`` of its letters."""
    model = train(docs, ~held_out(id_col), id_col, text_col, lang_col)
    name = fresh(docs, "_language")
    marked = docs.withColumn(name, predictor(model, False)(quoted(text_col)))
    kept = marked.filter((quoted(name)["lang"] != UNDETERMINED) & (quoted(name)["score"] >= min_score))
    return kept.drop(quoted(name))


__all__ = ["LanguageModel", "held_out", "identify", "keep_identified", "train"]
