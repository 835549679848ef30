"""Spelling variants: words one edit apart, found through a reduced alphabet.

1. *Vocabulary*: maximal runs of letters of all texts, A-Z lower-cased, with one letter taken out of about one run in
   ``DAMAGE`` (decided by the CRC-32 of document and run); results of ``LEAST_LENGTH`` letters or more that occur
   ``LEAST_COUNT`` times. Occurrences are counted before anything is shuffled.
2. *Reduction*: every letter becomes one of ``CLASSES`` symbols (its code point modulo ``CLASSES``), and every word gets the
   full one-edit neighbourhood of its reduced form: deletions, replacements and insertions at every place. A neighbour's key
   also holds the exact letters of that half of the word which the edit does not touch, so that lists of equal keys stay short
   however large the vocabulary is. Of two neighbouring reduced forms only the one with the smaller hash proposes.
3. *Join*: proposed keys meet the two keys (one per half) of every word's own reduced form.
4. *Verification*: only pairs of original words at an edit distance of exactly one leave the join. Keys are hashes; a
   collision adds a candidate that is verified away and never loses one.

A word's form is its near word of largest count, if that count is at least ``RATIO`` times its own; forms are followed to the
last one. Counts grow tenfold with each step, so few passes are needed.

Null and empty texts have no words. A null id counts as an empty one in the CRC. Rows with equal ids are read one by one. Runs
of any length are taken whole. Equal counts: the smaller word in code-point order is the form. An empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import empty, pick, stored

LEAST_LENGTH, LEAST_COUNT, DAMAGE, RATIO = 7, 2, 31, 10
#: Symbols of the reduced alphabet.
CLASSES = 4
#: Letters of the words whose neighbourhoods are generated at a time.
STEP_LETTERS = 1 << 15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    # shorter runs cannot give a word that is long enough, damaged or not
    runs = F.regexp_extract_all("text", F.lit(rf"([A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}})"), F.lit(1))
    found = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.explode(runs).alias("run"))
    found = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.translate("run", _UPPER, _LOWER).alias("run"))
    found = found.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    words = found.select(F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word"))
    words = words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.filter(F.col("n") >= LEAST_COUNT)


# ---- keys ---------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOLS = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(CLASSES)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(sums: np.ndarray, length: int) -> np.ndarray:
    """Hash of reduced words from their symbol sums."""
    return _mixed(sums + np.uint64(length * 0xA0761D6478BD642F % (1 << 64)))


def _ends(letters: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last ``size`` letters."""
    powers = np.cumprod(np.full(size, _BASE))
    scattered = _mixed(letters)
    return _mixed(scattered[:, :size] @ powers + np.uint64(1)), _mixed(scattered[:, -size:] @ powers + np.uint64(2))


def _anchor(length: int) -> int:
    """Exact letters in the keys of words of this length: no edit in the other half of a word touches them."""
    return (length - 1) // 2


def _sums(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol values, powers of the base per place (one more than letters) and sums before each place."""
    values = _SYMBOLS[letters % CLASSES]
    powers = np.ones(letters.shape[1] + 1, np.uint64)
    powers[1:] = np.cumprod(np.full(letters.shape[1], _BASE))
    sums = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    np.cumsum(values * powers[:-1], axis=1, out=sums[:, 1:])
    return values, powers, sums


def own_keys(letters: np.ndarray) -> np.ndarray:
    """The two keys of each word (row of code points; all of one length) under its own reduced form."""
    own = _hashed(_sums(letters)[2][:, -1], letters.shape[1])
    return np.stack([_mixed(own ^ end) for end in _ends(letters, _anchor(letters.shape[1]))], axis=1)


def proposed_keys(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under all reduced forms one edit away (the own one is among them), and which of them to use:
    each key of a row once, and only forms of no smaller hash than the own one.
    """
    rows, length = letters.shape
    values, powers, sums = _sums(letters)
    own, half = _hashed(sums[:, -1], length), length // 2
    after = sums[:, -1:] - sums
    ends = {size: _ends(letters, _anchor(size)) for size in (length - 1, length, length + 1)}
    forms, kept = [np.repeat(own[:, None], 2, axis=1)], [np.stack(ends[length], axis=1)]

    def add(changed: np.ndarray, size: int) -> None:
        # an edit in the first half leaves the tail as it is, any other the head
        head, tail = ends[size]
        forms.append(_hashed(changed, size))
        kept.append(np.where(np.arange(changed.shape[1]) < half, tail[:, None], head[:, None]))

    add(sums[:, :-1] + after[:, 1:] * _BACK, length - 1)
    for symbol in _SYMBOLS:
        add(sums[:, -1:] + (symbol - values) * powers[:-1], length)
        add(sums + symbol * powers + after * _BASE, length + 1)
    form, end = np.concatenate(forms, axis=1), np.concatenate(kept, axis=1)
    keys = np.where(form >= own[:, None], _mixed(form ^ end), np.uint64(0))
    keys.sort(axis=1)
    use = keys != 0
    use[:, 1:] &= keys[:, 1:] != keys[:, :-1]
    return keys, use


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and code points of words of equal length, a bounded number of letters at a time."""
    lengths = np.array([len(word) for word in words])
    for length in np.unique(lengths):
        which = np.flatnonzero(lengths == length)
        step = max(1, STEP_LETTERS // int(length))
        for low in range(0, len(which), step):
            some = which[low : low + step]
            letters = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), "<u4").reshape(len(some), length)
            yield some, letters.astype(np.uint64)


def _keys(words: DataFrame, proposed: bool) -> DataFrame:
    """(key, word, n) rows of the words, under their own or the proposed keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, letters in _by_length(batch.column("word").to_pylist()):
                if proposed:
                    keys, use = proposed_keys(letters)
                    keys, owners = keys[use], np.repeat(some, use.sum(axis=1))
                else:
                    keys, owners = own_keys(letters).ravel(), np.repeat(some, 2)
                owners = pa.array(owners)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), batch.column("word").take(owners), batch.column("n").take(owners)], names=["key", "word", "n"]
                )

    return words.mapInArrow(rows, "key long, word string, n long")


# ---- variants -----------------------------------------------------------------


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), each pair of near words once, of a vocabulary (word, n)."""
    left = _keys(words, True).toDF("key", "a", "n_a")
    right = _keys(words, False).toDF("key", "b", "n_b")
    # verified within the join: candidates never become rows
    pairs = left.join(right, (left["key"] == right["key"]) & (F.levenshtein("a", "b", 1) == 1)).drop("key")
    low = F.col("a") < F.col("b")
    return pairs.select(
        F.least("a", "b").alias("a"), F.when(low, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.greatest("a", "b").alias("b"), F.when(low, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for stored (word, form) rows; forms are followed to a word that has none, twice as far each pass."""
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        further = up.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved"))
        further = stored(further)
        up = further.select("word", "root")
        if empty(further.filter("moved")):
            return up


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    words = stored(vocabulary(docs, id_col, text_col))
    pairs = near_words(words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))
    )
    both = pairs.select(F.explode(sides).alias("s")).select("s.word", "s.near", "s.m")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.m")).alias("m")
    )
    clear = F.col("m") >= RATIO * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(clear, F.col("near")).alias("form"), F.when(clear, F.col("m")).alias("form_n")))
    ends = roots(stored(found.filter("form IS NOT NULL").select("word", "form")))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in SQL; the CRC is computed from its polynomial.
VARIANTS_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i)
  )
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
), counted AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END)),
    lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS h
  FROM counted, crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), places AS (
  SELECT word, n, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT DISTINCT p.word AS a, w.word AS b, p.n AS n_a, w.n AS n_b FROM places p JOIN words w ON w.word = p.head || p.tail
), near AS MATERIALIZED (
  SELECT a AS word, b AS near, n_b AS m FROM pairs UNION SELECT b, a, n_a FROM pairs
  UNION SELECT p.word, q.word, q.n FROM places p JOIN places q ON p.head = q.head AND p.tail = q.tail AND p.word <> q.word
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, m FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, near) = 1
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)
), climb AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM climb c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN climb c ON c.word = f.word JOIN formed g ON g.word = c.root AND g.form IS NULL
"""
