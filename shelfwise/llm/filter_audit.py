"""How quality filters interact: every order of five filters, from one pass over the bytes of each text.

*Transducer*: a finite-state machine over UTF-8 bytes with the states "between words" and "within a word" emits, per byte, the
start and the end of a word, a code point, a capital letter, a symbol. The state after a byte depends on the class of that
byte alone, so the states of a whole block are one table look-up in numpy; blocks are linked by the last state.

*Verified hash table*: the word spans of a slice of texts go into one open-addressing table, keyed by document and word. A
span that meets an occupied slot is a repetition only if document, length and all bytes agree; otherwise it moves on to the
next slot. Equal hashes of different words therefore never merge.

*Audit*: a document's failures are five bits, the last one (equal to the text of a smaller id anywhere in the table) found by
a digest of the text. Documents are counted per part and bits; only these few counts meet the 120 orders.

Null texts count as empty, null parts as the empty string. Rows with a null id have no labels, never fail E and make no other row fail it; rows
with equal ids are counted one by one and do not fail E because of each other. A document is good (toxic) if any of its label
rows says so. Texts of any length are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from shelfwise.llm.frames import pick, stored

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
#: Bytes that one step of the transducer reads, and bytes of texts whose words share one hash table.
BLOCK, SLICE = 1 << 18, 1 << 22
#: Longer words are hashed and compared one by one.
LONG_WORD = 128

BLANK, OTHER, CAPITAL, SYMBOL, CONTINUED = range(5)
STARTS, ENDS, POINT, UPPER, MARK = 1, 2, 4, 8, 16
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte, state after each class, output of each state and class."""
    kind = np.full(256, OTHER, np.uint8)
    kind[[32, *range(9, 14)]] = BLANK
    kind[ord("A") : ord("Z") + 1] = CAPITAL
    kind[list(SYMBOLS)] = SYMBOL
    kind[0x80:0xC0] = CONTINUED
    after = np.array([0, 1, 1, 1, 1], np.uint8)
    out = np.array([[POINT, POINT, POINT | UPPER, POINT | MARK, 0]] * 2, np.uint8)
    out[0, 1:] |= STARTS
    out[1, BLANK] |= ENDS
    return kind, after, out.ravel()


KIND, AFTER, OUT = _tables()


def transduce(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The output bits of every byte, and the state after the last one."""
    kinds = KIND[data]
    states = np.empty_like(kinds)
    states[0] = state
    states[1:] = AFTER[kinds[:-1]]
    return OUT[states * np.uint8(5) + kinds], int(AFTER[kinds[-1]])


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words:
    """Word spans of a buffer that is followed by eight spare bytes."""

    def __init__(self, buffer: bytes, owners: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.buffer, self.owners, self.starts, self.lengths = buffer, owners, starts, ends - starts
        self.eights = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))

    def part(self, which: np.ndarray, step: int) -> np.ndarray:
        """Bytes 8 x step to 8 x step + 7 of words that are longer than 8 x step; zeros after the end."""
        left = np.minimum(self.lengths[which] - 8 * step, 8)
        return self.eights[self.starts[which] + 8 * step] & _MASKS[left]

    def bytes_of(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.starts[i] + self.lengths[i]]

    def hashes(self) -> np.ndarray:
        found = _mixed(self.owners.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.lengths.astype(np.uint64))
        short = np.flatnonzero(self.lengths <= LONG_WORD)
        step = 0
        while short.size:
            found[short] = _mixed(found[short] ^ self.part(short, step))
            step += 1
            short = short[self.lengths[short] > 8 * step]
        for i in np.flatnonzero(self.lengths > LONG_WORD):
            found[i] ^= np.uint64(hash(self.bytes_of(i)) & 0xFFFFFFFFFFFFFFFF)
        return found

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` belong to one document and agree in all bytes."""
        same = (self.owners[a] == self.owners[b]) & (self.lengths[a] == self.lengths[b])
        left = np.flatnonzero(same & (self.lengths[a] <= LONG_WORD))
        step = 0
        while left.size:
            agree = self.part(a[left], step) == self.part(b[left], step)
            same[left[~agree]] = False
            step += 1
            left = left[agree & (self.lengths[a[left]] > 8 * step)]
        for i in np.flatnonzero(same & (self.lengths[a] > LONG_WORD)):
            same[i] = self.bytes_of(a[i]) == self.bytes_of(b[i])
        return same


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def one_of_each(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Marks one occurrence of every word, by insertion into a table with linear probing; one probe of all waiting words a round."""
    mask = (1 << int(2 * len(hashes) + 1).bit_length()) - 1
    table = np.full(mask + 1, -1, np.int64)
    slots = (hashes & np.uint64(mask)).astype(np.int64)
    fresh = np.zeros(len(hashes), bool)
    waiting = np.arange(len(hashes))
    while waiting.size:
        at = slots[waiting]
        free = table[at] < 0
        table[at[free]] = waiting[free]
        holder = table[at]
        mine = holder == waiting
        fresh[waiting[mine]] = True
        other, holder = waiting[~mine], holder[~mine]
        alike = hashes[other] == hashes[holder]
        alike[alike] = words.equal(other[alike], holder[alike])
        waiting = other[~alike]
        slots[waiting] = (slots[waiting] + 1) & mask
    return fresh


def measure(texts: list[bytes]) -> np.ndarray:
    """One row of ``COUNTS`` per UTF-8 text."""
    counts = np.zeros((len(texts), len(COUNTS)), np.int64)
    if not texts:
        return counts
    # one blank after each text ends its last word
    buffer = b" ".join([*texts, bytes(8)])
    data = np.frombuffer(buffer, np.uint8)
    ends = np.cumsum([len(text) + 1 for text in texts])
    begins = np.concatenate([[0], ends[:-1]])
    starts, stops, state = [], [], 0
    for low in range(0, int(ends[-1]), BLOCK):
        high = min(low + BLOCK, int(ends[-1]))
        out, state = transduce(data[low:high], state)
        starts.append(np.flatnonzero(out & STARTS) + low)
        stops.append(np.flatnonzero(out & ENDS) + low)
        first, last = np.searchsorted(begins, low, "right") - 1, np.searchsorted(begins, high, "left")
        bounds = np.maximum(begins[first:last] - low, 0)
        for column, bit in ((0, STARTS), (2, UPPER), (3, POINT), (4, MARK)):
            counts[first:last, column] += np.add.reduceat((out & bit) != 0, bounds, dtype=np.int64)
    counts[:, 3] -= 1
    owners = np.repeat(np.arange(len(texts)), counts[:, 0])
    words = Words(buffer, owners, np.concatenate(starts), np.concatenate(stops))
    counts[:, 1] = np.bincount(owners[one_of_each(words, words.hashes())], minlength=len(texts))
    return counts


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    taken: list[bytes] = []
    size = 0
    for text in texts:
        if taken and size + len(text) > SLICE:
            yield taken
            taken, size = [], 0
        taken.append(text)
        size += len(text)
    yield taken


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, the SHA-256 of the text and ``COUNTS`` for every row."""
    table = pick(docs, doc_id=id_col, part=part_col, text=text_col)
    table = table.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    schema = StructType(table.schema.fields[:2]).add("digest", "binary")
    for name in COUNTS:
        schema = schema.add(name, "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            counts = np.concatenate([measure(part) for part in _slices(texts)])
            digests = pa.array([hashlib.sha256(text).digest() for text in texts], pa.binary())
            columns = [batch.column("doc_id"), batch.column("part"), digests, *(pa.array(column) for column in counts.T)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return table.mapInArrow(rows, schema)


def failures() -> dict[str, Column]:
    """The filters that look at one text, as conditions on ``COUNTS``."""
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 3 * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }


def with_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, ``COUNTS`` and ``fails``, a bit per filter (A is 1, E is 16), for every row."""
    table = stored(measured(docs, id_col, text_col, part_col))
    # joined by text and id, so that the copies of one text are spread
    firsts = table.groupBy(F.col("digest").alias("text")).agg(F.min("doc_id").alias("first_id"))
    table = table.join(firsts, (F.col("digest") == F.col("text")) & (F.col("doc_id") == F.col("first_id")), "left")
    bits = sum(F.when(condition, F.lit(1 << FILTERS.index(name))).otherwise(F.lit(0)) for name, condition in failures().items())
    later = F.when(F.col("doc_id").isNotNull() & F.col("first_id").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    return table.select("doc_id", "part", *COUNTS, (bits + later).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step and the counts
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    label = pick(labels, label_id="doc_id", quality="quality", toxic="toxic").filter("label_id IS NOT NULL").groupBy("label_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    table = with_failures(docs, id_col, text_col, part_col).select("doc_id", "part", "fails")
    table = table.join(label, F.col("doc_id") == F.col("label_id"), "left")
    cells = table.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    steps = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substr("filter_order", "step", F.lit(1))
    here = sum(F.when(letter == name, F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(FILTERS))
    before = sum(F.when(F.instr("filter_order", name) < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(FILTERS))
    steps = steps.select("*", letter.alias("letter"), F.col("fails").bitwiseAND(here).alias("now"), F.col("fails").bitwiseAND(before).alias("earlier"), here.alias("bit"))

    def total(value: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0))).cast("long")

    gone = (F.col("now") > 0) & (F.col("earlier") == 0)
    result = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total("docs", (F.col("now") == 0) & (F.col("earlier") == 0)).alias("kept"), total("docs", gone).alias("removed"),
        total("docs", (F.col("now") > 0) & (F.col("earlier") > 0)).alias("redundant"), total("docs", F.col("fails") == F.col("bit")).alias("unique_fails"),
        total("good", gone).alias("good_lost"), total("toxic", gone).alias("toxic_lost"),
    )
    return result.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")).cast("long")).drop("letter")


#: The same audit in one piece of SQL.
AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts
), failing AS (
  SELECT doc_id, part, CAST(len(words) < 200 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT) AS b,
    CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d,
    CAST(coalesce(doc_id > first_id, false) AS INT) AS e
  FROM split
), label AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failing LEFT JOIN label USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter
), orders AS (
  SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order
  FROM letters p JOIN letters q ON q.letter <> p.letter JOIN letters r ON r.letter NOT IN (p.letter, q.letter)
  JOIN letters s ON s.letter NOT IN (p.letter, q.letter, r.letter) JOIN letters t ON t.letter NOT IN (p.letter, q.letter, r.letter, s.letter)
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, CAST(pow(2, instr('ABCDE', filter_order[step]) - 1) AS INT) AS bit,
    CAST(list_sum(list_transform(range(1, step), lambda i: pow(2, instr('ABCDE', filter_order[i]) - 1))) AS INT) AS mask
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
), counted AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN fails & bit = 0 AND fails & coalesce(mask, 0) = 0 THEN docs ELSE 0 END) AS kept,
    sum(CASE WHEN fails & bit > 0 AND fails & coalesce(mask, 0) = 0 THEN docs ELSE 0 END) AS removed,
    sum(CASE WHEN fails & bit > 0 AND fails & coalesce(mask, 0) > 0 THEN docs ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & bit > 0 AND fails & coalesce(mask, 0) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & bit > 0 AND fails & coalesce(mask, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
