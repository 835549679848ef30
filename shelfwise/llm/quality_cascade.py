"""Quality rules as a short-circuit cascade.

Every rule is a condition that rejects a document. Its cost (seconds on a sample) and its selectivity (rejections on the
same sample) are measured first; the rules then stand in one CASE expression ordered by rejections per second, so that a
document leaves at the first rule that rejects it and dear rules see only what cheap ones let through. The verdict is the
same in any order. Only DataFrame functions are used; nothing is shuffled.

Counts cover whole texts (null: no words). Words are runs of characters other than blanks; ``n_repeat_words`` counts each
word position once, however many repeated windows it stands in. Rows with equal ids are independent. The sample of at most about
``SAMPLE`` rows only sets the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import BLANKS, WORD, pick, seconds

SAMPLE = 2_000
SYMBOLS = "#*$%&|<>"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of three that occurs twice or more.

    The windows' hashes are sorted with their positions; equal neighbours are repeats.
    """
    size = F.size(words)
    grams = F.transform(
        F.sequence(F.lit(1), size - 2),
        lambda i: F.struct(F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("g"), i.alias("p")),
    )

    def positions(ordered: Column) -> Column:
        twice = F.zip_with(
            ordered, F.slice(ordered, 2, F.size(ordered)),
            lambda a, b: F.when(a["g"] == b["g"], F.array(a["p"], b["p"])),
        )
        starts = F.flatten(F.filter(twice, lambda pair: pair.isNotNull()))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def count(all_grams: Column) -> Column:
        different = F.size(F.array_distinct(F.transform(all_grams, lambda x: x["g"])))
        return F.when(different == F.size(all_grams), F.lit(0)).otherwise(bind(F.sort_array(all_grams), positions))

    return F.when(size < 4, F.lit(0)).otherwise(bind(grams, count)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (never null) and the five base counts."""
    table = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    counted = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return table.select("doc_id", "text", counted.alias("w")).select(
        "doc_id", "text", F.col("w.n_words").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Conditions that reject a document, on the columns of ``measures``."""
    text, words = F.col("text"), F.col("n_words")
    return {
        "symbols": 10 * F.col("n_symbols") > words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words),
        "repeated_lines": 100 * F.col("n_dup_lines") > 50 * F.regexp_count(text, F.lit(r"\n")) + 50,
        "capitals": 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) > F.regexp_count(text, F.lit(r"\p{L}")),
        "letters": 2 * F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*")) < words,
        "ellipses": 10 * F.regexp_count(text, F.lit(r"(?:\.\.\.|…)[\x20\t\r]*(?:\n|$)")) > 3 * F.regexp_count(text, F.lit(r"\n")) + 3,
        "urls": 10 * F.regexp_count(text, F.lit(r"https?://")) > words,
    }


def sample_of(docs: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows; drawn before anything is computed from them."""
    return docs.sample(min(1.0, sample / max(1, docs.count())), seed=7)


def rule_order(part: DataFrame, conditions: dict[str, Column]) -> list[str]:
    """Rules by rejections per second of cost, both taken from a sample."""
    part = part.persist()
    try:
        part.count()
        seconds(lambda: part.agg(F.count(F.lit(1))).collect())
        idle = seconds(lambda: part.agg(F.count(F.lit(1))).collect())
        value = {}
        for name, condition in conditions.items():
            hits: list[int] = []
            cost = seconds(lambda condition=condition, hits=hits: hits.append(part.agg(F.count_if(condition)).first()[0]))
            value[name] = (hits[0] + 0.5) / max(cost - idle, 1e-3)
    finally:
        part.unpersist()
    return sorted(conditions, key=lambda name: -value[name])


def passes(conditions: dict[str, Column], order: list[str]) -> Column:
    """False at the first rule that rejects; later rules are not evaluated then."""
    verdict = F.lit(True)
    for name in reversed(order):
        verdict = F.when(F.coalesce(conditions[name], F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    conditions = rules()
    # texts without the costly counts are enough to set the order
    cheap = sample_of(pick(docs, text=text_col), sample).select(
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("n_words"),
        F.coalesce(F.length(F.translate("text", BLANKS, "")), F.lit(0)).alias("word_chars"),
        F.coalesce(count_of(F.col("text"), SYMBOLS), F.lit(0)).alias("n_symbols"),
        F.coalesce(duplicate_lines(F.col("text")), F.lit(0)).alias("n_dup_lines"),
    )
    order = rule_order(cheap, conditions)
    counted = measures(docs, id_col, text_col).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(passes(conditions, order))).drop("text")



#: The same counts and verdict in one piece of SQL.
QUALITY_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
  SELECT doc_id, i, concat_ws(chr(1), words[i], words[i + 1], words[i + 2]) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), again AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id
), counted AS (
  SELECT s.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON s.doc_id = r.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, len(regexp_extract_all(text, '\n')) AS breaks FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_dup_lines > 50 * breaks + 50
    OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > len(regexp_extract_all(text, '\p{L}'))
    OR 2 * len(list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: regexp_matches(w, '\p{L}'))) < n_words
    OR 10 * len(regexp_extract_all(text, '(?:\.\.\.|…)[\x20\t\r]*(?:\n|$)')) > 3 * breaks + 3
    OR 10 * len(regexp_extract_all(text, 'https?://')) > n_words) AS kept
FROM judged
"""
