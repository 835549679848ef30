"""Removal of runs of lines that occurred before, found by winnowing.

A *window* is a shortest stretch of lines with at least ``min_words`` words: one opens at every line and one closes at
every line. The fingerprint of a window is its smallest line hash. Equal stretches select equal fingerprints, so a run of that
many words that occurs twice is guaranteed to leave the same fingerprint in both places. Only the selected positions are posted
(a few per window length); fingerprints posted once are dropped, and with them nearly all windows. The windows of the others are
joined with the first place of the same window. A run is extended both ways by this: its opening windows carry the match back to its
first line, its closing windows forward to its last one, and every line of the run lies in one of them.

A line is deleted exactly if it lies in a window all of whose lines occurred, in the same order, at an earlier
place: in a document with a smaller id, or further up in the same document without overlapping itself. So the first
occurrence always stays. Lines without words take no part and stay. Only DataFrame functions are used.

Null texts stay null, with 0 lines. Documents are ordered by id (null first), then by a hash of the text; rows equal in both
count as one document and get the same result. A key that a third of all rows share is aggregated map-side and joined only after its
places were reduced to the first. Texts are shuffled only for documents that a fixed-size filter of the deletions lets through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import BLANKS, WORD, fresh, pick, quoted, stored
from shelfwise.llm.quality_cascade import bind

MIN_WORDS = 50
#: Bits of the filter that tells which documents may lose lines; its rows, one per 64 bits, are few enough to broadcast.
FILTER_BITS = 1 << 24


def has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def _reach(counts: Column, start: Column, min_words: int) -> Column:
    """Lines from ``start`` on until the words suffice; 0 if they never do. Every line has a word, which bounds the look ahead."""
    first = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))

    def step(acc: Column, words: Column) -> Column:
        return F.when(acc["words"] >= min_words, acc).otherwise(
            F.struct((acc["words"] + words).alias("words"), (acc["lines"] + 1).alias("lines"))
        )

    return F.aggregate(
        F.slice(counts, start, min_words), first, step, lambda acc: F.when(acc["words"] >= min_words, acc["lines"]).otherwise(0)
    )


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document and selected fingerprint: doc_id, same, print, and the windows (at, size, key) that selected it.

    ``docs`` has doc_id, text and same (a hash of the text). Lines are numbered from 1 over the lines with words.
    """
    lines = F.filter(F.split("text", "\n"), has_words)
    arrays = docs.select("doc_id", "same", lines.alias("lines")).select(
        "doc_id", "same",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("c"),
    )
    size = F.size("h")
    backwards = arrays.filter(size > 0).withColumn("r", F.reverse("c")).select("doc_id", "same", "h", "c", "r")
    opening = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("at"), _reach(F.col("c"), i, min_words).alias("size")))
    closing = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: bind(_reach(F.col("r"), i, min_words), lambda n: F.struct((size - i - n + 2).cast("int").alias("at"), n.alias("size"))),
    )
    stretches = F.array_distinct(F.filter(F.concat(opening, closing), lambda w: w["size"] > 0))
    found = backwards.select("doc_id", "same", "h", F.explode(stretches).alias("w")).select(
        "doc_id", "same", F.slice("h", F.col("w.at"), F.col("w.size")).alias("own"), "w"
    )
    # winnowing: a window is posted under its smallest line hash; the key tells its whole content
    return found.select(
        "doc_id", "same", F.array_min("own").alias("print"), F.col("w.at").alias("at"), F.col("w.size").alias("size"),
        F.struct(F.xxhash64("own").alias("a"), F.hash("own").alias("b")).alias("key"),
    )


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: doc_id, same, gone (numbers over the lines with words, from 1), for documents that have any."""
    posted = windows(docs, min_words)
    spread = posted.groupBy("print", "doc_id", "same").agg(F.collect_list(F.struct("at", "size", "key")).alias("w"))
    posts = stored(spread)
    shared = posts.groupBy("print").agg(F.sum(F.size("w")).alias("n")).filter("n > 1").select("print")
    candidates = stored(posts.join(stored(shared), "print", "left_semi").select("doc_id", "same", F.explode("w").alias("w")).select("doc_id", "same", "w.*"))
    place = F.struct("doc_id", "same", "at", "size")
    firsts = candidates.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    matched = candidates.join(stored(firsts), "key")
    same_doc = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("same") == F.col("first.same"))
    later = matched.filter(~same_doc | (F.col("at") >= F.col("first.at") + F.col("first.size")))
    numbers = later.select("doc_id", "same", F.sequence(F.col("at"), F.col("at") + F.col("size") - 1).alias("n"))
    return numbers.groupBy("doc_id", "same").agg(F.array_distinct(F.flatten(F.collect_set("n"))).alias("gone"))


def _marked(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, str]:
    """``docs`` with a column of the numbers of the lines to delete."""
    table = pick(docs, doc_id=id_col, text=text_col).filter(F.col("text").isNotNull()).withColumn("same", F.xxhash64("text"))
    gone = repeated_lines(table, min_words)
    name, doc, same = fresh(docs, "_gone"), fresh(docs, "_doc"), fresh(docs, "_same")
    gone = stored(gone.select(F.col("doc_id").alias(doc), F.col("same").alias(same), F.col("gone").alias(name)))
    # only documents that may lose lines are shuffled with their texts; the others go straight through
    place, word = fresh(docs, "_place"), fresh(docs, "_word")
    bits = gone.select(F.pmod(F.xxhash64(quoted(doc), quoted(same)), F.lit(FILTER_BITS)).alias("p"))
    bits = bits.select(F.shiftright("p", 6).alias(word), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(place))
    text_hash = F.xxhash64(quoted(text_col))
    at = F.pmod(F.xxhash64(quoted(id_col), text_hash), F.lit(FILTER_BITS))
    sifted = docs.withColumn(fresh(docs, "_at"), at)
    at = quoted(fresh(docs, "_at"))
    sifted = sifted.join(F.broadcast(stored(bits)), F.shiftright(at, 6) == quoted(word), "left")
    hit = F.coalesce(F.getbit(quoted(place), F.pmod(at, F.lit(64)).cast("int")) == 1, F.lit(False))
    columns = [quoted(column) for column in docs.columns]
    match = quoted(id_col).eqNullSafe(quoted(doc)) & (text_hash == quoted(same))
    maybe = sifted.filter(hit).select(*columns).join(gone, match, "left").drop(doc, same)
    rest = sifted.filter(~hit).select(*columns, F.lit(None).cast(gone.schema[name].dataType).alias(name))
    return maybe.union(rest), name


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""
    lines = F.split(text, "\n")

    def rest(all_lines: Column) -> Column:
        everything = F.sequence(F.lit(0), F.size(all_lines) - 1)
        worded = F.filter(everything, lambda p: has_words(F.get(all_lines, p)))
        dropped = bind(worded, lambda w: F.transform(gone, lambda k: F.element_at(w, k)))
        kept = F.array_except(everything, dropped)
        return F.array_join(F.transform(kept, lambda p: F.get(all_lines, p)), "\n")

    return F.when(gone.isNull(), text).otherwise(bind(lines, rest))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with all their columns, their texts without the repeated runs."""
    marked, gone = _marked(docs, id_col, text_col, min_words)
    return marked.select(*[_without(quoted(c), quoted(gone)).alias(c) if c == text_col else quoted(c) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_deleted, n_chars (of the cleaned text), text_md5 (of it, null texts as empty)."""
    table = pick(docs, doc_id=id_col, text=text_col)
    marked, gone = _marked(table, "doc_id", "text", min_words)
    text = F.coalesce(_without(F.col("text"), F.col(gone)), F.lit(""))
    cleaned = marked.select("doc_id", F.col("text").alias("old"), gone, text.alias("new"))
    n_lines = F.when(F.col("old").isNull(), 0).otherwise(F.regexp_count("old", F.lit("\n")) + 1)
    return cleaned.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_deleted"),
        F.length("new").cast("long").alias("n_chars"), F.md5(F.col("new").cast("binary")).alias("text_md5"),
    )


#: The same deletions for unique ids, from whole lines instead of hashes.
LINES_SQL = r"""
WITH every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), worded AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS c FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), summed AS (
  SELECT *, row_number() OVER d AS k, CAST(sum(c) OVER d AS BIGINT) AS upto FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), opening AS (
  SELECT a.doc_id, a.k AS k0, min(b.k) AS last FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 AND b.upto - a.upto + a.c >= 50 GROUP BY ALL
), closing AS (
  SELECT b.doc_id, max(a.k) AS k0, b.k AS last FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 AND b.upto - a.upto + a.c >= 50 GROUP BY ALL
), stretches AS (SELECT * FROM opening UNION SELECT doc_id, k0, last FROM closing
), content AS (
  SELECT w.doc_id, w.k0, w.last, string_agg(s.line, chr(10) ORDER BY s.k) AS body
  FROM stretches w JOIN summed s ON s.doc_id = w.doc_id AND s.k BETWEEN w.k0 AND w.last GROUP BY ALL
), firsts AS (
  SELECT *, first_value(doc_id) OVER f AS doc0, first_value(last) OVER f AS last0 FROM content WINDOW f AS (PARTITION BY body ORDER BY doc_id, k0)
), gone AS (
  SELECT DISTINCT s.doc_id, s.pos FROM firsts w JOIN summed s ON s.doc_id = w.doc_id AND s.k BETWEEN w.k0 AND w.last
  WHERE w.doc_id <> w.doc0 OR w.k0 > w.last0
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (g.pos IS NULL) AS body, count(*) AS n_lines, count(g.pos) AS n_deleted
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted,
  CAST(length(coalesce(k.body, '')) AS BIGINT) AS n_chars, md5(coalesce(k.body, '')) AS text_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
