"""Near-duplicate texts by an inverted join over MinHash coordinates.

The text's set of word shingles is hashed to ``COORDINATES`` minima. A *posting* is a pair (coordinate, value); two sets of
Jaccard similarity s share a posting with probability s per coordinate. Pairs that share at least ``MATCHES`` postings are
candidates; at s = 0.8 a pair misses that with a probability of about 3 in 100,000.

* *Prefix*: every document is posted only under its ``COORDINATES - MATCHES + 1`` rarest postings. Two documents with enough
  common postings share one of those, and postings that many unlike documents share (a licence line, a common passage) are
  seldom among them. A value is a 32-bit hash of the whole 64-bit minimum: the upper bits of minima alone crowd near zero, and among
  some hundred thousand documents most would share one by chance.
* *Skip*: the longer lists are never merged. Whether a pair has enough matches is counted on the two signatures.
* Copies (equal sets) are one class with one signature from the start.
* In a list that many documents share, pairs are not spelled out. A pivot of the list (the document whose postings are most
  shared) is compared with the documents that are not connected with it yet, for ``ROUNDS`` rounds with different pivots; what is then still unconnected inside a list is
  compared in full, block by block. Links found join components, so a group of alike texts needs about as many comparisons as it
  has members.

Every candidate is confirmed on the full sets (64-bit hashes of all shingles). Result and work do not depend on pairs inside
components that are known, so no link between different components is lost.

Null texts and texts without words have an empty set and link with nothing. Texts with fewer words than a shingle have the whole
sequence as their only one. Classes are known by their content, not by an id: rows that share an id but not a text are compared each
with its own text and then joined as one document. A row with a null id links like any other; its component has the smallest id that is
reachable, or null if there is none (then ``kept`` is true). ``keep_one`` goes by texts alone: of every group of rows exactly one
stays, also of repeated rows and of rows without an id, while different texts under one id are different documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.frames import among, empty, pick, quoted, small_batches, stored, unique, without

COORDINATES = 48
MATCHES = 27
ROUNDS = 2
#: Documents of one block in the full comparison.
BLOCK = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    length = min(words, len(found))
    combined = np.zeros(len(found) - length + 1, np.uint64)
    for offset in range(length):
        combined = _mixed(combined * _ODD + hashes[offset : offset + len(combined)] + np.uint64(length))
    return np.unique(combined)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = _mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * _ODD)
    return draw[:count] | np.uint64(1), draw[count:]


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Minima of as many hash functions, each hashed to a 32-bit integer."""
    factor, shift = _factors(coordinates)
    lowest = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):  # a cache-sized piece at a time
        part = shingles[start : start + 2048, None] * factor + shift
        np.minimum(lowest, part.min(axis=0), out=lowest)
    return (_mixed(lowest) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(words: int, coordinates: int):
    @F.pandas_udf("n long, same string, sig array<int>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                shingles = shingle_set(text, words)
                some = len(shingles)
                rows.append((some, hashlib.md5(shingles.tobytes()).hexdigest() if some else None, signature(shingles, coordinates) if some else None))
            yield pd.DataFrame(rows, columns=["n", "same", "sig"])

    return sign


def _sets(words: int):
    @F.pandas_udf("binary")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(text, words).tobytes() for text in texts], dtype=object)

    return sets


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    common = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(percent: int):
    """Keeps the pairs whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
            # read where they lie: a batch holds two full sets a row
            keep = [_similar(np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64), percent) for left, right in sets]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def matches(a: Column, b: Column) -> Column:
    """Coordinates on which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def postings(classes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """(token, rep, weight) for the rarest postings of every class that are shared at all.

    ``weight`` is how many classes stand in the lists of all its postings: the original of many altered copies, whose
    postings they mostly share, has more of it than any copy.
    """
    tokens = classes.select("rep", F.posexplode("sig").alias("at", "value")).select(
        "rep", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long")).alias("token")
    )
    shared = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    lists = tokens.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    # postings that no other class has are the rarest and fill the prefix first
    left = coordinates - least + 1 - (coordinates - F.size("t"))
    weight = F.aggregate("t", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    prefix = lists.filter(left > 0).select("rep", weight.alias("weight"), F.explode(F.slice("t", 1, left)).alias("t"))
    return prefix.select("rep", "weight", F.col("t.token").alias("token"))


def _compare(percent: int, least: int):
    """Links between two blocks of a family, enough to join what is linked; pairs already joined are skipped."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        sig_a, sig_b = np.array(left["sig"].to_list()), np.array(right["sig"].to_list())
        n_a, n_b = left["n"].to_numpy(np.int64), right["n"].to_numpy(np.int64)
        sets_a = [np.frombuffer(x, np.uint64) for x in left["set"]]
        sets_b = [np.frombuffer(x, np.uint64) for x in right["set"]]
        ids_a, ids_b, c_a, c_b = left["rep"].to_numpy(), right["rep"].to_numpy(), left["c"].to_numpy(), right["c"].to_numpy()
        group = {int(c): int(c) for c in np.concatenate([c_a, c_b])}

        def top(c: int) -> int:
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        links = []
        for i in range(len(left)):
            alike = 100 * np.minimum(n_a[i], n_b) >= percent * np.maximum(n_a[i], n_b)
            likely = np.flatnonzero(alike & (c_b != c_a[i]) & ((sig_b == sig_a[i]).sum(axis=1) >= least))
            for j in likely:
                one, other = top(int(c_a[i])), top(int(c_b[j]))
                if one != other and _similar(sets_a[i], sets_b[j], percent):
                    links.append((ids_a[i], ids_b[j]))
                    group[max(one, other)] = min(one, other)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return compare


def _rest(placed: DataFrame, lists: DataFrame, known: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Links between the components that still share a list, by full comparison in blocks.

    Documents joined by open lists form a family. Its members are dealt into chunks of about ``BLOCK``; each pair of chunks is
    one task, which compares signatures, then full sets, and lets out only links between different components.
    """
    stars = placed.join(lists.select("token", "first"), "token").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    family = components(stars).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    rows = family.join(placed.select("rep", "c").distinct(), "rep").join(known.select("rep", "n", "sig"), "rep")
    rows = rows.join(sets, "rep")
    sizes = stored(family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / float(BLOCK)).cast("int").alias("chunks")))
    dealt = stored(rows.join(sizes, "family").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(4)), F.col("chunks")).cast("int")))
    columns = ["family", "rep", "c", "n", "sig", "set"]
    left = dealt.select(*columns, F.col("chunk").alias("i"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("j"))
    right = dealt.select(*columns, F.col("chunk").alias("j"), F.explode(F.sequence(F.lit(0), F.col("chunk"))).alias("i"))
    right, by = right.toDF(*right.columns), ("family", "i", "j")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_compare(percent, least), "a long, b long")


def _groups(table: DataFrame, words: int, percent: int, coordinates: int, least: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Every row of ``table`` (doc_id, text) as (doc_id, text_key, n, same), and every class as (same, rep, doc, group).

    ``doc`` is the smallest id of a class (null if no row of it has one); classes that links connect have the same ``group``.
    """
    keyed = table.select("doc_id", F.xxhash64("text").alias("text_key"), _signed(words, coordinates)("text").alias("s"))
    signed = stored(keyed.select("doc_id", "text_key", "s.*"))
    classes = signed.filter("n > 0").groupBy("same").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # numbers given when the table is written hold from then on
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()))
    prefix = stored(postings(classes, coordinates, least))
    several = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token")
    posted = stored(prefix.join(several, "token", "left_semi"), prefix)
    reps = stored(posted.select("rep").distinct())
    known = stored(classes.join(reps, "rep", "left_semi").select("rep", "n", "sig", "same", "doc"))
    # full sets of the classes that stand in any list, from one of their documents
    wanted = known.select("rep", F.col("same").alias("own"))
    texts = among(table, (F.col("doc_id"),), known.filter("doc is not null").select("doc").distinct())
    if not empty(known.filter("doc is null")):
        texts = texts.union(table.filter("doc_id is null"))
    sets = texts.select(_sets(words)("text").alias("set")).filter(F.length("set") > 0).withColumn("own", F.md5("set"))
    sets = stored(sets.join(wanted, "own").groupBy("rep").agg(F.first("set").alias("set")))

    def candidates(pairs: DataFrame) -> DataFrame:
        """Distinct pairs of like size with enough matching coordinates."""
        a = known.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        b = known.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        joined = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(a, "a").join(b, "b")
        alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        return joined.filter(alike & (matches(F.col("sig_a"), F.col("sig_b")) >= least)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
        b = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")

    # every class starts as its own component; confirmed links join components
    state = stored(reps.select("rep", F.col("rep").alias("c")))
    for turn in range(rounds + 1):
        placed = posted.join(state, "rep")
        # the pivot is the document most like the others; later ones come from an eighth drawn anew
        lot = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(8 if turn else 1))
        lists = placed.groupBy("token").agg(
            F.min(F.struct(lot, -F.col("weight"), "rep", "c")).alias("p"),
            F.min("c").alias("low"), F.max("c").alias("high"), F.min("rep").alias("first"),
        )
        lists = stored(lists.filter("low <> high").select("token", "first", F.col("p.rep").alias("b"), F.col("p.c").alias("c_b")))
        if empty(lists):
            break
        if turn < rounds:
            pairs = placed.join(lists, "token").filter(F.col("c") != F.col("c_b")).select(F.col("rep").alias("a"), "b")
            found = stored(candidates(pairs))
            if empty(found):
                continue
            new = confirmed(found)
        else:
            new = _rest(placed, lists, known, sets, percent, least)
        left, right = state.select(F.col("rep").alias("a"), F.col("c").alias("c_a")), state.select(F.col("rep").alias("b"), F.col("c").alias("c_b"))
        joined = new.join(left, "a").join(right, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        merged = components(joined).withColumnRenamed("node", "c")
        state = stored(state.join(merged, "c", "left").select("rep", F.coalesce("component", "c").alias("c")))
    named = classes.select("same", "rep", "doc").join(state, "rep", "left")
    return signed, stored(named.select("same", "rep", "doc", F.coalesce("c", "rep").alias("group")))


def _joined_by_id(signed: DataFrame, named: DataFrame) -> DataFrame:
    """``named`` with the groups of different texts under one id joined."""
    ids = signed.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high"))
    ids = stored(ids.filter("low <> high").select("doc_id"))
    if empty(ids):
        return named
    texts = signed.filter("n > 0").join(ids, "doc_id").select("doc_id", "same").distinct().join(named, "same").select("doc_id", "group")
    texts = stored(texts.distinct())
    first = texts.groupBy("doc_id").agg(F.min("group").alias("b"))
    merged = components(texts.join(first, "doc_id").select(F.col("group").alias("a"), "b")).withColumnRenamed("node", "group")
    return stored(named.join(merged, "group", "left").select("same", "rep", "doc", F.coalesce("component", "group").alias("group")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    coordinates: int = COORDINATES, least: int = MATCHES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    small_batches(docs.sparkSession)
    signed, named = _groups(pick(docs, doc_id=id_col, text=text_col), words, percent, coordinates, least, rounds)
    named = _joined_by_id(signed, named)
    smallest = named.groupBy("group").agg(F.min("doc").alias("_component"))
    named = stored(named.join(smallest, "group").select(F.col("same").alias("_same"), "_component"))
    rows = signed.join(named, signed["same"] == named["_same"], "left")
    component = F.coalesce("_component", "doc_id")
    result = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all columns: of the smallest id, nulls last. Rows without words all stay."""
    small_batches(docs.sparkSession)
    signed, named = _groups(pick(docs, doc_id=id_col, text=text_col), words, percent, COORDINATES, MATCHES, ROUNDS)
    rows = signed.join(named.select("same", "group"), "same").select("group", "doc_id", "text_key")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    places = stored(rows.groupBy("group", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times")))
    firsts = places.groupBy("group").agg(F.min(place).alias("first"), F.sum("times").alias("n")).filter("n > 1")
    joined = stored(places.join(firsts, "group").select("doc_id", "text_key", "times", (place == F.col("first")).alias("stays")), places)
    key = (quoted(id_col), F.xxhash64(quoted(text_col)))
    rest = without(docs, key, joined.filter("not stays").select("doc_id", "text_key"), signed.select("doc_id", "text_key"))
    return unique(rest, key, joined.filter("stays and times > 1").select("doc_id", "text_key"))
