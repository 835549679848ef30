"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import work_folder

#: A word is a longest run of characters other than these blanks (space, tab, line breaks).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Rows with texts that a Python worker receives at a time.
BATCH_ROWS = 1_000
#: Bits of a filter over keys: at most 4 MB of words wherever it goes.
FILTER_BITS = 1 << 24


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet (names are compared without case)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names; other columns can no longer clash."""
    return df.select(*[quoted(old).alias(new) for new, old in columns.items()])


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def long(value) -> Column:
    return F.lit(value).cast("long") if isinstance(value, int) else value.cast("long")


def stored(df: DataFrame, *replaced: DataFrame | None) -> DataFrame:
    """The rows of ``df`` written as Parquet into the shared folder and read again: lineage is cut, and lost executors
    lose nothing.

    ``replaced`` are stored frames that nothing reads any more; their files are deleted once the new ones exist.
    """
    spark = df.sparkSession
    path = work_folder(spark, "step")
    df.write.parquet(path)
    for old in replaced:
        if old is not None and getattr(old, "stored_at", None):
            where = spark._jvm.org.apache.hadoop.fs.Path(old.stored_at)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    again = spark.read.schema(df.schema).parquet(path)
    again.stored_at = path
    return again


def empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def _bits(keys: DataFrame) -> DataFrame:
    """A filter of fixed size over the columns of ``keys``: (word, bits) for each word with a bit set."""
    at = keys.select(F.pmod(F.xxhash64(*keys.columns), F.lit(FILTER_BITS)).alias("p"))
    at = at.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bit"))
    return stored(at.groupBy("word").agg(F.bit_or("bit").alias("bits")))


def _sifted(df: DataFrame, key: tuple[Column, ...], bits: DataFrame, flag: str) -> DataFrame:
    """``df`` with a column ``flag``: whether the filter may hold the row's key (it never misses one that it holds)."""
    at, word, found = fresh(df, "_at"), fresh(df, "_word"), fresh(df, "_bits")
    columns = [quoted(c) for c in df.columns]
    place = df.withColumn(at, F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS)))
    place = place.join(F.broadcast(bits.toDF(word, found)), F.shiftright(quoted(at), 6) == quoted(word), "left")
    hit = F.getbit(quoted(found), F.pmod(quoted(at), F.lit(64)).cast("int")) == 1
    return place.select(*columns, F.coalesce(hit, F.lit(False)).alias(flag))


def sifted(df: DataFrame, key: tuple[Column, ...], listed: DataFrame, flag: str) -> DataFrame:
    """``df`` with a column ``flag``: whether its key may be a row of ``listed`` (never false for one that is; nulls equal nulls)."""
    return _sifted(df, key, _bits(listed), flag)


def among(df: DataFrame, key: tuple[Column, ...], listed: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is a row of ``listed``. Rows that a filter of fixed size leaves out are not shuffled."""
    held = fresh(df, "_held")
    names = [fresh(df, f"_key{i}_") for i in range(len(key))]
    match = _all([k.eqNullSafe(quoted(name)) for k, name in zip(key, names, strict=True)])
    maybe = sifted(df, key, listed, held).filter(quoted(held)).select(*[quoted(c) for c in df.columns])
    return maybe.join(listed.toDF(*names), match, "left_semi")


def without(df: DataFrame, key: tuple[Column, ...], gone: DataFrame, every: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is not a row of ``gone``; nulls equal nulls. ``every`` holds the keys of all rows.

    A filter over ``gone`` lets rows outside of it through at once. The other keys that it wrongly holds are found on ``every``,
    which is narrow, and make a second filter: what only the first one holds is surely gone. Whole rows are shuffled only if both
    filters hold them, a few in a hundred, unless there are so many keys that the filters are full.
    """
    one, two = fresh(df, "_first"), fresh(df, "_second")
    first = _bits(gone)
    names = [fresh(df, f"_key{i}_") for i in range(len(key))]
    listed = gone.toDF(*names)
    held = _sifted(every, tuple(quoted(c) for c in every.columns), first, "_held").filter("_held").drop("_held")
    same = [quoted(a).eqNullSafe(quoted(b)) for a, b in zip(every.columns, names, strict=True)]
    second = _bits(stored(held.join(listed, _all(same), "left_anti")))
    columns = [quoted(c) for c in df.columns]
    sifted = _sifted(_sifted(df, key, first, one), key, second, two)
    clear = sifted.filter(~quoted(one)).select(*columns)
    doubtful = sifted.filter(quoted(one) & quoted(two)).select(*columns)
    match = [k.eqNullSafe(quoted(b)) for k, b in zip(key, names, strict=True)]
    return clear.union(doubtful.join(listed, _all(match), "left_anti"))


def unique(df: DataFrame, key: tuple[Column, ...], repeated: DataFrame) -> DataFrame:
    """``df`` with one row of each key of ``repeated`` (the one with the smallest hash of its columns), other rows as they are."""
    if empty(repeated):
        return df
    names = [fresh(df, f"_key{i}_") for i in range(len(key))]
    listed = repeated.toDF(*names)
    match = _all([k.eqNullSafe(quoted(b)) for k, b in zip(key, names, strict=True)])
    columns = [quoted(c) for c in df.columns]
    row, whole, held = F.struct(*columns), fresh(df, "_row"), fresh(df, "_held")
    sifted = _sifted(df, key, _bits(repeated), held)
    clear, maybe = sifted.filter(~quoted(held)).select(*columns), sifted.filter(held).select(*columns)
    # combined within each task first, so a row that fills the table is no large group
    some = maybe.join(listed, match, "left_semi").groupBy(*[k.alias(n) for k, n in zip(key, names, strict=True)])
    chosen = some.agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(whole)).select(f"{whole}.*")
    return clear.union(maybe.join(listed, match, "left_anti")).union(chosen)


def _all(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most ``rows`` rows from now on in this session (left alone where they are smaller already).

    A batch stands several times in a Python worker and once beside the heap of the executor; Spark's 10,000 rows of long
    texts are tens of megabytes each time.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def some_at_a_time(texts: Iterable[str | None], characters: int) -> Iterator[list[str | None]]:
    """The texts in lists of at most so many characters (or one longer text)."""
    taken: list[str | None] = []
    size = 0
    for text in texts:
        if taken and size + len(text or "") > characters:
            yield taken
            taken, size = [], 0
        taken.append(text)
        size += len(text or "")
    if taken:
        yield taken


_kept: dict = {}


def remembered(key, make):
    """What a Python worker keeps from task to task under ``key``, made on first use.

    A worker keeps the memory of one operator at a time: workers outlive stages, and the memories of all stages together
    would stand in the way of the later ones.
    """
    if key not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]
