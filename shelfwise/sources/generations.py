"""Tables that are replaced as a whole, and together: readers see the old ones or the new ones, never a mix.

A load writes all its tables into the folder of a new generation and, when they are complete, one pointer row. The newest
pointer names the generation that readers open; they hold on to it while later ones are loaded. A load that fails leaves no
pointer, so it changes nothing, and the next one takes a new number. :func:`vacuum` removes old and failed generations. One writer
at a time; any number of readers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.stores import exists


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Generations with files, complete or not, in order."""
    if not exists(spark, f"{root}/data"):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    names = [status.getPath().getName() for status in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return sorted(int(name[1]) for name in map(re.compile(r"generation-(\d+)").fullmatch, names) if name)


def pointers(spark: SparkSession, root: str) -> DataFrame | None:
    """All loads that were completed: generation, tables, n_rows (of all tables), loaded_at."""
    return spark.read.parquet(f"{root}/pointers") if exists(spark, f"{root}/pointers/_SUCCESS") else None


def newest(spark: SparkSession, root: str) -> int | None:
    """The generation that readers open; None before the first load."""
    rows = pointers(spark, root)
    return None if rows is None else rows.agg(F.max("generation")).first()[0]


def replace(
    spark: SparkSession, root: str, tables: Mapping[str, DataFrame], *, check: Callable[[Mapping[str, DataFrame]], str | None] | None = None
) -> int:
    """Load all tables as a new generation and point readers to it; the number of the generation.

    ``check`` looks at the tables as they were written, and names what is wrong with them, if anything; then the old ones stay.
    """
    number = max([*_numbers(spark, root), newest(spark, root) or 0], default=0) + 1
    folder = f"{root}/data/generation-{number}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    written = {name: spark.read.schema(table.schema).parquet(f"{folder}/{name}") for name, table in tables.items()}
    problem = check(written) if check is not None else None
    if problem:
        raise ValueError(f"generation {number} is not published: {problem}")
    rows = None
    for name, table in written.items():
        count = table.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        rows = count if rows is None else rows.unionByName(count)
    pointer = rows.agg(
        F.lit(number).alias("generation"), F.array_sort(F.collect_list("name")).alias("tables"), F.sum("n").alias("n_rows"), F.current_timestamp().alias("loaded_at")
    )
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return number


def read(spark: SparkSession, root: str, *names: str, generation: int | None = None) -> dict[str, DataFrame]:
    """The named tables of one generation (the newest, if none is given)."""
    number = newest(spark, root) if generation is None else generation
    if number is None:
        raise FileNotFoundError(f"nothing was loaded at {root}")
    return {name: spark.read.parquet(f"{root}/data/generation-{number}/{name}") for name in names}


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove all generations but the newest ``keep`` completed ones, and failed loads; the numbers of what went.

    Readers of a removed generation fail, so ``keep`` should cover the time that the longest reader takes. Not to be run
    during a load.
    """
    rows = pointers(spark, root)
    kept = [] if rows is None else [row[0] for row in rows.select("generation").distinct().orderBy(F.desc("generation")).limit(keep).collect()]
    gone = [number for number in _numbers(spark, root) if number not in kept]
    for number in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/generation-{number}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone
