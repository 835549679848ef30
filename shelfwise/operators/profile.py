"""Column profiles of a catalog: numeric, text and categorical coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.order_stats import (
    LOWER_MIDDLE,
    UPPER_MIDDLE,
    higher_rank,
    index_rank,
    order_statistics,
)

# Fixed value: a metadata fetch at or above this many milliseconds is slow.
SLOW_MS = 2000


def _long(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    """(column, value) rows of the chosen columns."""
    pairs = [
        F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").cast(as_type).alias("value")) for name in columns
    ]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def _complete(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column even when there are no rows to profile: all zeros."""
    listed = F.explode(F.array(*[F.lit(name) for name in columns]))
    wanted = profile.sparkSession.range(1).select(listed.alias("column"))
    zeros = {name: F.coalesce(name, F.lit(0).cast(kind)) for name, kind in profile.dtypes if name != "column"}
    return wanted.join(profile, "column", "left").withColumns(zeros)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: value count and linear-interpolation median."""
    stats = order_statistics(
        _long(df, columns, "double"), ["column"], "value", {"_lower": LOWER_MIDDLE, "_upper": UPPER_MIDDLE}, few_groups=True
    )
    return stats.select("column", "n", ((F.col("_lower") + F.col("_upper")) / 2).alias("median"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null count, coverage, minimum, maximum, median and population deviation."""
    basics = (
        _long(df, columns, "double")
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count("value").alias("non_null"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.stddev_pop("value").alias("std"),
        )
    )
    profile = basics.join(medians(df, columns).select("column", "median"), "column", "left").select(
        "column",
        "non_null",
        (F.col("non_null") / F.col("_rows")).alias("coverage"),
        "min",
        "max",
        "median",
        "std",
    )
    return _complete(profile, columns)


def text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trimmed length: non-empty count, coverage, mean and 95th percentile (higher)."""
    lengths = _long(df, columns, "string").select(
        "column", F.length(F.regexp_replace(F.coalesce("value", F.lit("")), r"(?U)^\s+|\s+$", "")).alias("length")
    )
    basics = lengths.groupBy("column").agg(
        F.count_if(F.col("length") > 0).alias("non_empty"),
        (F.count_if(F.col("length") > 0) / F.count(F.lit(1))).alias("coverage"),
        F.avg("length").alias("avg_length"),
    )
    tail = order_statistics(lengths, ["column"], "length", {"p95_length": higher_rank(0.95)}, few_groups=True)
    return _complete(basics.join(tail.select("column", "p95_length"), "column", "left"), columns)


def categorical_profile(df: DataFrame, columns: Sequence[str], *, approximate: bool = False) -> DataFrame:
    """Trimmed non-empty count, coverage and number of distinct non-empty values."""
    values = _long(df, columns, "string").select("column", F.trim(F.coalesce("value", F.lit(""))).alias("value"))
    filled = F.when(F.col("value") != "", F.col("value"))
    distinct = F.approx_count_distinct(filled) if approximate else F.count_distinct(filled)
    profile = values.groupBy("column").agg(
        F.count(filled).alias("non_empty"),
        (F.count(filled) / F.count(F.lit(1))).alias("coverage"),
        distinct.alias("distinct"),
    )
    return _complete(profile, columns)


def latency_summary(df: DataFrame, by: Sequence[str], millis: str, *, slow_ms: float = SLOW_MS) -> DataFrame:
    """Per batch: number of fetches, slow ones, 95th percentile by index, maximum."""
    basics = df.groupBy(*by).agg(
        F.count(millis).alias("total"),
        F.count_if(F.col(millis) >= slow_ms).alias("slow"),
        F.max(millis).alias("max_ms"),
    )
    tail = order_statistics(df, by, millis, {"p95_ms": index_rank(0.95)})
    return basics.join(tail.select(*by, "p95_ms"), list(by), "left")
