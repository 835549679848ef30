"""Exact order statistics without ever sorting a whole group in one task.

Values are first counted (map-side combined). A group's value range is then cut
into buckets of equal width on a signed logarithmic scale, which heavy tails
cannot crowd; the bucket holding the wanted rank is found from the bucket counts,
and its range is cut again into equal widths. Only the values of the last, tiny
range are ordered in a window, so one group may hold any share of the rows.

bigint values are compared and returned as bigint, all others as double; the
scales only choose buckets, and being monotone they cannot change a rank.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
#: Up to this many groups the ranges are broadcast.
FEW_GROUPS = 10_000
#: Fixed bounds of the logarithmic scale: finite doubles lie within +-SCALE_END.
_LOG_SHIFT, _SCALE_END, _SCALE_NAN = 1100.0, 2200.0, 2300.0

RankRule = Callable[[Column], Column]


def nearest_rank(q: float) -> RankRule:
    """0-based rank nearest to ``(n - 1) * q``, halves upward."""
    return lambda n: F.floor((n - 1) * F.lit(float(q)) + F.lit(0.5))


def higher_rank(q: float) -> RankRule:
    """0-based rank at or above ``(n - 1) * q``."""
    return lambda n: F.ceil((n - 1) * F.lit(float(q)))


def index_rank(q: float) -> RankRule:
    """``int(n * q) - 1`` clipped into the group."""
    return lambda n: F.greatest(F.lit(0), F.least(n - 1, F.floor(n * F.lit(float(q))) - 1))


LOWER_MIDDLE: RankRule = lambda n: F.floor((n - 1) / F.lit(2))
UPPER_MIDDLE: RankRule = lambda n: F.ceil((n - 1) / F.lit(2))


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, RankRule], *, few_groups: bool = False
) -> DataFrame:
    """One row per group with ``n`` and the value at each named 0-based rank.

    Null values are ignored; groups without values do not appear. The ranges of
    up to ``FEW_GROUPS`` groups are broadcast, so that counted values need not move
    by group and a large group never meets in one task; ``few_groups`` says that
    they are known to be few (such as one per column) and need not be counted.
    """
    if not by:
        whole = order_statistics(df.withColumn("_g", F.lit(0)), ["_g"], value, ranks, few_groups=True)
        return whole.drop("_g")
    by = list(by)
    few_groups = few_groups or df.select(*by).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    counted = (
        df.select(*by, F.col(value).cast(_kind(df, value)).alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    spans = counted.groupBy(*by).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n")
    )
    targets = spans.select(
        *by,
        "n",
        "_lo",
        "_hi",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("_stat"), rule(F.col("n")).cast("bigint").alias("_k"))
                    for name, rule in ranks.items()
                ]
            )
        ).alias("_t"),
    ).select(*by, "n", "_lo", "_hi", "_t.*")

    for scale in (_signed_log, _plain):
        targets = _narrow(counted, targets, by, few_groups, scale)

    order = Window.partitionBy(*by, "_stat").orderBy("_v")
    picked = (
        _within(counted, targets, by, few_groups)
        .withColumn("_cum", F.sum("_c").over(order))
        .filter((F.col("_cum") > F.col("_k")) & (F.col("_cum") - F.col("_c") <= F.col("_k")))
    )
    return picked.groupBy(*by).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("_stat") == name, F.col("_v"))).alias(name) for name in ranks],
    )


def _kind(df: DataFrame, value: str) -> str:
    kind = df.select(F.col(value).alias("_v")).schema["_v"].dataType.simpleString()
    return "bigint" if kind == "bigint" else "double"


def _plain(value: Column) -> Column:
    return value.cast("double")


def _signed_log(value: Column) -> Column:
    """A monotone scale from -SCALE_END to SCALE_END; NaN is the greatest, as in an ordering."""
    x = value.cast("double")
    size = F.least(F.log2(F.abs(x)) + _LOG_SHIFT, F.lit(_SCALE_END))
    return F.when(F.isnan(x), _SCALE_NAN).when(x == 0, 0.0).otherwise(F.signum(x) * size)


def _within(counted: DataFrame, targets: DataFrame, by: Sequence[str], few_groups: bool) -> DataFrame:
    """Counted values inside each target's current range (one target per group and statistic)."""
    if few_groups:
        targets = F.broadcast(targets)
    return counted.join(targets, list(by)).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrow(
    counted: DataFrame, targets: DataFrame, by: Sequence[str], few_groups: bool, scale: Callable[[Column], Column]
) -> DataFrame:
    low = scale(F.col("_lo"))
    width = (scale(F.col("_hi")) - low) / BUCKETS
    slot = F.when(width > 0, F.least(F.floor((scale(F.col("_v")) - low) / width), F.lit(BUCKETS - 1)))
    buckets = (
        _within(counted, targets, by, few_groups)
        .withColumn("_b", F.coalesce(slot, F.lit(0)))
        .groupBy(*by, "_stat", "n", "_k", "_b")
        .agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    running = F.sum("_c").over(Window.partitionBy(*by, "_stat").orderBy("_b"))
    return (
        buckets.withColumn("_cum", running)
        .filter((F.col("_cum") > F.col("_k")) & (F.col("_cum") - F.col("_c") <= F.col("_k")))
        .select(
            *by, "n", "_lo", "_hi", "_stat", (F.col("_k") - F.col("_cum") + F.col("_c")).alias("_k")
        )
    )
