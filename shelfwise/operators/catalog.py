"""Catalog building: tag tables, enrichment, filters, record normalization, checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import CatalogFilters
from shelfwise.functions import numbers as N
from shelfwise.functions import text as T
from shelfwise.operators.order_stats import nearest_rank, order_statistics

# Bounds of a catalog record and the readiness threshold.
MIN_CATALOG_ROWS = 1000
MAX_COMPLEXITY = 5.0
MAX_RATING = 10.0
PLACEHOLDER_IMAGE = "https://example.com/placeholder.jpg"


# ---- tags -----------------------------------------------------------------


def collapse_flags(
    df: DataFrame,
    output: str,
    *,
    key: str = "item_id",
    flags: Sequence[str] | None = None,
    strip_prefix: str = "",
) -> DataFrame:
    """Wide 0/1 flags to one sorted, ``", "``-joined tag string per key.

    Flags are counted per key first (map-side combined), so repeated rows of a
    key never travel; a tag set in several rows of a key repeats in the result.
    """
    flags = [name for name in df.columns if name != key] if flags is None else list(flags)
    if not flags:
        return df.select(key, F.lit(None).cast("string").alias(output)).limit(0)
    tags = sorted((name.removeprefix(strip_prefix), name) for name in flags)
    counts = df.groupBy(key).agg(
        *[F.count_if(F.col(f"`{name}`") > 0).alias(f"_f{at}") for at, (_, name) in enumerate(tags)]
    )
    listed = F.flatten(
        F.array(
            *[
                F.array_repeat(F.lit(tag), F.col(f"_f{at}").cast("int"))
                for at, (tag, _) in enumerate(tags)
            ]
        )
    )
    return (
        counts.select(key, listed.alias("_tags"))
        .filter(F.size("_tags") > 0)
        .select(key, F.array_join("_tags", ", ").alias(output))
    )


def collapse_categories(items: DataFrame, *, key: str = "item_id", prefix: str = "cat_") -> DataFrame:
    """Collapse the category flag columns of an item table into ``categories``."""
    flags = [name for name in items.columns if name.startswith(prefix)]
    return collapse_flags(items.select(key, *flags), "categories", key=key, flags=flags, strip_prefix=prefix)


def playing_time() -> Column:
    """Best known playing time: community maximum, community minimum, manufacturer."""
    return F.coalesce("community_max_playtime", "community_min_playtime", "mfg_playtime")


def merge_categories(left: str = "categories", right: str = "subcategories") -> Column:
    """Both lists joined by ``", "``, nulls skipped."""
    return F.concat_ws(", ", left, right)


def enrich(items: DataFrame, *tag_tables: DataFrame, key: str = "item_id") -> DataFrame:
    """Left-join tag tables onto the items and merge the category lists.

    Every join uses the same key, so the item side is shuffled at most once.
    """
    base = items.drop(*[name for name in items.columns if name.startswith("cat_")])
    joined = reduce(lambda df, tags: df.join(tags, key, "left"), tag_tables, base)
    joined = joined.withColumn("playing_time_minutes", playing_time())
    if {"categories", "subcategories"} <= set(joined.columns):
        joined = joined.withColumn("categories", merge_categories())
    return joined


# ---- filters --------------------------------------------------------------


@dataclass(frozen=True)
class FilterStep:
    name: str
    value: float
    keep: Column
    threshold: float | None = None
    override: Column | None = None
    owned_threshold: float | None = None


def _quantile(df: DataFrame, column: str, q: float) -> float:
    """Nearest quantile with null counted as 0; 0 on no rows. A single number."""
    filled = df.select(F.coalesce(F.col(column), F.lit(0)).alias("x"))
    row = order_statistics(filled, [], "x", {"t": nearest_rank(q)}).select("t").first()
    return row["t"] if row is not None else 0.0


def filter_steps(df: DataFrame, filters: CatalogFilters) -> list[FilterStep]:
    """The catalog filters in order.

    A quantile threshold depends on the rows kept before it, so each is computed
    here, as a number the scan can filter by.
    """
    steps: list[FilterStep] = []
    current = df

    def add(step: FilterStep) -> None:
        nonlocal current
        steps.append(step)
        current = current.filter(step.keep)

    if filters.max_year is not None:
        year = F.col("year_published")
        add(FilterStep("max_year", filters.max_year, year.isNull() | (year <= filters.max_year)))
    ratings = F.coalesce(F.col("num_user_ratings"), F.lit(0))
    if filters.min_popularity_quantile > 0:
        cut = _quantile(current, "num_user_ratings", filters.min_popularity_quantile)
        add(FilterStep("min_popularity_quantile", filters.min_popularity_quantile, ratings >= cut, cut))
    if filters.min_avg_rating:
        overrides, owned_cut = [], None
        if filters.override_min_ratings > 0:
            overrides.append(ratings >= filters.override_min_ratings)
        if filters.override_owned_quantile > 0:
            owned_cut = _quantile(current, "num_owned", filters.override_owned_quantile)
            overrides.append(F.coalesce(F.col("num_owned"), F.lit(0)) >= owned_cut)
        override = reduce(lambda a, b: a | b, overrides) if overrides else None
        keep = F.coalesce(F.col("avg_rating") >= filters.min_avg_rating, F.lit(False))
        if override is not None:
            keep = keep | override
        add(FilterStep("min_avg_rating", filters.min_avg_rating, keep, None, override, owned_cut))
    for name, column, bound in (
        ("max_required_players", "min_players", filters.max_required_players),
        ("max_playing_time_minutes", "playing_time_minutes", filters.max_playing_time),
    ):
        add(FilterStep(name, bound, F.col(column).isNull() | (F.col(column) <= bound)))
    return steps


def apply_filters(df: DataFrame, filters: CatalogFilters) -> DataFrame:
    for step in filter_steps(df, filters):
        df = df.filter(step.keep)
    return df


def filter_report(df: DataFrame, filters: CatalogFilters) -> DataFrame:
    """Rows before and after every filter step, from a single pass over the items."""
    steps = filter_steps(df, filters)
    kept = F.lit(True)
    flags, totals, rows = [], [F.count(F.lit(1)).alias("_n0")], []
    for at, step in enumerate(steps, start=1):
        flags.append(F.coalesce(step.keep, F.lit(False)).alias(f"_s{at}"))
        before = kept
        kept = kept & F.col(f"_s{at}")
        totals.append(F.count_if(kept).alias(f"_n{at}"))
        by_override = F.lit(None).cast("bigint")
        if step.override is not None:
            rescued = (F.col("avg_rating") < step.value) & step.override
            flags.append(F.coalesce(rescued, F.lit(False)).alias("_rescued"))
            totals.append(F.count_if(before & F.col("_rescued")).alias("_kept_by_override"))
            by_override = F.col("_kept_by_override")
        n_before, n_after = F.col(f"_n{at - 1}"), F.col(f"_n{at}")
        rows.append(
            F.struct(
                F.lit(at).alias("step"),
                F.lit(step.name).alias("name"),
                F.lit(float(step.value)).alias("value"),
                F.lit(step.threshold).cast("double").alias("threshold"),
                n_before.alias("before_rows"),
                n_after.alias("after_rows"),
                (n_before - n_after).alias("removed"),
                F.when(n_before > 0, (n_before - n_after) / n_before).otherwise(0.0).alias("removal_rate"),
                by_override.alias("kept_by_override"),
                F.lit(step.owned_threshold).cast("double").alias("owned_threshold"),
            )
        )
    return df.select(*flags).agg(*totals).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---- record normalization ---------------------------------------------------


def normalize_records(df: DataFrame, *, item_url_prefix: str = "https://example.com/items/") -> DataFrame:
    """Feature-table rows to catalog records, with a ``reject_reason`` per bad row.

    A required column that is present but null (or not a number) rejects the
    row; an absent one takes its default. Out-of-range values are clamped.
    """
    types = dict(df.dtypes)

    def have(name: str) -> bool:
        return name in types

    def required_int(name: str) -> Column:
        return N.safe_int(F.col(name), types[name] == "string") if have(name) else F.lit(1).cast("bigint")

    def tags(name: str) -> Column:
        if not have(name):
            return F.array().cast("array<string>")
        parsed = T.split_tags(F.col(name)) if types[name] == "string" else T.clean_tag_list(F.col(name))
        return F.coalesce(parsed, F.array().cast("array<string>"))

    def real(name: str) -> Column:
        return N.safe_double(F.col(name)) if have(name) else F.lit(None).cast("double")

    name = F.col("name") if have("name") else F.lit("")
    year = real("year_published")
    reason = (
        F.when(required_int("item_id").isNull(), "item_id")
        .when(name.isNull(), "name")
        .when(required_int("min_players").isNull(), "min_players")
        .when(required_int("max_players").isNull(), "max_players")
        .when(required_int("playing_time_minutes").isNull(), "playing_time_minutes")
        .when(F.isnan(year), "year_published")
    )
    least = N.clamp(required_int("min_players"), low=1)
    ratings = N.safe_int(F.col("num_user_ratings"), types["num_user_ratings"] == "string") if have("num_user_ratings") else F.lit(0)
    age = F.nanvl(F.coalesce(N.clamp(real("age_recommendation"), low=0.0), F.lit(0.0)), F.lit(0.0))
    usable_year = F.when(~F.isnan(year), year)
    return df.select(
        required_int("item_id").alias("item_id"),
        name.alias("title"),
        (F.coalesce(F.col("description"), F.lit("")) if have("description") else F.lit("")).alias("description"),
        tags("cat_mechanics").alias("mechanics"),
        tags("cat_categories").alias("genre"),
        tags("cat_themes").alias("themes"),
        least.cast("int").alias("min_players"),
        F.greatest(least, required_int("max_players")).cast("int").alias("max_players"),
        N.clamp(real("complexity"), 0.0, MAX_COMPLEXITY).alias("complexity"),
        age.cast("int").alias("age_recommendation"),
        F.coalesce(N.clamp(ratings, low=0), F.lit(0)).cast("bigint").alias("num_user_ratings"),
        F.coalesce(N.clamp(real("avg_rating"), 0.0, MAX_RATING), F.lit(0.0)).alias("avg_user_rating"),
        F.coalesce(usable_year.cast("int"), F.lit(0)).alias("year_published"),
        N.clamp(required_int("playing_time_minutes"), low=1).cast("int").alias("playing_time_minutes"),
        F.lit(PLACEHOLDER_IMAGE).alias("image_url"),
        F.concat(F.lit(item_url_prefix), required_int("item_id").cast("string")).alias("item_url"),
        reason.alias("reject_reason"),
    )


def accepted(records: DataFrame) -> DataFrame:
    return records.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(records: DataFrame) -> DataFrame:
    return records.filter(F.col("reject_reason").isNotNull()).select("item_id", "title", "reject_reason")


def catalog_view(catalog: DataFrame) -> DataFrame:
    """Response defaults: null numbers become 0, null lists become empty."""
    empty = F.array().cast("array<string>")
    defaults = {
        **{name: F.coalesce(F.col(name), empty) for name in ("mechanics", "genre", "themes")},
        **{
            name: F.coalesce(F.col(name), F.lit(0).cast(dict(catalog.dtypes)[name]))
            for name in ("complexity", "age_recommendation", "num_user_ratings", "avg_user_rating", "year_published")
        },
    }
    return catalog.withColumns({k: v for k, v in defaults.items() if k in catalog.columns})


# ---- checks ---------------------------------------------------------------


def catalog_status(catalog: DataFrame) -> DataFrame:
    """One row: size, extreme values and whether the catalog is invalid."""
    low = lambda name, bound: F.coalesce(F.col(name) < bound, F.lit(False))
    return catalog.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("complexity").alias("min_complexity"),
        F.min("age_recommendation").alias("min_age"),
        F.min("playing_time_minutes").alias("min_time"),
        F.min("min_players").alias("least_players"),
        # Title and description of a known placeholder record.
        F.count_if((F.col("title") == "Valid Game") & (F.col("description") == "Good")).alias("placeholders"),
    ).withColumn(
        "invalid",
        (
            low("min_complexity", 0)
            | low("min_age", 0)
            | low("min_time", 1)
            | low("least_players", 1)
            | (F.col("placeholders") > 0)
        ).cast("int"),
    )


def dataset_status(
    catalog: DataFrame, source: DataFrame, *, source_is_newer: bool = False, min_rows: int = MIN_CATALOG_ROWS
) -> DataFrame:
    """Readiness and freshness of a loaded catalog against its source table."""
    status = catalog_status(catalog).select("n_rows", "invalid")
    source_rows = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    stale = (F.lit(source_is_newer) | (F.col("source_rows") > F.col("n_rows"))).cast("int")
    return (
        status.withColumn("source_rows", source_rows)
        .withColumn("stale", stale)
        .withColumn("mismatch", ((F.col("source_rows") > 0) & (F.col("source_rows") != F.col("n_rows"))).cast("int"))
        .withColumn(
            "ready",
            ((F.col("n_rows") >= min_rows) & (F.col("invalid") == 0) & (F.col("stale") == 0)).cast("int"),
        )
    )


def bound_violations(catalog: DataFrame) -> DataFrame:
    """One row per (item, broken bound)."""
    c = F.col
    rules = {
        "min_players>=1": c("min_players") >= 1,
        "max_players>=1": c("max_players") >= 1,
        "complexity in 0..5": c("complexity").between(0, MAX_COMPLEXITY),
        "age_recommendation>=0": c("age_recommendation") >= 0,
        "num_user_ratings>=0": c("num_user_ratings") >= 0,
        "avg_user_rating in 0..10": c("avg_user_rating").between(0, MAX_RATING),
        "playing_time_minutes>=1": c("playing_time_minutes") >= 1,
    }
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
        lambda rule: rule.isNotNull(),
    )
    return catalog.select("item_id", F.explode(broken).alias("rule"))


def duplicate_rows(df: DataFrame, key: str = "item_id") -> DataFrame:
    """How many rows carry a key that occurs more than once."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))
    )
