"""Raw tables to the feature table and its quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.config import Preprocessing
from shelfwise.operators import catalog as C
from shelfwise.operators import profile as P
from shelfwise.operators.text_features import feature_table


def filtered_catalog(items: DataFrame, tag_tables: list[DataFrame], config: Preprocessing) -> DataFrame:
    """Filter on item columns first, then join the tags of what is left."""
    timed = items.withColumn("playing_time_minutes", C.playing_time())
    return C.enrich(C.apply_filters(timed, config.filters), *tag_tables)


def preprocess(
    items: DataFrame,
    *,
    subcategories: DataFrame,
    mechanics: DataFrame,
    themes: DataFrame,
    config: Preprocessing,
) -> DataFrame:
    """The feature table of all items that pass the filters."""
    tags = [C.collapse_categories(items), subcategories, mechanics, themes]
    return feature_table(filtered_catalog(items, tags, config), config)


def quality_report(
    items: DataFrame, filtered: DataFrame, features: DataFrame, config: Preprocessing
) -> dict[str, DataFrame]:
    """The report as small tables; ``filtered`` and ``features`` are best stored first."""
    columns = config.features
    timed = items.withColumn("playing_time_minutes", C.playing_time())
    totals = filtered.agg(F.count(F.lit(1)).alias("rows_after_filters")).withColumn(
        "source_rows", items.agg(F.count(F.lit(1)).alias("n")).scalar()
    )
    removed = F.col("source_rows") - F.col("rows_after_filters")
    return {
        "totals": totals.withColumn("rows_removed", removed).withColumn(
            "removal_rate", F.when(F.col("source_rows") > 0, removed / F.col("source_rows")).otherwise(0.0)
        ),
        "filters": C.filter_report(timed, config.filters),
        "text": P.text_profile(filtered, columns.text),
        "text_tokens": P.text_profile(features, [f"text_{name}_tokens" for name in columns.text]),
        "categorical": P.categorical_profile(filtered, columns.categorical),
        "numeric": P.numeric_profile(filtered, columns.numeric).drop("std"),
        "integrity": C.duplicate_rows(items),
    }


def report_section(table: DataFrame) -> DataFrame:
    """A section (a handful of rows) as one JSON text row."""
    rows = F.sort_array(F.collect_list(F.struct(*table.columns)))
    return table.agg(F.to_json(rows).alias("body"))
