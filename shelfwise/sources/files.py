"""Readers and writers of the raw and prepared files."""

from __future__ import annotations

import tomllib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.catalog import collapse_flags

# Required columns of the raw item file, their names and types here.
ITEM_COLUMNS = {
    "BGGId": ("item_id", "bigint"),
    "Name": ("name", "string"),
    "Description": ("description", "string"),
    "YearPublished": ("year_published", "int"),
    "AvgRating": ("avg_rating", "double"),
    "NumOwned": ("num_owned", "bigint"),
    "MinPlayers": ("min_players", "int"),
    "MaxPlayers": ("max_players", "int"),
    "ComMaxPlaytime": ("community_max_playtime", "int"),
    "ComMinPlaytime": ("community_min_playtime", "int"),
    "MfgPlaytime": ("mfg_playtime", "int"),
    "NumUserRatings": ("num_user_ratings", "bigint"),
    "GameWeight": ("complexity", "double"),
    "ComAgeRec": ("age_recommendation", "double"),
}
ID_COLUMN = "BGGId"
CATEGORY_PREFIX = "Cat:"
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": False}


def _read_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    try:
        # all columns as text; the declared types are applied with try_cast
        return spark.read.options(**{**CSV_OPTIONS, "multiLine": multi_line}).csv(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"required dataset not found at {path}") from error
        raise


def category_name(header: str) -> str:
    return "cat_" + header.split(":", 1)[1].strip().lower().replace(" ", "_")


def load_items(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Raw item file with declared types; ``Cat:`` flag columns become ``cat_*``.

    Quoted texts may hold line breaks, at the price of one task per file;
    ``multi_line=False`` splits files, for inputs known to have none.
    """
    raw = _read_csv(spark, path, multi_line)
    missing = [name for name in ITEM_COLUMNS if name not in raw.columns]
    if missing:
        raise ValueError("item file is missing required columns: " + ", ".join(sorted(missing)))

    def typed(name: str):
        if name in ITEM_COLUMNS:
            target, kind = ITEM_COLUMNS[name]
            column = F.col(f"`{name}`")
            # "60.0" is a valid whole number in these files
            value = column.try_cast("double").try_cast(kind) if kind in ("int", "bigint") else column.try_cast(kind)
            return (value if kind != "string" else column).alias(target)
        if name.startswith(CATEGORY_PREFIX):
            return F.col(f"`{name}`").try_cast("int").alias(category_name(name))
        return F.col(f"`{name}`")

    return raw.select(*[typed(name) for name in raw.columns])


def load_tags(spark: SparkSession, path: str, output: str) -> DataFrame:
    """Wide 0/1 tag file, collapsed to one tag list per item."""
    raw = _read_csv(spark, path, False)
    if ID_COLUMN not in raw.columns:
        raise ValueError(f"{path} is missing the id column '{ID_COLUMN}'")
    flags = [name for name in raw.columns if name != ID_COLUMN]
    typed = raw.select(
        F.col(ID_COLUMN).try_cast("bigint").alias("item_id"),
        *[F.col(f"`{name}`").try_cast("double").alias(name) for name in flags],
    )
    return collapse_flags(typed, output, flags=flags)


def load_stopwords(spark: SparkSession, path: str) -> list[str]:
    """Configured stop words: trimmed of any white space, blank lines skipped."""
    word = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = spark.read.text(path).select(word.alias("w")).filter("w <> ''").distinct()
    return sorted(row["w"] for row in rows.collect())


def load_synonyms(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Configured synonyms ``canonical = [variants]``; entries that are no list of texts are ignored."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return {
        canonical: list(variants)
        for canonical, variants in tomllib.loads(text).items()
        if isinstance(variants, list) and all(isinstance(value, str) for value in variants)
    }


def write_features(features: DataFrame, path: str) -> str:
    features.write.mode("overwrite").parquet(path)
    return path


def read_features(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"feature table not found at {path}") from error
        raise


def newer_than(source: DataFrame, loaded_at: datetime | None) -> bool:
    """Was any file of a source changed after the catalog was loaded (or is there no catalog)?"""
    changed = source.agg(F.max("_metadata.file_modification_time")).first()[0]
    return changed is not None and (loaded_at is None or changed > loaded_at)


def write_report(report: dict[str, DataFrame], path: str) -> str:
    """One JSON file per report section, written section by section."""
    from shelfwise.plans.preprocess import report_section

    for section, table in report.items():
        report_section(table).coalesce(1).write.mode("overwrite").json(f"{path}/section={section}")
    return path
