"""Catalog search: facets, paging, context filters, lookups, typeahead, hydration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import duration_minutes, is_stale
from shelfwise.functions.text import any_tag_startswith
from shelfwise.session import cut_lineage, work_folder

# Paging limits and the metadata time to live.
PAGE_LIMITS = (1, 100)
MAX_ID = 2**63 - 1
METADATA_TTL_SECONDS = 7 * 24 * 60 * 60


def facet_predicate(
    *,
    q: str | None = None,
    genre: Sequence[str] | None = None,
    mechanics: Sequence[str] | None = None,
    themes: Sequence[str] | None = None,
) -> Column:
    """AND across facets, OR within one; blank facets are no restriction.

    ``%`` and ``_`` in the inputs keep their LIKE meaning.
    """
    parts = [F.col("title").ilike(f"%{q}%")] if q else []
    for column, values in (("genre", genre), ("mechanics", mechanics), ("themes", themes)):
        test = any_tag_startswith(F.col(column), values)
        if test is not None:
            parts.append(test)
    predicate = F.lit(True)
    for part in parts:
        predicate = predicate & part
    return predicate


def search(catalog: DataFrame, **facets) -> DataFrame:
    return catalog.filter(facet_predicate(**facets))


def search_page(catalog: DataFrame, *, limit: int = 10, offset: int = 0, **facets) -> DataFrame:
    """One page in id order, every row carrying the total number of matches."""
    found = search(catalog, **facets)
    if limit <= 0:
        return found.withColumn("total", F.lit(0).cast("bigint")).limit(0)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.orderBy("item_id").offset(offset).limit(limit).withColumn("total", total)


def check_page(limit: int, offset: int) -> None:
    if not PAGE_LIMITS[0] <= limit <= PAGE_LIMITS[1]:
        raise ValueError(f"limit must be between {PAGE_LIMITS[0]} and {PAGE_LIMITS[1]}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def page_after(catalog: DataFrame, last_id: int, limit: int, **facets) -> DataFrame:
    """Keyset paging: the next page after an id, whose cost does not grow with depth."""
    return search(catalog, **facets).filter(F.col("item_id") > last_id).orderBy("item_id").limit(limit)


def lookup(catalog: DataFrame, item_id: int) -> DataFrame:
    """The record with this id, or no row."""
    if item_id < 1:
        raise ValueError(f"item id must be between 1 and {MAX_ID}")
    if item_id > MAX_ID:
        return catalog.limit(0)
    return catalog.filter(F.col("item_id") == item_id)


def fits_context(players: Column, max_minutes: Column) -> Column:
    """Does a catalog record suit a number of players and a time bound (null = none)?

    Records with unknown bounds never match a given restriction.
    """
    seats = players.isNull() | ((F.col("min_players") <= players) & (F.col("max_players") >= players))
    time = max_minutes.isNull() | (F.col("playing_time_minutes") <= max_minutes)
    return seats & time


def filter_for_context(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ranked rows whose item suits the request's players and duration, ranks kept."""
    attributes = catalog.select("item_id", "min_players", "max_players", "playing_time_minutes")
    return (
        ranked.join(attributes, "item_id")
        .filter(fits_context(F.col("players"), duration_minutes(F.col("duration"))))
        .select(*ranked.columns)
    )


def list_for_context(
    catalog: DataFrame, *, players: int | None = None, max_minutes: int | None = None, limit: int | None = None
) -> DataFrame:
    found = catalog.filter(
        fits_context(F.lit(players).cast("int"), F.lit(max_minutes).cast("int"))
    ).orderBy("item_id")
    return found if limit is None else found.limit(limit)


def candidates(items: DataFrame, liked: DataFrame, *, players: int, max_minutes: int) -> DataFrame:
    """Items that suit one request and are not liked, by name, in its liked list."""
    fits = fits_context(F.lit(players), F.lit(max_minutes)) & F.col("playing_time_minutes").isNotNull()
    return items.filter(fits).join(liked.select("name").distinct(), "name", "left_anti")


def typeahead(options: DataFrame, text: str, max_items: int) -> DataFrame:
    """Options whose name or id contains the text, in id order; no text keeps all."""
    needle = text.lower()
    if needle:
        by_name = F.coalesce(F.contains(F.lower("name"), F.lit(needle)), F.lit(False))
        options = options.filter(by_name | F.contains(F.col("item_id").cast("string"), F.lit(needle)))
    return options.orderBy("item_id").limit(max_items)


def overlay(catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """Non-empty cached descriptions and images replace those of the catalog."""
    fresh = metadata.select(
        "item_id", F.col("description").alias("_description"), F.col("image_url").alias("_image_url")
    )
    present = lambda name: F.when(F.col(name) != "", F.col(name))
    return (
        catalog.join(fresh, "item_id", "left")
        .withColumns(
            {
                "description": F.coalesce(present("_description"), F.col("description")),
                "image_url": F.coalesce(present("_image_url"), F.col("image_url")),
            }
        )
        .drop("_description", "_image_url")
    )


def hydrate(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog records of the ranked items, rank kept."""
    return ranked.join(catalog, "item_id")


def missing_items(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct wanted ids that the catalog does not have."""
    return wanted.select("item_id").distinct().join(catalog.select("item_id"), "item_id", "left_anti")


def require_complete(wanted: DataFrame, catalog: DataFrame) -> None:
    """Raise if ids are missing, with their number and the table of all of them, sorted."""
    missing = cut_lineage(missing_items(wanted, catalog))
    count = missing.count()
    if count:
        path = work_folder(wanted.sparkSession, "missing-items")
        missing.orderBy("item_id").write.parquet(path)
        first = [row[0] for row in missing.orderBy("item_id").limit(20).collect()]
        raise LookupError(f"missing catalog records for {count} ids, all listed in {path}; the first are {first}")


def preferences(liked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Liked ids of stored requests with their titles, position kept."""
    return liked.join(catalog.select("item_id", "title"), "item_id").select(
        "request_id", "pos", "item_id", "title"
    )


def current_metadata(
    cached: DataFrame, updates: DataFrame, as_of: Column, *, ttl_seconds: int = METADATA_TTL_SECONDS
) -> DataFrame:
    """Fresh cache entries as they are; stale ones refreshed when an update arrived."""
    news = updates.select(
        "item_id",
        F.col("description").alias("_description"),
        F.col("image_url").alias("_image_url"),
        F.col("fetched_at").alias("_fetched_at"),
    )
    stale = F.coalesce(is_stale(F.col("fetched_at"), as_of, ttl_seconds), F.lit(True))
    joined = cached.withColumn("known", F.lit(True)).join(news, "item_id", "full")
    use_news = F.col("_fetched_at").isNotNull() & (F.col("known").isNull() | stale)
    pick = lambda name: F.when(use_news, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)
    return joined.select(
        "item_id",
        pick("description"),
        pick("image_url"),
        pick("fetched_at"),
        F.when(use_news, "refreshed").when(stale, "stale").otherwise("fresh").alias("state"),
    )
