"""Recommendations for a whole table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import SERVICE_PRESET, Preferences
from shelfwise.functions.numbers import duration_minutes
from shelfwise.operators.preferences import centroids
from shelfwise.operators.scoring import directions, top_items
from shelfwise.operators.search import filter_for_context
from shelfwise.session import cut_lineage

# Fixed value: candidates ranked per wanted result when the context filter runs after ranking.
OVERFETCH = 5


def user_directions(liked: DataFrame, items: DataFrame, prefs: Preferences) -> DataFrame:
    """(user_id, vector) preference directions; users without a known liked item drop out."""
    vectors = liked.select("user_id", "item_id").join(items.select("item_id", "vector"), "item_id")
    return directions(centroids(vectors, prefs), prefs.aggregation, "user_id")


def _score_requests(
    requests: DataFrame, liked: DataFrame, items: DataFrame, prefs: Preferences, context: list[str], factor: int
) -> DataFrame:
    """Ranked rows of every request. Requests that only differ in their number of
    results, of the same user and context, are scored once."""
    key = F.concat_ws("|", "user_id", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in context])
    keyed = requests.withColumn("query_id", key if context else F.col("user_id"))
    distinct = keyed.groupBy("query_id", "user_id", *context).agg(
        (F.max("num_results") * factor).cast("int").alias("n_results")
    )
    found = user_directions(liked, items, prefs)
    if prefs.aggregation == "max":
        found = cut_lineage(found)  # several steps read the centroids
    queries = distinct.join(found, "user_id")
    exclude = distinct.select("query_id", "user_id").join(liked.select("user_id", "item_id"), "user_id")
    ranked = top_items(
        queries,
        items,
        aggregation=prefs.aggregation,
        exclude=exclude,
        n_queries=distinct.count() if prefs.aggregation == "mean" else None,
    )
    return (
        ranked.join(keyed, "query_id")
        .filter(F.col("rank") < F.col("num_results") * factor)
        .select(*requests.columns, "item_id", "score", "rank")
    )


def recommend_prefiltered(
    requests: DataFrame, liked: DataFrame, items: DataFrame, prefs: Preferences = SERVICE_PRESET
) -> DataFrame:
    """Rank only items that suit the request: exactly ``num_results`` if enough exist.

    ``requests``: request_id, user_id, players, max_minutes, num_results;
    ``items``: item_id, vector, min_players, max_players, playing_time_minutes.
    """
    return _score_requests(requests, _of_users(liked, requests), items, prefs, ["players", "max_minutes"], 1)


def recommend_postfiltered(
    requests: DataFrame,
    liked: DataFrame,
    items: DataFrame,
    catalog: DataFrame,
    prefs: Preferences = SERVICE_PRESET,
    *,
    overfetch: int = OVERFETCH,
) -> DataFrame:
    """Rank all items, keep those that suit the request, then cut to ``num_results``.

    What suits a user and context is ranked once, as far as the longest request for it looks; every other request
    shows the start of that list.
    """
    context = ["user_id", "players", "duration"]
    asked = requests.groupBy(*context).agg(F.max("num_results").alias("num_results"))
    ranked = _score_requests(asked, _of_users(liked, asked), items, prefs, [], overfetch)
    order = Window.partitionBy(*context).orderBy("rank")
    suited = (
        filter_for_context(ranked, catalog)
        .withColumn("_place", (F.row_number().over(order) - 1).cast("int"))
        .filter(F.col("_place") < F.col("num_results"))
        .select(*[F.col(c).alias(f"_{c}") for c in context], "item_id", "score", F.col("rank").alias("_of_all"), "_place")
    )
    same = [requests[c].eqNullSafe(suited[f"_{c}"]) for c in context]
    return (
        requests.join(suited, same[0] & same[1] & same[2])
        .filter((F.col("_of_all") < F.col("num_results") * overfetch) & (F.col("_place") < F.col("num_results")))
        .select(*requests.columns, "item_id", "score", F.col("_place").alias("rank"))
    )


def _of_users(liked: DataFrame, requests: DataFrame) -> DataFrame:
    """The liked items of users with a request; others need no vectors."""
    return liked.join(requests.select("user_id").distinct(), "user_id", "left_semi")


def with_minutes(requests: DataFrame) -> DataFrame:
    """Add the time bound of the duration bucket."""
    return requests.withColumn("max_minutes", duration_minutes(F.col("duration")))


def format_results(ranked: DataFrame) -> DataFrame:
    """Display columns: unknown ratings 0, NaN times null, whole numbers."""
    number = lambda name: F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return ranked.withColumns(
        {
            "avg_rating": F.coalesce(number("avg_rating"), F.lit(0.0)),
            "playing_time": number("playing_time_minutes").try_cast("int"),
            "min_players": number("min_players").try_cast("int"),
            "max_players": number("max_players").try_cast("int"),
        }
    ).drop("playing_time_minutes")
