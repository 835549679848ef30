"""Requests, participants and stored recommendation sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import known_group, study_group

# Limits and enumerations of a recommendation request.
MAX_RESULTS = 100
DEFAULT_RESULTS = 10
DURATIONS = ("short", "medium", "long")
PARTICIPANT_PREFIX = "participant-"

SELECTION_SCHEMA = (
    "array<struct<item:struct<id:bigint,title:string>,"
    "explanation:struct<type:string,"
    "references:array<struct<liked_id:bigint,title:string,influence:string>>,"
    "features:array<struct<label:string,category:string,influence:string>>>>>"
)
INTENT_SCHEMA = "struct<user_id:bigint,players:int,duration:string,num_results:int>"


def request_checks(requests: DataFrame, liked: DataFrame) -> DataFrame:
    """Requests with a ``reject_reason``, null for valid ones.

    ``requests``: request_id, user_id, players, duration, num_results; ``liked``:
    user_id, item_id. Liked lists stay rows, so a list may have any length; a
    repeated id is found by counting (user, item) first.
    """
    per_item = liked.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    lists = per_item.groupBy("user_id").agg(
        F.sum("n").alias("n_liked"), F.max("n").alias("most"), F.min("item_id").alias("least")
    )
    results = F.coalesce("num_results", F.lit(DEFAULT_RESULTS))
    reason = (
        F.when(F.coalesce("n_liked", F.lit(0)) == 0, "no liked items")
        .when(F.col("most") > 1, "liked items repeat")
        .when(F.col("least") < 1, "liked ids must be positive")
        .when(F.col("players").isNull() | (F.col("players") < 1), "players must be positive")
        .when(~results.between(1, MAX_RESULTS), f"num_results must be between 1 and {MAX_RESULTS}")
        .when(F.col("duration").isNotNull() & ~F.col("duration").isin(*DURATIONS), "unknown duration")
    )
    return (
        requests.join(lists, "user_id", "left")
        .withColumns({"reject_reason": reason, "num_results": results})
        .select(*requests.columns, "reject_reason")
    )


def latest_by_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Last version of every key: the upsert rule of all stored tables.

    Uses an aggregate, not a window, so versions of a hot key combine map-side.
    """
    rest = [name for name in df.columns if name not in keys]
    version = F.struct(*order)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")


def upsert(stored: DataFrame, changes: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Stored rows with the changes applied; on equal order the change wins."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_by_key(both, keys, *order, "_new").drop("_new")


def participant_id(users: Column) -> Column:
    """The id under which a user takes part; groups are a function of it everywhere."""
    return F.concat(F.lit(PARTICIPANT_PREFIX), users.cast("string"))


def participants(users: Column, override: Column | None = None) -> list[Column]:
    """Participant id and sticky experiment group of user ids."""
    identifier = participant_id(users)
    return [identifier.alias("participant_id"), study_group(identifier, override).alias("study_group")]


def register(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving participants that are new: repeated and existing ids are refused."""
    once = arriving.groupBy("participant_id").agg(F.min("ts").alias("ts"))
    return once.join(existing.select("participant_id"), "participant_id", "left_anti").withColumn(
        "study_group", study_group(F.col("participant_id"))
    )


def resume_status(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Can a session be resumed: ok, invalid (bad prefix) or missing."""
    return requests.join(
        existing.select("participant_id", "study_group"), "participant_id", "left"
    ).withColumn(
        "status",
        F.when(~F.coalesce(F.startswith(F.col("participant_id"), F.lit(PARTICIPANT_PREFIX)), F.lit(False)), "invalid")
        .when(F.col("study_group").isNull(), "missing")
        .otherwise("ok"),
    )


def session_access(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per (session_id, participant_id) request: ok, denied or missing."""
    owners = sessions.select(F.col("id").alias("session_id"), F.col("participant_id").alias("owner"))
    return requests.join(owners, "session_id", "left").withColumn(
        "status",
        F.when(F.col("owner").isNull(), "missing")
        .when(F.col("owner") == F.col("participant_id"), "ok")
        .otherwise("denied"),
    )


def session_id(*parts: str) -> Column:
    """Repeatable session id, so that a retried job writes the same session."""
    return F.concat(F.lit("rec-"), F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256), 1, 32))


def assemble(
    results: DataFrame,
    requests: DataFrame,
    *,
    model_version: str,
    created_at: Column,
    answer: str = "request_id",
) -> DataFrame:
    """Sessions from explained results: one row per request with nested selections.

    A request holds at most 100 results, so the nested array is bounded. ``answer`` names the column of ``requests``
    that says under which request id its results stand, so that equal requests may share them.
    """
    entry = F.struct(
        "rank",
        F.struct(F.col("item_id").alias("id"), "title").alias("item"),
        F.struct("type", "references", "features").alias("explanation"),
    )
    grouped = results.groupBy(F.col("request_id").alias("_answer")).agg(F.array_sort(F.collect_list(entry_sortable(entry))).alias("s"))
    selections = F.transform("s", lambda s: F.struct(s["e"]["item"].alias("item"), s["e"]["explanation"].alias("explanation")))
    return grouped.join(requests, F.col("_answer") == F.col(answer)).select(
        session_id("request_id").alias("id"),
        "request_id",
        F.concat(F.lit(PARTICIPANT_PREFIX), F.col("user_id").cast("string")).alias("participant_id"),
        created_at.alias("created_at"),
        F.lit(model_version).alias("model_version"),
        F.col("study_group").alias("experiment_group"),
        F.struct("user_id", "players", "duration", "num_results").alias("intent"),
        selections.alias("recommendations"),
    )


def entry_sortable(entry: Column) -> Column:
    return F.struct(entry["rank"].alias("rank"), entry.alias("e"))


def encode(sessions: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the stored form."""
    return sessions.withColumns(
        {
            "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"),
            "intent": F.to_json("intent"),
            "recommendations": F.to_json("recommendations"),
        }
    )


def decode(stored: DataFrame, fallback_time: Column) -> DataFrame:
    """Stored sessions back to columns, tolerating old or damaged rows.

    A bad timestamp becomes ``fallback_time``, unknown groups become references,
    fields outside the request are dropped and selections without an item id are
    skipped and counted.
    """
    parsed = stored.withColumns(
        {
            "created_at": F.coalesce(F.try_to_timestamp(F.col("created_at")), fallback_time),
            "experiment_group": known_group(F.col("experiment_group")),
            "intent": F.from_json("intent", INTENT_SCHEMA),
            "_all": F.from_json("recommendations", SELECTION_SCHEMA),
        }
    )
    good = F.filter(
        F.coalesce("_all", F.array().cast(SELECTION_SCHEMA)), lambda s: s["item"]["id"].isNotNull()
    )
    return parsed.withColumns(
        {
            "recommendations": good,
            "skipped": F.coalesce(F.size("_all"), F.lit(0)) - F.size(good),
        }
    ).drop("_all")
