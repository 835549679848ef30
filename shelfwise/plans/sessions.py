"""From requests to stored recommendation sessions, one batch for all requests."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import SERVICE_PRESET, Preferences
from shelfwise.functions.numbers import study_group
from shelfwise.operators.explain import explain_by_group
from shelfwise.operators.sessions import assemble, participant_id, request_checks
from shelfwise.plans.recommend import recommend_postfiltered
from shelfwise.session import cut_lineage


class Ranker(Protocol):
    """Requests to ranked rows: request columns, item_id, score, rank from 0.

    Requests that differ in nothing but their id are ranked once, so the ranks may not depend on it.
    """

    def __call__(
        self, requests: DataFrame, liked: DataFrame, items: DataFrame, catalog: DataFrame, prefs: Preferences
    ) -> DataFrame: ...


class Explainer(Protocol):
    """Ranked rows to explanations: request_id, rank, item_id, type, references, features."""

    def __call__(
        self, ranked: DataFrame, groups: DataFrame, liked: DataFrame, vectors: DataFrame, catalog: DataFrame
    ) -> DataFrame: ...


def checked_requests(
    requests: DataFrame, liked: DataFrame, participants: DataFrame | None = None, *, override: Column | None = None
) -> DataFrame:
    """Requests with a ``reject_reason``, null for valid ones, and the ``study_group`` of their participant.

    ``participants`` (participant_id, study_group) is the table of registered ones: a request of anybody else is rejected, and
    the stored group counts, whatever the rule for new participants says now. Without it every user takes part, in the
    group of that rule. ``override`` wins over both.
    """
    checked = request_checks(requests, liked)
    if participants is None:
        return checked.withColumn("study_group", study_group(participant_id(F.col("user_id")), override))
    stored = participants.groupBy(F.col("participant_id").alias("_participant")).agg(F.min("study_group").alias("_group"))
    known = checked.join(stored, participant_id(F.col("user_id")) == F.col("_participant"), "left")
    group = F.col("_group") if override is None else F.coalesce(override, F.col("_group"))
    reason = (
        F.when(F.col("_participant").isNull(), "participant not found")
        .when(~F.coalesce(group.isin("features", "references"), F.lit(False)), "unknown study group")
    )
    return known.withColumns({"reject_reason": F.coalesce("reject_reason", reason), "study_group": group}).drop("_participant", "_group")


def answered(
    requests: DataFrame,
    liked: DataFrame,
    items: DataFrame,
    catalog: DataFrame,
    prefs: Preferences = SERVICE_PRESET,
    *,
    override: Column | None = None,
    participants: DataFrame | None = None,
    ranker: Ranker = recommend_postfiltered,
    explainer: Explainer = explain_by_group,
) -> tuple[DataFrame, DataFrame]:
    """(valid requests with their group and ``ask_id``, explained results of every ask).

    Requests that agree in all but their id are one ask, known by a hash of what they share; it is ranked and explained
    once, and its results stand under that hash in ``request_id``.

    ``liked`` may repeat items per user only for requests that are thereby
    rejected; a column ``pos`` gives the order in which the user named them, id
    order without it. Requests without any suitable result have no result rows;
    :func:`session_outcomes` tells what became of every request.
    """
    checked = checked_requests(requests, liked, participants, override=override).filter(
        F.col("reject_reason").isNull() & F.col("request_id").isNotNull()
    )
    rest = [name for name in requests.columns if name != "request_id"] + ["study_group"]
    ask = F.substring(F.sha2(F.to_json(F.struct(*rest)), 256), 1, 32)
    # one short row per request, read by every later step
    valid = cut_lineage(checked.drop("reject_reason").withColumn("ask_id", ask))
    asking = valid.groupBy(F.col("ask_id").alias("request_id")).agg(*[F.first(name).alias(name) for name in rest])
    pos = F.col("pos") if "pos" in liked.columns else F.lit(0)
    positioned = liked.select("user_id", "item_id", pos.alias("pos")).join(
        asking.select("user_id").distinct(), "user_id", "left_semi"
    )
    likes = positioned.select("user_id", "item_id")
    ranked = ranker(asking, likes, items, catalog, prefs).select(
        "request_id", "user_id", "rank", "item_id", "score"
    )
    explained = explainer(ranked, asking, positioned, items, catalog)
    return valid, explained.join(catalog.select("item_id", "title"), "item_id")


def explained_results(
    requests: DataFrame, liked: DataFrame, items: DataFrame, catalog: DataFrame, prefs: Preferences = SERVICE_PRESET, **options
) -> tuple[DataFrame, DataFrame]:
    """(valid requests with their group, explained results of these requests); ``options`` as for :func:`answered`."""
    valid, results = answered(requests, liked, items, catalog, prefs, **options)
    by_ask = results.withColumnRenamed("request_id", "ask_id")
    return valid.drop("ask_id"), valid.select("request_id", "ask_id").join(by_ask, "ask_id").select(*results.columns)


def session_outcomes(
    requests: DataFrame,
    liked: DataFrame,
    ranked: DataFrame,
    catalog: DataFrame,
    participants: DataFrame | None = None,
    *,
    asks: DataFrame | None = None,
) -> DataFrame:
    """One row per request: request_id, status, reason, n_results, n_missing.

    ``rejected`` with the reason of the check, ``unavailable`` when nothing suits,
    ``incomplete`` when results have no catalog record (``n_missing`` of them), else
    ``ok``. ``ranked``: request_id, item_id. ``asks`` (request_id, ask_id) says that
    the results of a request stand in ``ranked`` under its ask, see :func:`answered`.
    """
    known = catalog.select("item_id", F.lit(1).alias("_known"))
    counts = ranked.select("request_id", "item_id").join(known, "item_id", "left").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count("_known").alias("_found")
    )
    if asks is not None:
        by_ask = counts.withColumnRenamed("request_id", "ask_id")
        counts = asks.select("request_id", "ask_id").distinct().join(by_ask, "ask_id").groupBy("request_id").agg(
            F.sum("_all").alias("_all"), F.sum("_found").alias("_found")
        )
    checked = checked_requests(requests, liked, participants).join(counts, "request_id", "left")
    n_results = F.coalesce("_all", F.lit(0))
    n_missing = n_results - F.coalesce("_found", F.lit(0))
    status = (
        F.when(F.col("reject_reason").isNotNull(), "rejected")
        .when(n_results == 0, "unavailable")
        .when(n_missing > 0, "incomplete")
        .otherwise("ok")
    )
    reason = F.coalesce(
        "reject_reason",
        F.when(status == "unavailable", "no item suits the request").when(status == "incomplete", "results without catalog record"),
    )
    return checked.select(
        "request_id", status.alias("status"), reason.alias("reason"), n_results.alias("n_results"), n_missing.alias("n_missing")
    )


def generate_sessions(
    requests: DataFrame,
    liked: DataFrame,
    items: DataFrame,
    catalog: DataFrame,
    *,
    created_at: Column,
    model_version: str = "v1",
    prefs: Preferences = SERVICE_PRESET,
    override: Column | None = None,
    participants: DataFrame | None = None,
    ranker: Ranker = recommend_postfiltered,
    explainer: Explainer = explain_by_group,
) -> DataFrame:
    """One nested session row per valid request that has results."""
    valid, results = answered(
        requests, liked, items, catalog, prefs, override=override, participants=participants, ranker=ranker, explainer=explainer
    )
    return assemble(results, valid, model_version=model_version, created_at=created_at, answer="ask_id")
