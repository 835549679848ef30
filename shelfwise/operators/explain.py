"""Why an item was recommended: reference items or shared features, per result.

All rules are column expressions over at most three entries per result; the
similarities they need come from :mod:`shelfwise.operators.references`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import match_vocabulary
from shelfwise.functions.vocabulary import MECHANICS, THEMES
from shelfwise.operators.references import MAX_REFERENCES, liked_similarities, rotated
from shelfwise.session import cut_lineage

MAX_FEATURES = 3


def _stored(ranked: DataFrame, stored: bool) -> DataFrame:
    """The result lists are read several times, so they are computed once and stored."""
    return ranked if stored else cut_lineage(ranked.select("request_id", "user_id", "rank", "item_id", "score"))


def with_top_score(ranked: DataFrame) -> DataFrame:
    """Add ``top``, the score of the first result of the same request."""
    top = F.max(F.when(F.col("rank") == 0, F.col("score"))).over(Window.partitionBy("request_id"))
    return ranked.withColumn("top", F.coalesce(top, F.lit(0.0)))


def _replace_last(entries: Column, condition: Column, influence: str) -> Column:
    size = F.size(entries)
    changed = F.concat(
        F.slice(entries, 1, F.greatest(size - 1, F.lit(0))),
        F.transform(F.slice(entries, -1, 1), lambda e: e.withField("influence", F.lit(influence))),
    )
    return F.when(condition & (size > 0), changed).otherwise(entries)


def explain_by_references(
    ranked: DataFrame,
    liked: DataFrame,
    vectors: DataFrame,
    names: DataFrame,
    *,
    liked_rows: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Per result up to three liked items with their influence.

    ``ranked``: request_id, user_id, rank, item_id, score. ``liked``: user_id,
    item_id, pos. ``vectors``: item_id, vector. ``names``: item_id, name. Returns
    request_id, rank, item_id, references(array of liked_id, title, influence).
    """
    ranked = _stored(ranked, stored)
    scored = with_top_score(ranked)
    shown = rotated(liked_similarities(ranked, liked, vectors, liked_rows=liked_rows))
    in_store = liked.join(vectors.select("item_id"), "item_id", "left_semi")
    first = Window.partitionBy("user_id").orderBy("pos", "item_id")
    fallback = (
        # compared with the row number itself, the limit already holds before the shuffle
        in_store.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= MAX_REFERENCES)
        .select("user_id", F.col("item_id").alias("liked_id"), (F.col("place") - 1).alias("slot"))
    )
    titled = names.select(F.col("item_id").alias("liked_id"), F.col("name").alias("title"))

    def entries(df: DataFrame, keys: list[str], *extra: str) -> DataFrame:
        entry = F.struct("slot", "liked_id", F.coalesce("title", F.lit("")).alias("title"), *extra)
        return df.join(titled, "liked_id", "left").groupBy(*keys).agg(
            F.array_sort(F.collect_list(entry)).alias("entries")
        )

    compared = entries(shown, ["request_id", "rank"], "sim")
    fallback = entries(fallback, ["user_id"]).withColumnRenamed("entries", "fallback")
    rank, score, top = F.col("rank"), F.col("score"), F.col("top")
    n = F.size("entries")
    # Score and similarity thresholds of the influence rules.
    two = ((rank < 3) | ((top > 0) & (score >= 0.85 * top))) & (n >= 2)
    best = F.col("entries")[0]["sim"]
    best = F.when(best == 0, F.lit(1e-9)).otherwise(best)

    def influence(entry: Column, at: Column) -> Column:
        weak = (entry["sim"] / best < 0.5) | (entry["sim"] < 0.15)
        return F.struct(
            entry["liked_id"].alias("liked_id"),
            entry["title"].alias("title"),
            F.when((at == 0) | (F.col("two") & (at == 1)), "positive")
            .when(weak, "negative")
            .otherwise("neutral")
            .alias("influence"),
        )

    positive = F.transform(
        F.col("fallback"),
        lambda e: F.struct(
            e["liked_id"].alias("liked_id"), e["title"].alias("title"), F.lit("positive").alias("influence")
        ),
    )
    joined = (
        scored.join(compared, ["request_id", "rank"], "left")
        .join(fallback, "user_id", "left")
        .withColumn("two", two)
        .withColumn("refs", F.transform("entries", influence))
    )
    all_positive = F.forall("refs", lambda e: e["influence"] == "positive") & (F.size("refs") > 1)
    joined = joined.withColumn("refs", _replace_last(F.col("refs"), all_positive, "neutral"))
    faint = (F.size("refs") > 1) & ((rank >= 3) | ((top > 0) & (score < 0.7 * top)))
    joined = joined.withColumn("refs", _replace_last(F.col("refs"), faint, "negative"))
    none = F.array().cast(joined.schema["refs"].dataType)
    return joined.select(
        "request_id",
        "rank",
        "item_id",
        F.coalesce(F.when(F.size("entries") > 0, F.col("refs")), positive, none).alias("references"),
    )


def _tagged(column: str, category: str) -> Column:
    """Labels of a tag list with their category; a null list is empty."""
    return F.transform(
        F.coalesce(F.col(column), F.array().cast("array<string>")),
        lambda label: F.struct(label.alias("label"), F.lit(category).alias("category")),
    )


def feature_hints(catalog: DataFrame) -> DataFrame:
    """item_id, hints: distinct (label, category) pairs, mechanics, themes, then genre.

    An item without any tag offers its title as a theme.
    """
    hints = F.array_distinct(
        F.filter(
            F.concat(_tagged("mechanics", "mechanic"), _tagged("themes", "theme"), _tagged("genre", "genre")),
            lambda h: h["label"] != "",
        )
    )
    title = F.array(F.struct(F.col("title").alias("label"), F.lit("theme").alias("category")))
    untagged = F.when(F.col("title") != "", title).otherwise(F.array().cast(
        "array<struct<label:string,category:string>>"))
    return catalog.select(
        "item_id", F.when(F.size(hints) > 0, hints).otherwise(untagged).alias("hints")
    )


def split_labels(hints: DataFrame) -> DataFrame:
    """Replace labels by the vocabulary terms they contain (genres stay as they are)."""

    def expand(hint: Column) -> Column:
        terms = (
            F.when(hint["category"] == "mechanic", match_vocabulary(hint["label"], MECHANICS))
            .when(hint["category"] == "theme", match_vocabulary(hint["label"], THEMES))
            .otherwise(F.array(hint["label"]))
        )
        return F.transform(
            terms, lambda term: F.struct(term.alias("label"), hint["category"].alias("category"))
        )

    return hints.select("item_id", F.flatten(F.transform("hints", expand)).alias("labels"))


def liked_features(liked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct (user_id, category, label) over the tags of the liked items."""
    labels = F.concat(_tagged("mechanics", "mechanic"), _tagged("themes", "theme"), _tagged("genre", "genre"))
    tags = catalog.select("item_id", F.explode(labels).alias("t"))
    return liked.join(tags, "item_id").select("user_id", "t.category", "t.label").distinct()


def explain_by_features(
    ranked: DataFrame,
    liked: DataFrame,
    vectors: DataFrame,
    catalog: DataFrame,
    *,
    liked_rows: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Per result up to three feature labels with their influence.

    Returns request_id, rank, item_id, features(array of label, category,
    influence); a result missing from the catalog gets an empty list.
    """
    ranked = _stored(ranked, stored)
    scored = with_top_score(ranked)
    first = F.slice("labels", 1, MAX_FEATURES)
    labels = scored.join(split_labels(feature_hints(catalog)).select("item_id", first.alias("labels")), "item_id", "left")
    in_store = liked.join(vectors.select("item_id"), "item_id", "left_semi")
    comparable = in_store.select("user_id").distinct().withColumn("has_liked", F.lit(True))
    similar = liked_similarities(ranked, liked, vectors, liked_rows=liked_rows)
    best = similar.filter("place = 0").select("request_id", "rank", F.col("sim").alias("best_sim"))
    shared = liked_features(_with_similarity(in_store, vectors), catalog).withColumn("shared", F.lit(True))
    exploded = labels.select(
        "request_id", "user_id", "rank", F.posexplode("labels").alias("at", "l")
    ).select("request_id", "user_id", "rank", "at", "l.*")
    # Similarity and score thresholds of the influence rules.
    sim = F.coalesce("best_sim", F.lit(0.0))
    influence = (
        F.when(F.col("has_liked").isNull(), "positive")
        .when(F.coalesce("shared", F.lit(False)) & (sim >= 0.4), "positive")
        .when(sim < 0.2, "negative")
        .otherwise("neutral")
    )
    marked = (
        exploded.join(shared, ["user_id", "category", "label"], "left")
        .join(best, ["request_id", "rank"], "left")
        .join(comparable, "user_id", "left")
        .groupBy("request_id", "rank")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("at", "label", "category", influence.alias("influence")))
            ).alias("marked"),
            F.max("has_liked").alias("has_liked"),
        )
    )
    rank, score, top = F.col("rank"), F.col("score"), F.col("top")
    any_positive = F.exists("marked", lambda e: e["influence"] == "positive")
    lifted = F.transform(
        "marked",
        lambda e, at: F.struct(
            e["label"].alias("label"),
            e["category"].alias("category"),
            F.when((at == 0) & ~any_positive, "positive").otherwise(e["influence"]).alias("influence"),
        ),
    )
    joined = scored.join(marked, ["request_id", "rank"], "left").withColumn("features", lifted)
    faint = F.col("has_liked") & (F.size("features") > 1) & ((score < 0.6 * top) | (rank >= 4))
    none = F.array().cast(joined.schema["features"].dataType)
    return joined.select(
        "request_id",
        "rank",
        "item_id",
        F.coalesce(
            _replace_last(F.col("features"), F.coalesce(faint, F.lit(False)), "negative"), none
        ).alias("features"),
    )


def _with_similarity(liked: DataFrame, vectors: DataFrame) -> DataFrame:
    """Liked items whose vector has a length, the only ones that count as compared."""
    nonzero = F.exists("vector", lambda x: x != 0)
    return liked.join(vectors.filter(nonzero).select("item_id"), "item_id", "left_semi")


def explain_by_group(
    ranked: DataFrame,
    groups: DataFrame,
    liked: DataFrame,
    vectors: DataFrame,
    catalog: DataFrame,
    *,
    liked_rows: int | None = None,
) -> DataFrame:
    """Explain each request by the explainer of its group (request_id, study_group)."""
    named = catalog.select("item_id", F.col("title").alias("name"))
    tagged = ranked.join(groups.select("request_id", "study_group"), "request_id")
    unknown = F.raise_error(F.concat(F.lit("unknown study group "), F.col("study_group")))
    checked = tagged.withColumn(
        "study_group",
        F.when(F.col("study_group").isin("features", "references"), F.col("study_group")).otherwise(unknown),
    )
    checked = cut_lineage(checked)
    mine = lambda group: checked.filter(F.col("study_group") == group).drop("study_group")
    known = {"liked_rows": liked.count() if liked_rows is None else liked_rows, "stored": True}
    by_reference = explain_by_references(mine("references"), liked, vectors, named, **known)
    by_feature = explain_by_features(mine("features"), liked, vectors, catalog, **known)
    return by_reference.withColumn("type", F.lit("references")).unionByName(
        by_feature.withColumn("type", F.lit("features")), allowMissingColumns=True
    )


def truncate_explanations(entries: Column, limit: int) -> Column:
    """First entries and whether there are more."""
    return F.struct(F.slice(entries, 1, limit).alias("shown"), (F.size(entries) > limit).alias("has_more"))
