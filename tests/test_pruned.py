"""Pruned ranking: the rows of the full one, with cells skipped where vectors gather."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import pruned
from shelfwise.operators.scoring import top_items


@pytest.mark.parametrize("filtered", [False, True])
def test_rows_equal_the_full_ranking(spark, filtered, monkeypatch):
    monkeypatch.setattr(pruned, "RIGHT_ROWS", 40)
    monkeypatch.setattr(pruned, "LEFT_ROWS", 16)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    vectors = centres[draw.integers(0, 12, 900)] + 0.1 * draw.normal(size=(900, 16))
    vectors[5] = 0
    vectors[6:9] = vectors[9]  # ties
    rows = [(i, v.tolist(), int(i % 3) + 1, None if i % 50 == 0 else int(i % 3) + 2, None if i % 40 == 0 else int(i % 120)) for i, v in enumerate(vectors)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>, min_players int, max_players int, playing_time_minutes int")
    wishes = centres[draw.integers(0, 12, 60)] + 0.1 * draw.normal(size=(60, 16))
    wishes[3] = 0
    asked = [(f"q{i}", v.tolist(), 1 + i % 7, i % 5, None if i % 3 else 60) for i, v in enumerate(wishes)]
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>, n_results int, players int, max_minutes int")
    if not filtered:
        queries = queries.drop("players", "max_minutes")
    exclude = queries.select("query_id", F.lit(9).cast("long").alias("item_id")).union(queries.select("query_id", F.lit(10).cast("long")))
    full = {tuple(r) for r in top_items(queries, items, exclude=exclude).select("query_id", "rank", "item_id", F.round("score", 9)).collect()}
    ranked, report = pruned.pruned_top_items(queries, items, exclude=exclude, leaders=24, first_cells=3)
    assert {tuple(r) for r in ranked.select("query_id", "rank", "item_id", F.round("score", 9)).collect()} == full and full
    told = report.first()
    assert told["n_queries"] == 60 and told["n_cells"] >= 24
    if not filtered:
        assert told["n_met"] < 0.5 * told["n_queries"] * told["n_cells"]
    nothing, told = pruned.pruned_top_items(queries, items.limit(0))
    assert nothing.collect() == [] and told.first()["n_met"] == 0


def test_batches_of_visits_are_bounded(spark, monkeypatch):
    """Where no cell can be skipped, a task never holds all pairs of its queries and cells at once."""
    monkeypatch.setattr(pruned, "VISIT_ROWS", 64)
    draw = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(300, 8)))]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>")
    queries = items.limit(50).select(F.col("item_id").alias("query_id"), "vector", F.lit(3).alias("n_results"))
    key = lambda df: {tuple(r) for r in df.select("query_id", "rank", "item_id").collect()}
    assert key(pruned.pruned_top_items(queries, items, leaders=32)[0]) == key(top_items(queries, items))


def test_pairs_of_query_and_cell_are_not_rows(spark, monkeypatch):
    """A query is sent once a round, however many cells it meets; cut cells are counted once."""
    monkeypatch.setattr(pruned, "RIGHT_ROWS", 20)
    sent = []
    real = pruned.crossed
    monkeypatch.setattr(pruned, "crossed", lambda left, *rest: sent.append(left.count()) or real(left, *rest))
    draw = np.random.default_rng(7)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(300, 8)))], "item_id long, vector array<double>")
    queries = items.limit(50).select(F.col("item_id").alias("query_id"), "vector", F.lit(3).alias("n_results"))
    ranked, report = pruned.pruned_top_items(queries, items, leaders=8)
    told = report.first()
    assert sent == [50, 50] and 50 * pruned.FIRST_CELLS <= told["n_met"] <= 50 * told["n_cells"]
    key = lambda df: {tuple(r) for r in df.select("query_id", "rank", "item_id").collect()}
    assert key(ranked) == key(top_items(queries, items))
