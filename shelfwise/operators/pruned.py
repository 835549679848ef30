"""Exact best items of many queries without meeting every item: direction cells with bounds.

Items are put into cells around leader directions; a cell knows the widest angle between its leader and its items, and the
range of its items' context attributes. A query first meets the ``FIRST_CELLS`` cells with the highest bounds, which gives it a
score that the last of its results will have at least; then only the cells whose bound reaches that score. Skipped cells cannot
hold a result, so the rows are those of :func:`shelfwise.operators.scoring.top_items`. It pays off where vectors
gather in directions; where they point evenly everywhere, few cells can be skipped.

Leaders are the at most ``LEADERS`` items with the smallest hashes, a table of bounded size that every task gets. A cell with
more than one chunk of items is split. A task holds a chunk of queries and reads the cells one after the other; it decides which
of its queries meet a cell, so pairs of query and cell are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.blocks import LEFT_ROWS, RIGHT_ROWS, Grid, chunked, crossed, matrix, plan_grid, unit_rows
from shelfwise.operators.scoring import SCORE_DIGITS, Ranking, _numbers, _packed, rank_items
from shelfwise.session import cut_lineage

LEADERS, FIRST_CELLS = 256, 4
_ATTRIBUTES = ("min_players", "max_players", "playing_time_minutes")
_MARGIN = 1e-9
# Pairs of query and cell whose bounds a task holds at a time, and whose yes or no.
VISIT_ROWS = 32768
_VISITS = 64_000_000


def direction_cells(items: DataFrame, leaders: int = LEADERS) -> tuple[DataFrame, np.ndarray]:
    """Items with their ``cell`` and ``angle`` to its leader, and the leader directions; cell % leaders is the leader."""
    rows = items.orderBy(F.xxhash64("item_id"), "item_id").limit(leaders).select("vector").collect()
    directions, _ = unit_rows(np.array([row["vector"] for row in rows], dtype=float))
    types = {field.name: field.dataType.simpleString() for field in items.schema.fields}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units, _ = unit_rows(matrix(pa.chunked_array([batch.column("vector")])))
                cosines = units @ directions.T
                nearest = cosines.argmax(axis=1)
                angles = np.arccos(np.clip(cosines[np.arange(len(nearest)), nearest], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(angles)], names=[*batch.schema.names, "leader", "angle"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in types.items()) + ", leader int, angle double"
    placed = cut_lineage(items.mapInArrow(assign, schema))
    sizes = {row["leader"]: row["count"] for row in placed.groupBy("leader").count().collect()}  # at most one row per leader
    parts = F.create_map(*[F.lit(x) for leader, n in sizes.items() for x in (leader, -(-n // RIGHT_ROWS))])
    part = F.pmod(F.xxhash64("item_id"), F.element_at(parts, F.col("leader"))).cast("int")
    return placed.withColumn("cell", F.col("leader") + F.lit(len(directions)) * part).drop("leader"), directions


def _bounds(cells: list, directions: np.ndarray, filtered: bool):
    """A function from queries (vectors, players, minutes) to the highest score that each cell can give them."""
    leader = np.array([c["cell"] for c in cells]) % len(directions)
    radius = np.array([c["radius"] for c in cells])
    low, high, time = (np.array([np.nan if c[name] is None else c[name] for c in cells], float) for name in ("low", "high", "time")) if filtered else (None,) * 3

    def bound(vectors: np.ndarray, players, minutes) -> np.ndarray:
        units, lengths = unit_rows(vectors)  # scores grow with the length of the query
        angles = np.arccos(np.clip(units @ directions.T, -1.0, 1.0))[:, leader]
        best = lengths[:, None] * np.cos(np.maximum(angles - radius, 0.0)) + _MARGIN * (1.0 + lengths[:, None])
        if filtered:
            fits = (low <= players[:, None]) & (high >= players[:, None]) & ~np.isnan(time)
            fits &= np.isnan(minutes)[:, None] | (time <= minutes[:, None])
            best[~fits] = -np.inf
        return best

    return bound


def pruned_top_items(
    queries: DataFrame, items: DataFrame, *, exclude: DataFrame | None = None, leaders: int = LEADERS, first_cells: int = FIRST_CELLS
) -> tuple[DataFrame, DataFrame]:
    """(query_id, item_id, score, rank) as ``top_items`` with one vector per query, and one row of what was skipped:
    n_queries, n_cells, n_met (pairs of query and cell that were compared).

    ``queries``: query_id, vector, n_results and, for a filtered ranking, players and max_minutes; ids are unique. ``items``:
    item_id, vector and, for a filtered ranking, min_players, max_players, playing_time_minutes.
    """
    filtered = "players" in queries.columns
    context = ["players", "max_minutes"] if filtered else []
    items = items.select("item_id", "vector", *(_ATTRIBUTES if filtered else ()))
    queries = cut_lineage(queries.select("query_id", "vector", "n_results", *context))
    kinds = {field.name: field.dataType.simpleString() for field in (*queries.schema.fields, *items.schema.fields)}
    if items.isEmpty():
        none = queries.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double, rank int")
        return none, queries.agg(F.count(F.lit(1)).alias("n_queries"), F.lit(0).alias("n_cells"), F.lit(0).cast("bigint").alias("n_met"))
    placed, directions = direction_cells(items, leaders)
    ranges = [F.min("min_players").alias("low"), F.max("max_players").alias("high"), F.min("playing_time_minutes").alias("time")] if filtered else []
    cells = placed.groupBy("cell").agg(F.max("angle").alias("radius"), *ranges).orderBy("cell").collect()  # bounded by leaders and chunks
    numbers = np.array([c["cell"] for c in cells])
    bound = _bounds(cells, directions, filtered)
    n_queries, n_items = queries.count(), placed.count()
    grid = plan_grid(queries, n_queries, n_items)
    grid = Grid(max(grid.left, math.ceil(n_queries / min(LEFT_ROWS, max(1, _VISITS // len(cells))))), grid.right)
    chunks = cut_lineage(chunked(placed.drop("angle").repartition(max(1, -(-n_items // RIGHT_ROWS)), "cell"), "cell", RIGHT_ROWS))

    def visits(table: pa.Table, ranking: Ranking, second: bool) -> np.ndarray:
        """Which query meets which cell; the second time those that the first round did not meet and cannot rule out."""
        out = np.zeros((table.num_rows, len(cells)), bool)
        reached = _numbers(table.column("reached")) if second else None
        step = max(1, VISIT_ROWS // len(cells))  # a query may meet every cell
        for at in range(0, len(out), step):
            rows = slice(at, at + step)
            extra = [ranking.players[rows], ranking.minutes[rows]] if filtered else [None, None]
            best = bound(ranking.vectors[ranking.starts[rows]], *extra)
            first = np.zeros(best.shape, bool)
            np.put_along_axis(first, np.argsort(-best, axis=1, kind="stable")[:, :first_cells], True, axis=1)
            if second:
                out[rows] = ~first & np.isfinite(best) & (np.isnan(reached[rows])[:, None] | (best >= reached[rows][:, None]))
            else:
                out[rows] = first & np.isfinite(best)
        return out

    def scored(asked: DataFrame, second: bool) -> DataFrame:
        """Winners of the cells that the queries meet, and rows of how many pairs of query and cell ``met``."""

        def compare(left: pa.Table, rights: Iterator[pa.Table]) -> Iterator[pa.Table]:
            ranking = Ranking(left, filtered)
            met = visits(left, ranking, second)
            if second:
                # what the first round found keeps out everything below
                reached = _numbers(left.column("reached"))
                ranking.bar = np.where(np.isnan(reached), -np.inf, reached - 2.0 * 10.0**-SCORE_DIGITS)
            pairs, cell = 0, None
            for right in rights:
                last, cell = cell, right.column("cell")[0].as_py()
                rows = np.flatnonzero(met[:, np.searchsorted(numbers, cell)])
                pairs += len(rows) if cell != last else 0  # a cell may be cut into several chunks
                if len(rows):
                    ranking.meet(right, rows)
            if ranking.ids is not None:
                found = ranking.table()
                yield found.append_column("met", pa.nulls(found.num_rows, pa.int64()))
            told = {"query_id": left.schema.field("query_id").type, "item_id": right.schema.field("item_id").type, "score": pa.float64(), "n_results": pa.int32()}
            yield pa.table({**{name: pa.nulls(1, kind) for name, kind in told.items()}, "met": pa.array([pairs], pa.int64())})

        left = _packed(asked, exclude, grid, kinds["item_id"])
        schema = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double, n_results int, met bigint"
        return cut_lineage(crossed(left, chunks, grid, compare, schema))

    first = scored(queries, False)
    found = lambda df: df.filter("met IS NULL").drop("met")
    place = rank_items(found(first)).filter(F.col("rank") == F.col("n_results") - 1).select("query_id", F.col("score").alias("reached"))
    second = scored(queries.join(place, "query_id", "left"), True)
    ranked = rank_items(found(first).unionByName(found(second))).filter(F.col("rank") < F.col("n_results")).drop("n_results")
    met = first.unionByName(second).agg(F.coalesce(F.sum("met"), F.lit(0)).alias("n_met"))
    report = met.select(F.lit(n_queries).cast("bigint").alias("n_queries"), F.lit(len(cells)).alias("n_cells"), "n_met")
    return ranked, report
