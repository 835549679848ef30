"""Cosine scoring of all items for all queries, keeping the best per query."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.numbers import l2_normalize
from shelfwise.operators import blocks
from shelfwise.operators.blocks import (
    Grid,
    cogroup_cells,
    matrix,
    plan_grid,
    right_chunks,
    unit_rows,
)

# Scores closer than this many decimals count as equal, so that ties do not
# depend on how the work was split; the item id decides between equals.
SCORE_DIGITS = 12
# Scores that a task holds at a time; its copies of them stay a few times this many numbers.
_CHUNK_CELLS = 1_000_000


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str = "vector") -> DataFrame:
    """Column-wise mean vector and row count per group (map-side combined)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias(vector),
    )


def directions(centroids: DataFrame, aggregation: str, by: str = "query_id") -> DataFrame:
    """Unit preference vectors prepared for one aggregation of the similarities.

    The mean of cosines equals the dot product with the mean unit vector, so
    ``mean`` needs one vector per query; ``max`` keeps one per centroid.
    """
    unit = centroids.select(by, l2_normalize(F.col("vector")).alias("vector"))
    return mean_vectors(unit, [by]).drop("n") if aggregation == "mean" else unit


def top_items(
    queries: DataFrame,
    items: DataFrame,
    *,
    aggregation: str = "mean",
    exclude: DataFrame | None = None,
    n_queries: int | None = None,
    n_items: int | None = None,
) -> DataFrame:
    """The ``n_results`` best items of every query, as (query_id, item_id, score, rank).

    ``queries``: query_id, vector (see :func:`directions`), n_results and, for a
    filtered ranking, players and max_minutes. ``items``: item_id, vector and,
    for a filtered ranking, min_players, max_players, playing_time_minutes.
    ``exclude``: (query_id, item_id) pairs that may not be returned.
    """
    if aggregation not in ("max", "mean"):
        raise ValueError("aggregation must be 'max' or 'mean'")
    filtered = "players" in queries.columns
    attributes = ["min_players", "max_players", "playing_time_minutes"] if filtered else []
    context = ["players", "max_minutes"] if filtered else []
    grid = plan_grid(
        queries,
        queries.count() if n_queries is None else n_queries,
        items.count() if n_items is None else n_items,
    )
    item_type = items.schema["item_id"].dataType.simpleString()
    left = _packed(queries.select("query_id", "vector", "n_results", *context), exclude, grid, item_type)
    right = right_chunks(items.select("item_id", "vector", *attributes), grid, "item_id")
    id_type = queries.schema["query_id"].dataType.simpleString()
    best = cogroup_cells(
        left, right, grid, _best_of_chunks(filtered), f"query_id {id_type}, item_id {item_type}, score double, n_results int"
    )
    if aggregation == "max":
        best = best.groupBy("query_id", "item_id").agg(
            F.max("score").alias("score"), F.first("n_results").alias("n_results")
        )
    return rank_items(best).filter(F.col("rank") < F.col("n_results")).drop("n_results")


def _packed(queries: DataFrame, exclude: DataFrame | None, grid: Grid, item_type: str) -> DataFrame:
    """One row per query with all its vectors and its excluded items, dealt to ``grid.left`` partitions by a single shuffle;
    queries of more than a chunk get several parts (``_part``).
    """
    sizes = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(blocks.LEFT_ROWS)).cast("int")
    # few: at most one of a chunk's number of vectors
    large = F.broadcast(sizes.filter(F.col("_n") > blocks.LEFT_ROWS).select("query_id", parts.alias("_parts")))
    part = F.pmod(F.xxhash64("vector"), F.coalesce("_parts", F.lit(1))).cast("int")
    rows = queries.join(large, "query_id", "left").select(*queries.columns, part.alias("_part"), F.lit(None).cast(item_type).alias("_skip"))
    if exclude is not None:
        every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        skips = exclude.select("query_id", F.col("item_id").alias("_skip")).filter(F.col("query_id").isNotNull())
        rows = rows.unionByName(skips.join(large, "query_id", "left").select("query_id", "_skip", every.alias("_part")), allowMissingColumns=True)
    own = [F.first(name, ignorenulls=True).alias(name) for name in queries.columns if name not in ("query_id", "vector")]
    return (
        rows.repartition(grid.left, "query_id", "_part")
        .groupBy("query_id", "_part")
        .agg(F.collect_list("vector").alias("vector"), F.collect_set("_skip").alias("_skip"), *own, F.count("n_results").alias("_rows"))
        .filter("_rows > 0")
        .drop("_rows")
    )


def similarity_summary(queries: DataFrame, items: DataFrame, *, n_queries: int | None = None) -> DataFrame:
    """Per query: number of items compared and their lowest, mean and highest cosine.

    Every pair is compared, inside a cell; only one row per query leaves a cell.
    """
    grid = plan_grid(queries, queries.count() if n_queries is None else n_queries, items.count())
    left = queries.select("query_id", "vector").repartition(grid.left, "query_id")
    right = right_chunks(items.select("item_id", "vector"), grid, "item_id")
    id_type = queries.schema["query_id"].dataType.simpleString()
    cells = cogroup_cells(
        left, right, grid, _summarized, f"query_id {id_type}, n bigint, total double, low double, high double"
    )
    return cells.groupBy("query_id").agg(
        F.sum("n").alias("n_items"),
        F.min("low").alias("min_similarity"),
        (F.sum("total") / F.sum("n")).alias("mean_similarity"),
        F.max("high").alias("max_similarity"),
    )


def _summarized(left: pa.Table, rights: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Number, sum, lowest and highest of the cosines of every left row; at most ``_CHUNK_CELLS`` of them are held at a time."""
    sources, _ = unit_rows(matrix(left.column("vector")))
    n, total, low, high = 0, np.zeros(len(sources)), np.full(len(sources), np.inf), np.full(len(sources), -np.inf)
    for right in rights:
        targets, _ = unit_rows(matrix(right.column("vector")))
        n += len(targets)
        step = max(1, _CHUNK_CELLS // len(targets))
        for at in range(0, len(sources), step):
            rows = slice(at, at + step)
            scores = sources[rows] @ targets.T
            total[rows] += scores.sum(axis=1)
            np.minimum(low[rows], scores.min(axis=1), out=low[rows])
            np.maximum(high[rows], scores.max(axis=1), out=high[rows])
    names = {"n": np.full(len(sources), n), "total": total, "low": low, "high": high}
    yield pa.table({"query_id": left.column("query_id"), **{name: pa.array(values) for name, values in names.items()}})


def rank_items(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """0-based rank by score, best first, equal scores by item id."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("item_id"))
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


def _best_of_chunks(filtered: bool):
    """The best items of a chunk of queries among chunks of items, see :func:`crossed`."""

    def best(left: pa.Table, rights: Iterator[pa.Table]) -> Iterator[pa.Table]:
        ranking = Ranking(left, filtered)
        for right in rights:
            ranking.meet(right)
        if ranking.ids is not None:
            yield ranking.table()

    return best


class Ranking:
    """The best items so far of the queries of a chunk, which meets chunks of items one after the other.

    The rows of ``queries`` are query_id, vector (one vector or a list of them, of which the best matching one counts), n_results,
    _skip and, if ``filtered``, players and max_minutes.
    """

    def __init__(self, queries: pa.Table, filtered: bool) -> None:
        self.queries, self.filtered = queries, filtered
        self.vectors, self.starts = _unpacked(queries.column("vector"))
        self.ends = np.append(self.starts[1:], len(self.vectors))
        self.wanted = queries.column("n_results").to_numpy()
        width = max(1, int(self.wanted.max())) if len(self.wanted) else 0
        self.scores = np.full((len(self.wanted), width), -np.inf)
        self.known = np.zeros(self.scores.shape, bool)  # item ids that are not null
        self.ids, self.id_type = None, None
        self.sizes = np.zeros(len(self.wanted), np.int64)
        self.bar = np.full(len(self.wanted), -np.inf)  # a score below it cannot be chosen any more
        if filtered:
            self.players = queries.column("players").to_numpy()
            self.minutes = _numbers(queries.column("max_minutes"))

    def meet(self, items: pa.Table, chosen: np.ndarray | None = None) -> None:
        """Compare the queries (those at the places ``chosen``, if given) with a chunk of items."""
        if items.num_rows == 0 or len(self.wanted) == 0:
            return
        units, _ = unit_rows(matrix(items.column("vector")))
        ids = items.column("item_id").combine_chunks()
        known = np.asarray(ids.is_valid())
        values = ids.fill_null("" if pa.types.is_string(ids.type) else 0).to_numpy(zero_copy_only=False)
        if self.ids is None:
            self.ids, self.id_type = np.zeros(self.scores.shape, values.dtype), ids.type
        order = np.lexsort((values, known))
        order = order[np.searchsorted(known[order], True) :]  # places of the known ids, in their order
        context = [_numbers(items.column(name)) for name in ("min_players", "max_players", "playing_time_minutes")] if self.filtered else None
        chosen = np.arange(len(self.wanted)) if chosen is None else chosen
        lengths = np.cumsum((self.ends - self.starts)[chosen])
        step = max(1, _CHUNK_CELLS // len(units))
        at = 0
        while at < len(chosen):
            # whole queries per slice; a slice holds at least one query
            before = lengths[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(lengths, before + step, side="right")))
            self._meet(chosen[at:stop], units, values, known, order, context, step)
            at = stop

    def _meet(self, rows: np.ndarray, units: np.ndarray, ids, known, order, context, step: int) -> None:
        scores = self._scores(rows, units, step)
        if context:
            low, high, time = context
            players, minutes = self.players[rows][:, None], self.minutes[rows][:, None]
            fits = (low[None, :] <= players) & (high[None, :] >= players)
            fits &= np.isnan(minutes) | (time[None, :] <= minutes)
            fits &= ~np.isnan(time)[None, :]
            scores[~fits] = -np.inf
        _mask(scores, self.queries.column("_skip"), rows, ids, order)
        bar = self.bar[rows]
        limit = int(min(self.scores.shape[1], scores.shape[1]))
        if limit < scores.shape[1] and np.isneginf(bar).any():
            # a score below this bar rounds to less than the limit's score
            best = np.partition(scores, scores.shape[1] - limit, axis=1)[:, scores.shape[1] - limit]
            bar = np.maximum(bar, best - 2.0 * 10.0**-SCORE_DIGITS)
        row, column = np.nonzero(scores >= np.maximum(bar, np.finfo(float).min)[:, None])
        if len(row):
            self._keep(rows[row], ids[column], known[column], np.round(scores[row, column], SCORE_DIGITS) + 0.0)

    def _scores(self, rows: np.ndarray, units: np.ndarray, step: int) -> np.ndarray:
        """Best similarity per query, in batches of ``step`` vectors."""
        lengths = self.ends[rows] - self.starts[rows]
        owner = np.repeat(np.arange(len(rows)), lengths)
        at = np.arange(len(owner)) + np.repeat(self.starts[rows] - np.cumsum(lengths) + lengths, lengths)
        if len(owner) == len(rows) and (lengths == 1).all():
            return self.vectors[at] @ units.T
        out = np.full((len(rows), len(units)), -np.inf)
        for begin in range(0, len(owner), step):
            part = self.vectors[at[begin : begin + step]] @ units.T
            own = owner[begin : begin + step]
            cuts = np.flatnonzero(np.diff(own, prepend=own[0] - 1, append=own[-1] + 1))
            for first, last in zip(cuts[:-1], cuts[1:]):  # much faster than one reduceat
                np.maximum(out[own[first]], part[first:last].max(axis=0), out=out[own[first]])
        return out

    def _keep(self, rows: np.ndarray, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        """Add candidates and cut the lists to their length; equal scores prefer lower ids."""
        touched = np.unique(rows)
        old = np.repeat(touched, self.sizes[touched])
        place = np.arange(len(old)) - np.searchsorted(old, old)
        rows, ids = np.append(old, rows), np.append(self.ids[old, place], ids)
        known, scores = np.append(self.known[old, place], known), np.append(self.scores[old, place], scores)
        order = np.lexsort((ids, known, -scores, rows))
        rows, ids, known, scores = rows[order], ids[order], known[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.wanted[rows]
        rows, place = rows[keep], place[keep]
        self.ids[rows, place], self.known[rows, place], self.scores[rows, place] = ids[keep], known[keep], scores[keep]
        self.sizes[touched] = np.searchsorted(rows, touched, side="right") - np.searchsorted(rows, touched)
        full = touched[(self.sizes[touched] == self.wanted[touched]) & (self.wanted[touched] > 0)]
        self.bar[full] = self.scores[full, self.wanted[full] - 1] - 2.0 * 10.0**-SCORE_DIGITS

    def table(self) -> pa.Table:
        """query_id, item_id, score, n_results of what was kept."""
        rows, place = np.nonzero(np.arange(self.scores.shape[1])[None, :] < self.sizes[:, None])
        taken = self.queries.select(["query_id", "n_results"]).take(pa.array(rows))
        ids = pa.array(self.ids[rows, place], self.id_type, mask=~self.known[rows, place])
        return pa.table({"query_id": taken.column("query_id"), "item_id": ids, "score": self.scores[rows, place], "n_results": taken.column("n_results")})


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_pandas().to_numpy(dtype=float, na_value=np.nan)


def _unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all rows, which hold one vector or a list of them, and the place of every row's first."""
    if not pa.types.is_list(column.type.value_type):
        return matrix(column), np.arange(len(column))
    lengths = np.asarray(column.combine_chunks().value_lengths())
    flat = pa.chunked_array([chunk.flatten() for chunk in column.chunks if len(chunk)])
    return matrix(flat), np.cumsum(lengths) - lengths


def _mask(scores: np.ndarray, skips: pa.ChunkedArray, rows: np.ndarray, ids: np.ndarray, order: np.ndarray) -> None:
    """Excluded items score -inf; ``order`` sorts the ids that are not null."""
    chosen = skips.take(pa.array(rows)).combine_chunks()
    if chosen.null_count == len(chosen) or not len(order):
        return
    lengths = np.asarray(chosen.value_lengths().fill_null(0))
    row = np.repeat(np.arange(len(rows)), lengths)
    banned = chosen.flatten().to_numpy(zero_copy_only=False)
    ordered = ids[order]
    at = np.searchsorted(ordered, banned)
    hit = (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == banned)
    scores[row[hit], order[at[hit]]] = -np.inf
