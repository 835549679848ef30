"""Bounded cells for work that compares every left row with every right row.

Both sides are hashed into chunks of bounded size. A task compares chunks with
numpy and returns only what can still win (a local top-k), so pairs are never
rows. Each (left chunk, right chunk) pair may become one cell of a shuffle; where
many chunks meet, :func:`crossed` lets a task read the right chunks one after the
other instead, so that no row is written once per chunk of the other side.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import cut_lineage, parallelism

# Every row is read once per chunk of the other side: larger chunks read less, smaller ones hold less in a task.
LEFT_ROWS = 32768
RIGHT_ROWS = 32768
# The same for comparisons within one key, where few keys are larger than a chunk.
KEYED_LEFT, KEYED_RIGHT = 4096, 16384


@dataclass(frozen=True)
class Grid:
    left: int
    right: int


def plan_grid(df: DataFrame, n_left: int, n_right: int) -> Grid:
    """Chunk counts that bound every cell and still occupy the session's tasks."""
    right = max(1, math.ceil(n_right / RIGHT_ROWS))
    left = max(1, math.ceil(n_left / LEFT_ROWS))
    wanted = math.ceil(2 * parallelism(df.sparkSession) / right)
    return Grid(max(left, min(wanted, math.ceil(n_left / 16) or 1)), right)


def spread_left(df: DataFrame, grid: Grid, *ids: str) -> DataFrame:
    """Left rows in their chunk ``_l``, once per right chunk ``_r``."""
    return df.withColumns(
        {
            "_l": F.pmod(F.xxhash64(*ids), F.lit(grid.left)).cast("int"),
            "_r": F.explode(F.sequence(F.lit(0), F.lit(grid.right - 1))),
        }
    )


def spread_right(df: DataFrame, grid: Grid, item_id: str) -> DataFrame:
    """Right rows in their chunk ``_r``, once per left chunk ``_l``."""
    return df.withColumns(
        {
            "_r": right_chunk(item_id, grid),
            "_l": F.explode(F.sequence(F.lit(0), F.lit(grid.left - 1))),
        }
    )


def right_chunk(item_id: str, grid: Grid):
    return F.pmod(F.xxhash64(item_id), F.lit(grid.right)).cast("int")


def chunked(df: DataFrame, sort: str | None = None, rows: int | None = None) -> DataFrame:
    """(chunk): the rows of every partition packed as one table; of equal ``sort`` and at most ``rows``, if given."""

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batches[0].schema) as stream:
            stream.write_table(pa.Table.from_batches(batches).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, value = [], 0, None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                end = batch.num_rows
                if sort is not None:
                    own = batch.column(sort)[at].as_py()
                    if held and (own != value or size == rows):
                        yield packed(held)
                        held, size = [], 0
                    value = own
                    end = min(at + rows - size, int(np.searchsorted(batch.column(sort).to_numpy(), own, side="right")))
                held.append(batch.slice(at, end - at))
                size += end - at
                at = end
        if held:
            yield packed(held)

    return (df if sort is None else df.sortWithinPartitions(sort)).mapInArrow(pack, "chunk binary")


def right_chunks(df: DataFrame, grid: Grid, item_id: str) -> DataFrame:
    """The rows in their chunks, stored once for all left chunks."""
    return cut_lineage(chunked(df.repartition(grid.right, item_id)))


def crossed(left: DataFrame, right: DataFrame, grid: Grid, fn: Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """Run ``fn(left chunk, right chunks)`` for every partition of ``left`` and each share of the chunks ``right``
    (see :func:`chunked`); there are only as many shares as keep all tasks busy.

    A partition of ``left`` is one chunk. Nothing is shuffled: a task holds one left chunk and reads its right chunks in
    batches of some 64 MB (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch.column("other"), batch.column("chunk"), at) for batch in batches for at in range(batch.num_rows))
        first = next(rows, None)
        if first is not None:
            mine = _unpacked(first[0][first[2]])
            theirs = (_unpacked(chunk[at]) for _, chunk, at in itertools.chain([first], rows))
            for table in fn(mine, theirs):
                yield from table.combine_chunks().to_batches(max_chunksize=65536)

    # the left chunk goes to Python with the first right chunk of a task only
    shares = max(1, min(grid.right, math.ceil(2 * parallelism(left.sparkSession) / grid.left)))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    streamed = right.coalesce(shares).select("chunk", (place == 0).alias("first")).hint("shuffle_replicate_nl")
    pairs = streamed.crossJoin(chunked(left).withColumnRenamed("chunk", "other"))
    return pairs.select(F.when(F.col("first"), F.col("other")).alias("other"), "chunk").mapInArrow(compare, schema)


def _unpacked(chunk: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(chunk.as_buffer()).read_all()


def keyed_cells(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    right_id: Sequence[str],
    *,
    total_rows: int,
    left_rows: int = KEYED_LEFT,
    right_rows: int = KEYED_RIGHT,
) -> tuple[DataFrame, DataFrame]:
    """Cells for comparisons within equal keys, whatever the size of one key.

    Keys larger than a chunk (few, at most rows / chunk size of them) are split
    on both sides; all cells are then packed into evenly filled buckets ``_b``.
    """
    keys = list(keys)

    def hot(df: DataFrame, rows: int, name: str) -> DataFrame:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return counts.filter(F.col("_n") > rows).select(
            *keys, F.ceil(F.col("_n") / F.lit(rows)).cast("int").alias(name)
        )

    hot_left, hot_right = hot(left, left_rows, "_nl"), hot(right, right_rows, "_nr")
    n_left, n_right = F.coalesce("_nl", F.lit(1)), F.coalesce("_nr", F.lit(1))
    buckets = max(2 * parallelism(left.sparkSession), total_rows // 65536)

    def cells(df: DataFrame, own: str, ids: Sequence[str], n_own, other: str, n_other) -> DataFrame:
        joined = df.join(hot_left, keys, "left").join(hot_right, keys, "left")
        placed = joined.withColumns(
            {
                own: F.pmod(F.xxhash64(*ids), n_own).cast("int"),
                other: F.explode(F.sequence(F.lit(0), n_other - 1)),
            }
        )
        return placed.drop("_nl", "_nr").withColumn(
            "_b", F.pmod(F.xxhash64(*keys, "_l", "_r"), F.lit(buckets)).cast("int")
        )

    return (
        cells(left, "_l", left_id, n_left, "_r", n_right),
        cells(right, "_r", right_id, n_right, "_l", n_left),
    )


def cogroup_cells(left: DataFrame, right: DataFrame, cell: Sequence[str] | Grid, fn, schema: str) -> DataFrame:
    """Run ``fn(left table, right table)`` on every cell; with a grid, every left chunk meets every right chunk, see :func:`crossed`."""
    if isinstance(cell, Grid):
        return crossed(left, right, cell, fn, schema)
    # fresh column identities, since both sides may derive from the same table
    left, right = (df.select(*[F.col(name).alias(name) for name in df.columns]) for df in (left, right))
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(fn, schema)


def iter_cells(
    left: pa.Table, right: pa.Table, keys: Sequence[str]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions of the two sides for every cell present on both."""
    names = [*keys, "_l", "_r"]
    left_at = left.select(names).to_pandas().groupby(names).indices
    right_at = right.select(names).to_pandas().groupby(names).indices
    for key, rows in left_at.items():
        if key in right_at:
            yield rows, right_at[key]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a two-dimensional float array."""
    if len(column) == 0:
        return np.zeros((0, 0))
    values = pa.concat_arrays([chunk.flatten() for chunk in column.chunks if len(chunk)])
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def unit_rows(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 (zero rows stay zero) and their original lengths."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(lengths == 0, 1.0, lengths)[:, None], lengths
