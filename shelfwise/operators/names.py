"""Nearest catalog names by edit distance, exact for any number of names.

Names are found through inverted lists of their letter pairs: an edit changes at most two pairs, so the pairs that two texts
have in common bound their distance from below, and names are compared in the order of that bound, in growing parts, until no
unseen name can win. The lists belong to one cell of targets x names, so they are bounded like the cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import missing_message
from shelfwise.operators.blocks import cogroup_cells, plan_grid, spread_left, spread_right

SUGGESTIONS = 3
PART_CELLS = 1_000_000
# Names compared at first, before the bound of the others is looked at again.
FIRST_PART = 32


def _codes(points: list[np.ndarray]) -> np.ndarray:
    """Code points of some texts, padded into one matrix."""
    out = np.full((len(points), max((len(point) for point in points), default=0)), -1, dtype=np.int32)
    for row, point in enumerate(points):
        out[row, : len(point)] = point
    return out


def _parts(lengths: np.ndarray):
    """Cut a visit into parts whose padded matrices stay small, however long a name is."""
    begin, part = 0, FIRST_PART
    while begin < len(lengths):
        size = part
        part = min(2 * part, 2048)
        while size > 1 and size * (lengths[begin : begin + size].max() + 1) > PART_CELLS:
            size //= 2
        yield slice(begin, begin + size)
        begin += size


def _pairs(point: np.ndarray) -> np.ndarray:
    """Letter pairs of a text, numbered where they repeat, so that common ones count as often as in both."""
    codes = np.sort(point[:-1].astype(np.int64) << 21 | point[1:])
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    repeat = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    # beyond 63 repeats a pair counts too often, which only lowers the bound
    return codes << 6 | np.minimum(repeat, 63)


class PairIndex:
    """Inverted lists from letter pairs to texts."""

    def __init__(self, points: list[np.ndarray]) -> None:
        self.lengths = np.array([len(point) for point in points], dtype=np.int64)
        pairs = [_pairs(point) for point in points]
        owners = np.repeat(np.arange(len(points)), [len(p) for p in pairs])
        codes = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.owners = codes[order], owners[order]

    def least_distances(self, point: np.ndarray) -> np.ndarray:
        """A lower bound of the edit distance of a text to every indexed one, from pairs and lengths."""
        pairs = _pairs(point)
        low, high = np.searchsorted(self.codes, pairs, "left"), np.searchsorted(self.codes, pairs, "right")
        hits = [self.owners[a:b] for a, b in zip(low, high, strict=True) if a < b]
        common = np.bincount(np.concatenate(hits), minlength=len(self.lengths)) if hits else np.zeros(len(self.lengths), np.int64)
        missing = np.maximum(self.lengths, len(point)) - 1 - common
        return np.maximum(np.abs(self.lengths - len(point)), -(-missing // 2))


def edit_distances(text: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distance of one text to every coded text, all at once."""
    width = codes.shape[1]
    ramp = np.arange(width + 1)
    row = np.tile(ramp, (len(codes), 1))
    for at, letter in enumerate(text, start=1):
        step = np.empty_like(row)
        step[:, 0] = at
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (codes != ord(letter)))
        # insertions: a running minimum along the row, each step costing one
        row = np.minimum.accumulate(step - ramp, axis=1) + ramp
    return row[np.arange(len(codes)), lengths]


def nearest_names(
    targets: DataFrame,
    catalog: DataFrame,
    *,
    limit: int = SUGGESTIONS,
    n_targets: int | None = None,
    n_names: int | None = None,
) -> DataFrame:
    """(target, item_id, name, distance, place): the closest names of each target.

    Names compare in lower case; equal distances keep catalog (id) order. Only
    the local winners of a cell of targets x names leave its task. Within a cell
    names are visited by a growing lower bound of the distance, and the visit
    ends once no unseen name can win.
    """
    order = Window.partitionBy("target").orderBy("distance", "item_id")
    found = _winners(targets, catalog, limit, n_targets, n_names).select("target", "item_id", "name", "distance")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def name_comparisons(targets: DataFrame, catalog: DataFrame, *, limit: int = SUGGESTIONS) -> DataFrame:
    """(target, n_names, n_compared): how many names there are and how many distances :func:`nearest_names` computes."""
    cells = _winners(targets, catalog, limit, None, None).groupBy("target", "cell").agg(
        F.max("names").alias("names"), F.max("compared").alias("compared")
    )
    return cells.groupBy("target").agg(F.sum("names").alias("n_names"), F.sum("compared").alias("n_compared"))


def _winners(targets: DataFrame, catalog: DataFrame, limit: int, n_targets: int | None, n_names: int | None) -> DataFrame:
    """The local winners of every cell, with the names in it and the distances computed for the target."""
    wanted = targets.select("target").distinct()
    names = catalog.select("item_id", "name").filter(F.col("name") != "")
    grid = plan_grid(
        wanted,
        wanted.count() if n_targets is None else n_targets,
        names.count() if n_names is None else n_names,
    )
    left = spread_left(wanted.withColumn("lowered", F.lower("target")), grid, "target")
    right = spread_right(names.withColumn("lowered", F.lower("name")), grid, "item_id")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("item_id")
        points = [np.fromiter(map(ord, text), np.int32, len(text)) for text in right.column("lowered").to_pylist()]
        index = PairIndex(points)
        lengths = index.lengths
        rows, columns, distances, compared = [], [], [], []
        for row, text in enumerate(left.column("lowered").to_pylist()):
            least = index.least_distances(np.fromiter(map(ord, text), np.int32, len(text)))
            visit = np.argsort(least, kind="stable")
            best_at, best, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            for cut in _parts(lengths[visit]):
                part = visit[cut]
                if len(best) == limit and least[part[0]] > best[-1]:
                    break
                # the part may reach past the names that can still win
                part = part[: np.searchsorted(least[part], best[-1], "right")] if len(best) == limit else part
                seen += len(part)
                at = np.concatenate([best_at, part])
                codes = _codes([points[name] for name in part])
                found = np.concatenate([best, edit_distances(text, codes, lengths[part])])
                order = np.lexsort((at, found))[:limit]
                best_at, best = at[order], found[order]
            rows.extend([row] * len(best))
            columns.extend(best_at)
            distances.extend(best)
            compared.extend([seen] * len(best))
        at = pa.array(columns, pa.int64())
        return pa.table(
            {
                "target": left.column("target").take(pa.array(rows, pa.int64())),
                "item_id": right.column("item_id").take(at),
                "name": right.column("name").take(at),
                "distance": pa.array(distances, pa.int32()),
                "cell": right.column("_r").take(at),
                "names": pa.array(np.full(len(rows), len(points)), pa.int64()),
                "compared": pa.array(compared, pa.int64()),
            }
        )

    item_type = catalog.schema["item_id"].dataType.simpleString()
    schema = f"target string, item_id {item_type}, name string, distance int, cell int, names bigint, compared bigint"
    return cogroup_cells(left, right, ["_l", "_r"], compare, schema)


def missing_report(missing: DataFrame, catalog: DataFrame, prefix: str, **sizes) -> DataFrame:
    """One message row per group of missing names (group, pos, target)."""
    nearest = (
        nearest_names(missing, catalog, **sizes)
        .groupBy("target")
        .agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("s"))
        .select("target", F.transform("s", lambda s: s["name"]).alias("closest"))
    )
    parts = missing.join(nearest, "target", "left").select(
        "group",
        "pos",
        missing_message(F.col("target"), F.coalesce("closest", F.array().cast("array<string>"))).alias("part"),
    )
    return parts.groupBy("group").agg(
        F.concat(
            F.lit(f"{prefix}: "),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda p: p["part"]), "; "
            ),
        ).alias("message")
    )
