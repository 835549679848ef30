"""How similar each recommended item is to the user's own liked items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.blocks import cogroup_cells, iter_cells, keyed_cells, matrix, unit_rows
from shelfwise.operators.scoring import SCORE_DIGITS

# Fixed value: how many references a result shows.
MAX_REFERENCES = 3
# Similarities that a task holds at a time.
_CELLS = 1_000_000


def liked_similarities(
    ranked: DataFrame, liked: DataFrame, vectors: DataFrame, *, liked_rows: int | None = None
) -> DataFrame:
    """The best similarities of every ranked item to the liked items of its user.

    ``ranked``: request_id, user_id, rank, item_id. ``liked``: user_id, item_id,
    pos. ``vectors``: item_id, vector. Returns request_id, rank, liked_id, pos,
    sim, place (0 = most similar) and n, the number of comparable liked items;
    per result only the first ``rank + 3`` places, which is all the explanation
    rules can refer to. Items without a vector or with a zero vector do not
    compare. Requests of one user that share a result share its comparison.
    """
    known = vectors.select("item_id", "vector")
    results = ranked.groupBy("user_id", "item_id").agg(F.max("rank").alias("rank"))
    left = results.join(known, "item_id")
    right = liked.select("user_id", "item_id", "pos").join(known, "item_id")
    total = liked.count() if liked_rows is None else liked_rows
    left, right = keyed_cells(left, right, ["user_id"], ["item_id"], ["item_id"], total_rows=total)
    user_type = ranked.schema["user_id"].dataType.simpleString()
    item_type = liked.schema["item_id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        results, result_norms = unit_rows(matrix(left.column("vector")))
        targets, target_norms = unit_rows(matrix(right.column("vector")))
        ranks = left.column("rank").to_numpy()
        pos = right.column("pos").to_numpy()
        ids = right.column("item_id").to_numpy()
        out = {"left": [], "right": [], "sim": [], "n": []}
        for mine, theirs in iter_cells(left, right, ["user_id"]):
            mine, theirs = mine[result_norms[mine] > 0], theirs[target_norms[theirs] > 0]
            if not len(mine) or not len(theirs):
                continue
            theirs = theirs[np.lexsort((ids[theirs], pos[theirs]))]
            step = max(1, _CELLS // len(theirs))
            for begin in range(0, len(mine), step):
                part = mine[begin : begin + step]
                sims = np.round(results[part] @ targets[theirs].T, SCORE_DIGITS) + 0.0
                order = np.argsort(-sims, axis=1, kind="stable")
                for at, row in enumerate(part):
                    best = order[at, : ranks[row] + MAX_REFERENCES]
                    out["left"].append(np.full(len(best), row))
                    out["right"].append(theirs[best])
                    out["sim"].append(sims[at, best])
                    counted = np.zeros(len(best), dtype=np.int64)
                    counted[0] = len(theirs)
                    out["n"].append(counted)
        at = {
            name: np.concatenate(parts) if parts else np.zeros(0, np.float64 if name == "sim" else np.int64)
            for name, parts in out.items()
        }
        return pa.table(
            {
                "user_id": left.column("user_id").take(pa.array(at["left"])),
                "item_id": left.column("item_id").take(pa.array(at["left"])),
                "liked_id": right.column("item_id").take(pa.array(at["right"])),
                "pos": right.column("pos").take(pa.array(at["right"])),
                "sim": pa.array(at["sim"], pa.float64()),
                "n": pa.array(at["n"], pa.int64()),
            }
        )

    found = cogroup_cells(
        left,
        right,
        ["_b"],
        compare,
        f"user_id {user_type}, item_id {item_type}, liked_id {item_type}, pos int, sim double, n bigint",
    )
    result = Window.partitionBy("user_id", "item_id")
    best = result.orderBy(F.col("sim").desc(), "pos", "liked_id")
    placed = found.withColumns(
        {"place": (F.row_number().over(best) - 1).cast("int"), "n": F.sum("n").over(result)}
    )
    return (
        ranked.select("request_id", "user_id", "rank", "item_id")
        .join(placed, ["user_id", "item_id"])
        .filter(F.col("place") < F.col("rank") + MAX_REFERENCES)
        .select("request_id", "rank", "liked_id", "pos", "sim", "place", "n")
    )


def rotated(similarities: DataFrame, limit: int = MAX_REFERENCES) -> DataFrame:
    """The references a result shows: below rank 3 the choice rotates by rank."""
    shift = F.when(F.col("rank") > 2, F.col("rank") % F.col("n")).otherwise(F.lit(0))
    slot = F.pmod(F.col("place") - shift, F.col("n")).cast("int")
    return similarities.withColumn("slot", slot).filter(F.col("slot") < limit)
