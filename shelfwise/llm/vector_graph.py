"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping shards.

1. *Shards.* Vectors of one label are split into cells by spherical k-means (fitted on at most about ``SAMPLE`` vectors of a cell),
   level by level until a cell has at most ``CELL`` vectors. A vector lives in its nearest cell and, as an overlap,
   in the next nearest ones. Seeds are kept apart, so that a mass of near copies is not torn between cells; a cell that
   stays too large is dealt into parts by hash, and its vectors search all its parts.
2. *Graph.* Inside a shard every vector keeps edges to a robust-pruned choice of its nearest neighbours, and the reverse edges.
   The adjacency lists of a vector are united over the shards it lives in.
3. *Search.* Every vector is a query against the shards of its cells: a greedy beam search starts at the shard's medoid; from all vectors found
   within the range (and a little beyond) the search expands along the edges until it finds nothing new.
4. *Verify and audit.* A link counts only if the cosine in double precision reaches the threshold. At most ``AUDIT`` vectors, drawn by hash, are
   compared with all vectors; if the mean recall of those with links is below ``RECALL``, everything is done again with more overlap and
   a wider beam (``ATTEMPTS`` times at most). The measured recall is returned.

Exact copies (same label and components) are one vector with a count from the start. A pair that shares several cells is counted in
the first of them only. Links inside a task leave it as one row per vector, never as pairs.

Null ids, null labels, null, empty and zero vectors and vectors with null or non-finite components link with nothing and
form a component of their own. Vectors of different length never link. Vectors are known by their content: rows that share an id but not
a vector count links each for its own vector and form one component, under the smallest id that is reachable. A row with a null id
has no links of its own, and none to others are counted for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.frames import empty, pick, stored

CELL = 1024
SAMPLE = 2048
FANOUT = 32
LEVELS = 8
DEGREE = 24
ALPHA = 1.2
BEAM = 32
AUDIT = 128
RECALL = 0.98
ATTEMPTS = 3
#: Queries that are searched at a time, and entries of a gathered table of neighbours.
SLICE = 256
GATHERED = 1 << 20
#: How far below the threshold a found vector may be and still be expanded.
SLACK = 0.08


def units(vectors) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that squares neither vanish nor overflow."""
    x = np.array(list(vectors), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centres(x: np.ndarray, wanted: int, apart: float = 0.85, rounds: int = 8) -> np.ndarray:
    """Spherical k-means whose seeds are farthest-first and at most ``apart`` alike."""
    chosen = [0]
    nearest = x @ x[0]
    while len(chosen) < wanted:
        far = int(nearest.argmin())
        if nearest[far] > apart:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, x @ x[far])
    centres = x[chosen]
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _centres(batch: pd.DataFrame) -> pd.DataFrame:
    x = units(batch["vec"])
    wanted = int(min(FANOUT, max(2, -(-2 * batch["n"].iloc[0] // CELL))))
    order = np.argsort(batch["rep"].to_numpy(), kind="stable")
    centres = fit_centres(x[order], wanted)
    return pd.DataFrame({"cell": [batch["cell"].iloc[0]], "centres": [centres.ravel()]})


def _assign(overlap: int):
    def assign(rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        columns = ["rep", "vec", "copies", "cell", "home", "child"]
        if not len(rows):
            return pd.DataFrame(columns=columns)
        x = units(rows["vec"])
        centres = np.array(fitted["centres"].iloc[0]).reshape(-1, x.shape[1])
        order = np.argsort(-(x @ centres.T), axis=1, kind="stable")
        parts = []
        for place in range(min(1 + overlap, order.shape[1])):
            own = rows if place == 0 else rows[rows["home"]]
            part = own[["rep", "vec", "copies", "cell"]].copy()
            part["home"] = own["home"] & (place == 0)
            part["child"] = order[: len(rows), place] if place == 0 else order[rows["home"].to_numpy(bool), place]
            parts.append(part)
        return pd.concat(parts)[columns]

    return assign


def cells(vectors: DataFrame, overlap: int) -> DataFrame:
    """Members of every cell: rep, vec, copies, cell, home. ``vectors`` has rep, label, vec, copies."""
    kind = "rep long, vec array<double>, copies long, cell long, home boolean, child int"
    members = vectors.select(
        "rep", F.col("vec").cast("array<double>").alias("vec"), "copies",
        F.xxhash64(F.col("label").cast("string"), F.size("vec")).alias("cell"), F.lit(True).alias("home"),
    )
    done: DataFrame | None = None
    for _ in range(LEVELS):
        sizes = stored(members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
        large = sizes.filter(F.col("n") > CELL)
        if not large.limit(1).count():
            break
        small = members.join(large.select("cell"), "cell", "left_anti").select("rep", "vec", "copies", "cell", "home")
        open_rows = members.join(large, "cell").select("rep", "vec", "copies", "cell", "home", "n")
        draw = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
        fitted = open_rows.filter(draw * F.col("n") < SAMPLE).groupBy("cell").applyInPandas(_centres, "cell long, centres array<double>")
        fitted = stored(fitted)
        chunks = F.ceil(F.col("n") / (4 * CELL)).cast("int")
        left = open_rows.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(2)), chunks).cast("int")).drop("n")
        right = fitted.join(large, "cell").select("cell", "centres", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        right = right.toDF(*right.columns)
        split = left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInPandas(_assign(overlap), kind)
        split = stored(split.withColumn("cell", F.xxhash64("cell", "child")).drop("child"))
        small = stored(small)
        done = small if done is None else done.union(small)
        before, members = large.agg(F.sum("n")).first()[0], split
        after = split.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).agg(F.sum("n")).first()[0] or 0
        if after > 0.9 * before * (1 + overlap):  # what is left are near copies: dealt by hash instead
            break
    return members if done is None else done.union(members)


def prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust-pruned neighbours of every row with their reverse edges, as indices padded by -1.

    A candidate falls if a chosen neighbour is nearer to it, by the factor ``alpha``, than the vector itself is.
    """
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1)
    width = min(n - 1, 3 * degree)
    like = x @ x.T
    np.fill_diagonal(like, -np.inf)
    near = np.concatenate([np.argpartition(-like[at : at + SLICE], width - 1, axis=1)[:, :width] for at in range(0, n, SLICE)])
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(like, near, 1), axis=1, kind="stable"), 1)
    own = 2 - 2 * np.take_along_axis(like, near, 1)
    chosen = np.zeros((n, width), bool)
    for start in range(0, n, SLICE):
        rows = slice(start, min(n, start + SLICE))
        between = 2 - 2 * like[near[rows][:, :, None], near[rows][:, None, :]]
        alive, kept = np.ones(near[rows].shape, bool), chosen[rows]
        for place in range(width):
            take = alive[:, place] & (kept.sum(axis=1) < degree)
            kept[take, place] = True
            alive[take] &= ~(alpha * alpha * between[take, place] <= own[rows][take])
    edges = np.zeros((n, n), bool)
    rows, places = np.nonzero(chosen)
    edges[rows, near[rows, places]] = True
    edges[near[rows, 0], np.arange(n)[rows]] |= chosen[rows, 0]
    edges |= edges.T & (edges.T.sum(axis=1, keepdims=True) <= 4 * degree)
    edges[np.arange(n), near[:, 0]] = edges[near[:, 0], np.arange(n)] = True
    width = int(edges.sum(axis=1).max())
    padded = np.full((n, width), -1)
    rows, columns = np.nonzero(edges)
    padded[rows, np.concatenate([np.arange(k) for k in edges.sum(axis=1)])] = columns
    return padded


def _build(batch: pd.DataFrame) -> pd.DataFrame:
    batch = batch.sort_values("rep")
    reps = batch["rep"].to_numpy(np.int64)
    graph = prune(units(batch["vec"]))
    return pd.DataFrame({"rep": reps, "cell": batch["cell"].to_numpy(), "adjacent": [reps[row[row >= 0]] for row in graph]})


def search(x: np.ndarray, y: np.ndarray, graph: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """For queries ``x`` and indexed ``y``: a boolean matrix of the pairs found with a cosine of at least ``threshold``."""
    q, n, low = len(x), len(y), threshold - SLACK
    every = np.arange(q)
    medoid = int((y @ y.mean(axis=0)).argmax())
    seen, found, linked = np.zeros((q, n), bool), np.zeros((q, n), bool), np.zeros((q, n), bool)
    ids, likes, used = np.zeros((q, beam), np.int64), np.full((q, beam), -np.inf), np.ones((q, beam), bool)
    ids[:, 0], likes[:, 0], used[:, 0] = medoid, x @ y[medoid], False
    seen[:, medoid] = True
    found[:, medoid], linked[:, medoid] = likes[:, 0] >= low, likes[:, 0] >= threshold
    while True:  # greedy: expand the best open candidate of every query
        best = np.where(used, -np.inf, likes).argmax(axis=1)
        rows = every[~used[every, best]]
        if not len(rows):
            break
        best = best[rows]
        used[rows, best] = True
        near = graph[ids[rows, best]]
        new = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(new)
        v = near[r, c]
        r_all = rows[r]
        seen[r_all, v] = True
        value = np.einsum("ij,ij->i", x[r_all], y[v])
        found[r_all, v], linked[r_all, v] = value >= low, value >= threshold
        more = np.full(near.shape, -np.inf)
        more[r, c] = value
        all_likes = np.concatenate([likes[rows], more], axis=1)
        all_ids = np.concatenate([ids[rows], np.maximum(near, 0)], axis=1)
        all_used = np.concatenate([used[rows], ~new], axis=1)
        top = np.argpartition(-all_likes, beam - 1, axis=1)[:, :beam]
        likes[rows], ids[rows], used[rows] = (np.take_along_axis(a, top, 1) for a in (all_likes, all_ids, all_used))
    open_ = found.copy()
    while open_.any():  # range: expand everything found near the threshold
        r, c = np.nonzero(open_)
        reach = np.zeros((q, n), bool)
        step = max(1, GATHERED // graph.shape[1])
        for start in range(0, len(r), step):
            near = graph[c[start : start + step]]
            reach[np.broadcast_to(r[start : start + step, None], near.shape)[near >= 0], near[near >= 0]] = True
        reach &= ~seen
        seen |= reach
        r, c = np.nonzero(reach)
        open_ = np.zeros((q, n), bool)
        step = max(1, GATHERED // x.shape[1])
        for start in range(0, len(r), step):
            a, b = r[start : start + step], c[start : start + step]
            value = np.einsum("ij,ij->i", x[a], y[b])
            open_[a, b], linked[a, b] = value >= low, value >= threshold
    return linked


def _links(threshold: float, beam: int):
    def links(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        columns = ["rep", "n", "root"]
        if not len(queries) or not len(nodes):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        queries, nodes = queries.sort_values("rep"), nodes.sort_values("rep")
        q_ids, n_ids = queries["rep"].to_numpy(np.int64), nodes["rep"].to_numpy(np.int64)
        width = max(map(len, nodes["adjacent"]))
        graph = np.full((len(n_ids), max(1, width)), -1)
        for row, others in zip(graph, nodes["adjacent"], strict=True):
            at = np.searchsorted(n_ids, others)
            at = at[n_ids[np.minimum(at, len(n_ids) - 1)] == others]
            row[: len(at)] = at
        x, y = units(queries["vec"]), units(nodes["vec"])
        wide = min(beam, max(1, len(n_ids)))
        linked = np.concatenate([search(x[at : at + SLICE], y, graph, threshold, wide) for at in range(0, len(x), SLICE)])
        linked &= q_ids[:, None] != n_ids[None, :]
        # a pair that shares cells is counted in the smallest of them
        cell = int(queries["cell"].iloc[0])
        first = np.ones(linked.shape, bool)
        smaller_q = [frozenset(int(c) for c in cs if c < cell) for cs in queries["cells"]]
        smaller_n = [frozenset(int(c) for c in cs if c < cell) for cs in nodes["cells"]]
        with_smaller = [(j, s) for j, s in enumerate(smaller_n) if s]
        if with_smaller and any(smaller_q):
            names = {c: k for k, c in enumerate(sorted(set().union(*smaller_q, *smaller_n)))}
            has_q, has_n = np.zeros((len(q_ids), len(names)), np.float32), np.zeros((len(n_ids), len(names)), np.float32)
            for has, sets in ((has_q, smaller_q), (has_n, smaller_n)):
                for i, s in enumerate(sets):
                    has[i, [names[c] for c in s]] = 1
            first = has_q @ has_n.T == 0
        counts = (linked & first) @ nodes["copies"].to_numpy(np.int64)
        ids = np.unique(np.concatenate([q_ids, n_ids]))
        r, c = np.nonzero(linked)
        left, right = np.searchsorted(ids, q_ids)[r], np.searchsorted(ids, n_ids)[c]
        label = np.arange(len(ids))
        while len(left):
            low = np.minimum(label[left], label[right])
            before = label.copy()
            np.minimum.at(label, left, low)
            np.minimum.at(label, right, low)
            label = label[label]
            if (label == before).all():
                break
        roots = pd.DataFrame({"rep": ids, "n": 0, "root": ids[label]})
        roots = roots[roots["rep"] != roots["root"]]
        return pd.concat([pd.DataFrame({"rep": q_ids, "n": counts, "root": q_ids}), roots])[columns]

    return links


def find_links(vectors: DataFrame, threshold: float, overlap: int, beam: int) -> DataFrame:
    """Per vector and shard: rep, n (linked vectors counted there), root (a smaller id in the same component, or itself)."""
    members = stored(cells(vectors, overlap))
    sizes = stored(members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / float(2 * CELL)).cast("int").alias("parts")))
    dealt = members.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int"))
    built = dealt.select("rep", "vec", "cell", "part").groupBy("cell", "part").applyInPandas(_build, "rep long, cell long, adjacent array<long>")
    united = stored(
        built.groupBy("rep").agg(
            F.array_distinct(F.flatten(F.collect_list("adjacent"))).alias("adjacent"), F.sort_array(F.collect_set("cell")).alias("cells")
        )
    )
    placed = dealt.join(united, "rep")
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    queries = placed.select("cell", "rep", "vec", "cells", F.col("part").alias("chunk"), every_part.alias("part"))
    nodes = placed.select("cell", "part", "rep", "vec", "cells", "adjacent", "copies", every_part.alias("chunk"))
    queries, by = queries.toDF(*queries.columns), ("cell", "part", "chunk")
    return queries.groupBy(*by).cogroup(nodes.groupBy(*by)).applyInPandas(_links(threshold, beam), "rep long, n long, root long")


def audit(vectors: DataFrame, counts: DataFrame, threshold: float, rows: int = AUDIT) -> float:
    """Mean share of the true links found, over at most ``rows`` vectors: each is compared with every vector."""
    drawn = vectors.orderBy(F.xxhash64("rep", F.lit(9))).limit(rows).select("rep", "label", "vec", "copies").collect()
    if not drawn:
        return 1.0
    labels, ids = [row["label"] for row in drawn], np.array([row["rep"] for row in drawn])
    sample = [np.array(row["vec"], np.float64) for row in drawn]

    def exact(batches):
        totals = np.zeros(len(ids), np.int64)
        for batch in batches:
            for i in range(len(ids)):
                own = batch[(batch["label"] == labels[i]) & (batch["rep"] != ids[i]) & (batch["vec"].map(len) == len(sample[i]))]
                if len(own):
                    near = units(own["vec"]) @ units([sample[i]])[0] >= threshold
                    totals[i] += int(own["copies"].to_numpy()[near].sum())
        yield pd.DataFrame({"rep": ids, "true": totals})

    truth = vectors.select("rep", "label", "vec", "copies").mapInPandas(exact, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))
    # every vector weighs the same, so a mass of near copies does not hide what others miss
    compared = truth.filter(F.col("true") > 0).join(counts, "rep", "left").agg(F.avg(F.least("true", F.coalesce("n", F.lit(0))) / F.col("true")).alias("share")).first()
    return 1.0 if compared["share"] is None else float(compared["share"])


def near_duplicate_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    overlap: int = 1, beam: int = BEAM,
) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept, audit_recall (of the attempt that was taken)."""
    table = pick(embeddings, vec_id=id_col, vec=vector_col, label=label_col)
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & finite, F.lit(False))
    rows = stored(table.withColumn("vec", F.when(sound, F.col("vec"))).withColumn("same", F.when(sound, F.xxhash64("vec", "label"))))
    vectors = rows.filter("same is not null").groupBy("same", "label", "vec").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("copies"))
    # numbers given when the table is written hold from then on; sorted, so that reruns draw the same vectors
    vectors = stored(vectors.sortWithinPartitions("same", "name").select("label", "vec", "copies", "same", "name", F.monotonically_increasing_id().alias("rep")))
    for attempt in range(ATTEMPTS):
        found = stored(find_links(vectors, threshold, overlap + attempt, beam << attempt))
        counts = stored(found.groupBy("rep").agg(F.sum("n").alias("n")))
        recall = audit(vectors, counts, threshold)
        if recall >= RECALL:
            break
    match = (F.col("same") == F.col("_same")) & (F.col("label") == F.col("own_label")) & (F.col("vec") == F.col("own"))
    content = vectors.select("rep", F.col("same").alias("_same"), F.col("vec").alias("own"), F.col("label").alias("own_label"))
    links = found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    # an id with different vectors joins them
    ids = rows.filter("same is not null").groupBy("vec_id").agg(F.min(F.struct("same", "label", "vec")).alias("low"), F.max(F.struct("same", "label", "vec")).alias("high"))
    ids = stored(ids.filter("low <> high").select("vec_id"))
    if not empty(ids):
        named = stored(rows.filter("same is not null").join(ids, "vec_id").join(content, match).select("vec_id", "rep").distinct())
        first = named.groupBy("vec_id").agg(F.min("rep").alias("b"))
        links = links.union(named.join(first, "vec_id").select(F.col("rep").alias("a"), "b"))
    grouped = components(links).withColumnRenamed("node", "rep")
    placed = stored(vectors.join(grouped, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    names = placed.groupBy("component").agg(F.min("name").alias("smallest"))
    known = placed.join(names, "component").join(counts, "rep", "left").select(
        F.col("same").alias("_same"), F.col("vec").alias("own"), F.col("label").alias("own_label"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("smallest").alias("component"),
    )
    known = stored(known)
    joined = rows.select("vec_id", "same", "label", "vec").join(known, match, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    result = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audit_recall", F.lit(recall))
