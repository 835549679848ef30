import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.config import OFFLINE_PRESET, SERVICE_PRESET, SINGLE_CENTROID, Preferences
from shelfwise.functions import numbers as N
from shelfwise.operators import blocks as B
from shelfwise.operators import preferences as P
from shelfwise.operators import scoring as R
from shelfwise.plans import recommend as plan

ITEMS = [
    (1, "Alpha", 7.5, 1, 4, 60, [1.0, 0.0]),
    (2, "Beta", 7.0, 2, 4, 45, [1.0, 0.0]),
    (3, "Gamma", None, 2, 5, 30, [0.5, 0.5]),
    (4, "Delta", 8.2, 3, 5, 120, [0.0, 1.0]),
    (5, "Epsilon", 6.1, 1, 3, 20, [0.2, 0.8]),
]
SCHEMA = "item_id bigint, name string, avg_rating double, min_players int, max_players int, playing_time_minutes int, vector array<double>"


@pytest.fixture()
def items(spark):
    return spark.createDataFrame(ITEMS, SCHEMA)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id string, user_id bigint, players int, max_minutes int, num_results int")


def likes(spark, *pairs):
    return spark.createDataFrame(list(pairs), "user_id bigint, item_id bigint")


def ids(df, request="r"):
    return [r["item_id"] for r in df.filter(F.col("request_id") == request).orderBy("rank").collect()]


def test_prefilter(spark, items):
    liked = likes(spark, (1, 1))
    asked = requests(spark, ("r", 1, 2, 60, 10), ("short", 1, 2, 5, 10), ("any", 1, 3, None, 1))
    done = plan.recommend_prefiltered(asked, liked, items)
    assert ids(done) == [2, 3, 5]
    assert ids(done, "short") == []
    assert ids(done, "any") == [2]
    shown = plan.format_results(done.join(items.drop("vector"), "item_id"))
    assert {r["item_id"]: r["avg_rating"] for r in shown.filter("request_id = 'r'").collect()}[3] == 0.0


def test_max_and_mean_choose_different_winners(spark, items):
    centers = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id bigint, vector array<double>")
    pool = items.filter("item_id in (2, 3)")
    first = {}
    for how in ("max", "mean"):
        queries = R.directions(centers, how).withColumn("n_results", F.lit(1))
        first[how] = R.top_items(queries, pool, aggregation=how).first()["item_id"]
    assert first == {"max": 2, "mean": 3}
    with pytest.raises(ValueError):
        Preferences(aggregation="median")


def test_scores_stay_with_their_items(spark):
    store = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.1, 0.9])], "item_id bigint, vector array<double>")
    done = plan._score_requests(
        spark.createDataFrame([("r", 1, 2)], "request_id string, user_id bigint, num_results int"),
        likes(spark, (1, 1)), store, SERVICE_PRESET, [], 1,
    )
    assert ids(done) == [3, 2]


def test_zero_vectors_score_zero(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "item_id bigint, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0], 5)], "query_id bigint, vector array<double>, n_results int")
    got = [(r["item_id"], r["score"]) for r in R.top_items(queries, store).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.0), (3, -1.0)]


def test_unknown_liked_items_drop_out(spark, items):
    done = plan.recommend_prefiltered(requests(spark, ("r", 1, 2, 60, 10), ("n", 2, 2, 60, 3)), likes(spark, (1, 1), (1, 99), (2, 99)), items)
    assert ids(done) == [2, 3, 5] and ids(done, "n") == []


@pytest.mark.parametrize("aggregation", ["mean", "max"])
def test_brute_force_with_tiny_blocks(spark, monkeypatch, aggregation):
    """Many small cells, a hot user and tied vectors give the plain answer."""
    monkeypatch.setattr(B, "LEFT_ROWS", 5)
    monkeypatch.setattr(B, "RIGHT_ROWS", 7)
    monkeypatch.setattr(R, "_CHUNK_CELLS", 20)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 6)).round(2)
    vectors[10:20] = vectors[3]
    vectors[5] = 0
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "item_id bigint, vector array<double>")
    owned = {u: rng.choice(60, size=40 if u == 0 else 3, replace=False).tolist() for u in range(12)}
    liked = spark.createDataFrame([(u, i) for u, picks in owned.items() for i in picks], "query_id bigint, item_id bigint")
    queries = R.directions(liked.join(store, "item_id"), aggregation).withColumn("n_results", (5 + F.col("query_id") % 3).cast("int"))
    got = {}
    for row in R.top_items(queries, store, aggregation=aggregation, exclude=liked).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["item_id"], round(row["score"], 9)))
    unit = vectors / np.where(np.linalg.norm(vectors, axis=1) == 0, 1, np.linalg.norm(vectors, axis=1))[:, None]
    for user, picks in owned.items():
        sims = unit @ unit[picks].T
        score = np.round(sims.max(axis=1) if aggregation == "max" else sims.mean(axis=1), 12) + 0.0
        order = [i for i in sorted(range(60), key=lambda i: (-score[i], i)) if i not in picks][: 5 + user % 3]
        assert [(n, i, round(float(score[i]), 9)) for n, i in enumerate(order)] == sorted(got[user])


def test_excluded_items_travel_once_per_query(spark, monkeypatch):
    """With several vectors a query, the items it may not get are not sent with each of them."""
    liked = spark.createDataFrame([(1, i) for i in range(200)], "query_id bigint, item_id bigint")
    store = spark.range(300).select(F.col("id").alias("item_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector"))
    sent = {}

    def cells(left, right, keys, fn, schema):
        sent.update(left.agg(F.count("*").alias("rows"), F.sum(F.size("_skip")).alias("skips")).first().asDict())
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(R, "cogroup_cells", cells)
    R.top_items(R.directions(liked.join(store, "item_id"), "max").withColumn("n_results", F.lit(5)), store, aggregation="max", exclude=liked)
    assert sent == {"rows": 1, "skips": 200}


def test_partitioning_does_not_matter(spark, items):
    liked, asked = likes(spark, (1, 1), (1, 4), (2, 5)), requests(spark, ("r", 1, 3, None, 3), ("s", 2, 3, None, 3))
    one = plan.recommend_prefiltered(asked.coalesce(1), liked.coalesce(1), items.coalesce(1))
    many = plan.recommend_prefiltered(asked.repartition(5), liked.repartition(7), items.repartition(3))
    key = lambda df: sorted(tuple(r) for r in df.select("request_id", "rank", "item_id", "score").collect())
    assert key(one) == key(many)
    alone = plan.recommend_prefiltered(asked.filter("request_id = 's'"), liked, items)
    assert ids(alone, "s") == ids(many, "s")


def test_postfilter_overfetch(spark, items):
    asked = spark.createDataFrame([("r", 1, 3, "short", 1)], "request_id string, user_id bigint, players int, duration string, num_results int")
    catalog = items.drop("vector")
    done = plan.recommend_postfiltered(asked, likes(spark, (1, 1)), items, catalog)
    assert ids(done) == [2]
    none = plan.recommend_postfiltered(asked, likes(spark, (1, 1)), items, catalog.filter("item_id = 4"))
    assert none.count() == 0


def test_centroid_count(spark):
    sizes = spark.createDataFrame([(10,), (1,), (5,)], "n bigint")
    count = lambda **kw: [r[0] for r in sizes.select(N.centroid_count(F.col("n"), **kw)).collect()]
    assert count(min_samples=2, scaling=0.4) == [4, 1, 2]
    assert count(min_samples=2, dynamic=False) == [5, 1, 2]
    capped = sizes.select(P.cluster_count(F.col("n"), Preferences(scaling=0.6)))
    assert [r[0] for r in capped.collect()] == [5, 1, 2]


def liked_points(spark, n_users=6, hot=60):
    rng = random.Random(11)
    rows = []
    for user in range(n_users):
        for item in range(hot if user == 0 else 3 + user):
            rows.append((user, item, [rng.gauss((item % 3) * 4, 1), rng.gauss(0, 1)]))
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, vector array<double>")


def collected(df):
    return {(r["user_id"], r["centroid"]): np.array(r["vector"]) for r in df.collect()}


def test_clusters_have_the_kmeans_properties(spark):
    points = liked_points(spark)
    found = collected(P.centroids(points, SERVICE_PRESET))
    again = collected(P.centroids(points.repartition(7), SERVICE_PRESET))
    assert found.keys() == again.keys() and all(np.allclose(found[k], again[k]) for k in found)
    by_user = {}
    for row in points.collect():
        by_user.setdefault(row["user_id"], []).append(row["vector"])
    for user, vectors in by_user.items():
        centers = [v for (u, _), v in found.items() if u == user]
        assert len(centers) == max(1, min(len(vectors) // 2, int(len(vectors) * 0.5)))
        if len(centers) == 1:
            assert np.allclose(centers[0], np.mean(vectors, axis=0))
            continue
        nearest = np.argmin([[np.sum((np.array(v) - c) ** 2) for c in centers] for v in vectors], axis=1)
        for at, center in enumerate(centers):
            members = np.array(vectors)[nearest == at]
            assert not len(members) or np.allclose(members.mean(axis=0), center)


def test_large_users_cluster_across_tasks(spark):
    points = liked_points(spark)
    local = collected(P.centroids(points, OFFLINE_PRESET))
    spread = collected(P.centroids(points, OFFLINE_PRESET, local_rows=6))
    assert local.keys() == spread.keys()
    assert all(np.allclose(local[k], spread[k]) for k in local)
    single = collected(P.centroids(points, SINGLE_CENTROID))
    assert set(single) == {(u, 0) for u in range(6)}


def test_postfilter_ranks_a_context_once(spark, items, monkeypatch):
    """Requests of one user and context share a list; each is cut by its own number of results and overfetch."""
    asked = spark.createDataFrame(
        [(f"r{n}-{i}", 1, 3, None, n) for n in (0, 1, 2, 3) for i in range(5)] + [("other", 1, None, "short", 2)],
        "request_id string, user_id bigint, players int, duration string, num_results int",
    )
    scored = {}
    once = plan._score_requests

    def counted(requests, *rest):
        scored["rows"] = requests.count()
        return once(requests, *rest)

    monkeypatch.setattr(plan, "_score_requests", counted)
    done = plan.recommend_postfiltered(asked, likes(spark, (1, 1)), items, items.drop("vector"), overfetch=1)
    got = {}
    for row in done.collect():
        got.setdefault(row["request_id"], []).append((row["rank"], row["item_id"], row["num_results"]))
    assert scored["rows"] == 2
    alone = {}
    for n in (1, 2, 3):
        one = plan.recommend_postfiltered(asked.filter(f"request_id = 'r{n}-0'"), likes(spark, (1, 1)), items, items.drop("vector"), overfetch=1)
        alone[n] = sorted((r["rank"], r["item_id"], n) for r in one.collect())
        assert all(sorted(got.get(f"r{n}-{i}", [])) == alone[n] for i in range(5))
    assert not any(key.startswith("r0") for key in got) and any(alone.values())


def test_similarity_summary_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "LEFT_ROWS", 5)
    monkeypatch.setattr(B, "RIGHT_ROWS", 7)
    monkeypatch.setattr(R, "_CHUNK_CELLS", 20)
    rng = np.random.default_rng(4)
    wishes, vectors = rng.normal(size=(40, 3)), rng.normal(size=(50, 3))
    wishes[2] = vectors[3] = 0
    frame = lambda rows, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{name} bigint, vector array<double>")
    got = R.similarity_summary(frame(wishes, "query_id"), frame(vectors, "item_id")).orderBy("query_id").toPandas()
    unit = lambda rows: rows / np.where(np.linalg.norm(rows, axis=1) == 0, 1, np.linalg.norm(rows, axis=1))[:, None]
    scores = unit(wishes) @ unit(vectors).T
    assert got["query_id"].tolist() == list(range(40)) and (got["n_items"] == 50).all()
    for name, want in (("min", scores.min(axis=1)), ("mean", scores.mean(axis=1)), ("max", scores.max(axis=1))):
        assert np.allclose(got[f"{name}_similarity"], want)
    assert R.similarity_summary(frame(wishes, "query_id"), frame(vectors[:0], "item_id")).count() == 0


def test_similarity_summary_holds_few_scores(spark, monkeypatch):
    """Two full chunks make a thousand million scores, which a task never holds at once."""
    taken = {}
    monkeypatch.setattr(R, "cogroup_cells", lambda left, right, cell, fn, schema: taken.update(fn=fn) or spark.createDataFrame([], schema))
    point = spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<double>")
    R.similarity_summary(point, point.withColumnRenamed("query_id", "item_id"))
    table = lambda name: pa.table({name: np.arange(4000), "vector": pa.array(np.ones((4000, 2)).tolist())})
    left, right = table("query_id"), table("item_id")
    tracemalloc.start()
    done = pa.concat_tables(taken["fn"](left, iter([right, right]))).to_pandas()
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (done["n"] == 8000).all() and np.allclose(done["total"], 8000) and most < 32e6  # all scores of a pair: 128 MB


def test_rows_travel_once(spark, monkeypatch):
    """No side is sent once per chunk of the other one, and every query goes through one shuffle only."""
    monkeypatch.setattr(B, "LEFT_ROWS", 10)
    monkeypatch.setattr(B, "RIGHT_ROWS", 10)
    liked = spark.range(400).select((F.col("id") % 40).alias("query_id"), (F.col("id") % 100).alias("item_id"))
    store = spark.range(100).select(F.col("id").alias("item_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector"))
    met = {}
    real = R.cogroup_cells

    def cells(left, right, cell, fn, schema):
        met.update(left=left, rows=left.agg(F.sum(F.size("vector"))).first()[0], chunks=right.count(), found=real(left, right, cell, fn, schema))
        return met["found"]

    monkeypatch.setattr(R, "cogroup_cells", cells)
    queries = R.directions(liked.join(store, "item_id"), "max").withColumn("n_results", F.lit(2))
    R.top_items(queries, store, aggregation="max", exclude=liked)
    assert met["rows"] == 400 and met["chunks"] <= 10
    plan = met["found"]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan
    # after the vectors are placed, nothing but the table of large queries is exchanged
    assert sum("Exchange hashpartitioning(query_id" in line and "_part" in line for line in plan.splitlines()) == 1


def test_null_and_repeated_keys(spark):
    """Null ids can win, sort before others and are excluded by nobody; queries without a vector drop out."""
    store = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], "item_id bigint, vector array<double>")
    queries = spark.createDataFrame([(None, [1.0, 0.0], 2), (7, [0.0, 1.0], 3)], "query_id bigint, vector array<double>, n_results int")
    exclude = spark.createDataFrame([(None, 1), (7, 1), (8, 2), (7, None)], "query_id bigint, item_id bigint")
    got = [tuple(r) for r in R.top_items(queries, store, exclude=exclude).select("query_id", "rank", "item_id", "score").collect()]
    assert sorted(got, key=str) == sorted([(None, 0, None, 1.0), (None, 1, 1, 1.0), (7, 0, 2, 1.0), (7, 1, 2, 1.0), (7, 2, None, 0.0)], key=str)


def test_sizes_of_users_need_no_vectors(spark, monkeypatch):
    """Only users with one centroid have their vectors averaged; a null user counts as one."""
    points = liked_points(spark).unionByName(spark.createDataFrame([(None, 1, [1.0, 3.0]), (99, 2, [5.0, 5.0]), (99, 3, [7.0, 5.0])], "user_id bigint, item_id bigint, vector array<double>"))
    averaged = {}
    real = P.mean_vectors
    monkeypatch.setattr(P, "mean_vectors", lambda df, by: averaged.update(users={r[0] for r in df.select(*by).collect()}) or real(df, by))
    found = collected(P.centroids(points, OFFLINE_PRESET))
    assert {None, 99} <= averaged["users"] and 0 not in averaged["users"]
    assert found[None, 0].tolist() == [1.0, 3.0] and found[99, 0].tolist() == [6.0, 5.0]
    assert {user for user, _ in found} == {*range(6), 99, None}
