import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.config import EmbeddingModel, FeatureColumns, FeatureWeights, TextVectorization
from shelfwise.operators import svd as S
from shelfwise.operators import text_features as X
from shelfwise.plans import train as T
from shelfwise.sources import stores


def sparse(spark, seed=1, n=40, m=25):
    rng = np.random.default_rng(seed)
    dense = np.where(rng.random((n, m)) < 0.3, rng.normal(size=(n, m)), 0.0) * np.linspace(3, 0.2, m)
    rows = [(i, "b", f"t{j}", float(dense[i, j])) for i in range(n) for j in range(m) if dense[i, j]]
    return dense, spark.createDataFrame(rows, "item_id bigint, block string, term string, weight double")


@pytest.mark.parametrize("limit", [S.BROADCAST_BYTES, 0])
def test_svd_against_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
    dense, matrix = sparse(spark)
    items, right, values = S.truncated_svd(matrix, 4, passes=8)
    _, expected, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, expected[:4], rtol=1e-6)
    found = items.orderBy("item_id").toPandas()
    coordinates = found.drop(columns="item_id").to_numpy()
    exact = dense @ vt[:4].T
    rows = found["item_id"].to_numpy()
    assert np.allclose(coordinates @ coordinates.T, (exact @ exact.T)[np.ix_(rows, rows)], atol=1e-6)
    v = right.toPandas().drop(columns="feature").to_numpy()
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-9)
    assert (v[np.abs(v).argmax(axis=0), range(4)] > 0).all()


@pytest.mark.parametrize("limit", [S.BROADCAST_BYTES, 0])
def test_svd_in_blocks(spark, monkeypatch, limit):
    # a pass sends rows per block and feature, whose number does not grow with the entries of a block
    monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(S, "BLOCK_ENTRIES", 60)
    sent = []
    real = S._sent
    monkeypatch.setattr(S, "_sent", lambda *args: sent.append(real(*args)) or sent[-1])
    dense, matrix = sparse(spark, n=200)
    items, _, values = S.truncated_svd(matrix, 4, passes=18)
    _, expected, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, expected[:4], rtol=1e-6)
    found = items.orderBy("item_id").toPandas()
    coordinates, exact = found.drop(columns="item_id").to_numpy(), (dense @ vt[:4].T)[found["item_id"].to_numpy()]
    assert np.allclose(coordinates @ coordinates.T, exact @ exact.T, atol=1e-6)
    assert len(sent) == 19 and sent[0].select("block").distinct().count() > 10
    assert sent[0].count() == sent[0].select("block", "feature").distinct().count() < matrix.count()


def test_svd_is_repeatable(spark):
    _, matrix = sparse(spark)
    first = S.truncated_svd(matrix, 3)[0].orderBy("item_id").toPandas().to_numpy()
    second = S.truncated_svd(matrix.repartition(9), 3)[0].orderBy("item_id").toPandas().to_numpy()
    assert np.allclose(first, second, atol=1e-9)
    with pytest.raises(ValueError):
        S.truncated_svd(matrix, 0)


FEATURES = [
    (1, "Alpha", "space fight space", "dice set", 7.5, 1, 4, 60, 0.5),
    (2, "Beta", "space trade", "dice", 7.0, 2, 4, 45, -0.5),
    (3, "Gamma", "farm trade", "set", 6.0, 2, 5, 30, 1.5),
    (4, "Delta", "", "", 8.2, 3, 5, 120, 0.0),
]
SCHEMA = (
    "item_id bigint, name string, text_description_tokens string, cat_mechanics string, avg_rating double, "
    "min_players int, max_players int, playing_time_minutes int, num_complexity double"
)


def test_training(spark, tmp_path):
    features = spark.createDataFrame(FEATURES, SCHEMA)
    text = TextVectorization(min_df=1, max_df=1.0, sublinear=False)
    for normalize in (True, False):
        vectors = T.train_embedding(features, text=text, model=EmbeddingModel(2, normalize, 7))
        got = vectors.select("item_id", F.col("embedding")).collect()
        assert all(len(r["embedding"]) == 2 for r in got) and len(got) == 4
        if normalize:
            norms = [np.linalg.norm(r["embedding"]) for r in got]
            assert all(np.isclose(n, 1) or n == 0 for n in norms)
    with pytest.raises(ValueError):
        T.train_embedding(features.limit(0), text=text)
    with pytest.raises(ValueError):
        T.train_embedding(features.select("item_id", "name"), text=text)
    with pytest.raises(ValueError):
        T.train_embedding(features, text=text, model=EmbeddingModel(0))
    wide = T.widen_embedding(vectors, 2)
    manifest = T.manifest("run-1", "2024-01-01 00:00:00", features, EmbeddingModel(2))
    stores.write_run(wide, manifest, str(tmp_path), "run-1")
    loaded = stores.load_run(spark, str(tmp_path))
    assert loaded.count() == 4 and {"embedding", "norm"} <= set(loaded.columns)
    with pytest.raises(ValueError, match="declared"):
        T.narrow_embedding(wide, ["embedding_dimension_9"])
    with pytest.raises(FileNotFoundError):
        stores.load_run(spark, str(tmp_path), "other")
    with pytest.raises(FileNotFoundError):
        stores.load_run(spark, str(tmp_path / "nowhere"))


def test_tfidf_by_hand(spark):
    features = spark.createDataFrame(FEATURES, SCHEMA)
    settings = TextVectorization(min_df=1, max_df=1.0, l2=False, sublinear=False)
    weights = {
        (r["item_id"], r["term"]): r["weight"]
        for r in X.tfidf(features, ["text_description_tokens"], settings).collect()
    }
    idf = lambda df: np.log((1 + 4) / (1 + df)) + 1
    assert np.isclose(weights[1, "space"], 2 * idf(2)) and np.isclose(weights[1, "fight"], idf(1))
    assert len(weights) == 6
    unit = X.tfidf(features, ["text_description_tokens"], TextVectorization(1, 1.0), {"text_description_tokens": 2.0})
    norms = unit.groupBy("item_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert all(np.isclose(r["n"], 2.0) for r in norms)
    assert X.tfidf(features, ["cat_mechanics"], TextVectorization(min_df=3)).count() == 0


def test_large_vocabulary_goes_to_blocks(spark, monkeypatch):
    """Beyond the broadcast limit the weights are the same, and entries are not shuffled by item or term."""
    rows = [(i, " ".join(f"w{i * j % 17}x" for j in range(1, 9)), "same words" if i % 3 else None) for i in range(60)]
    rows += [(None, "w1x w2x w2x", "same"), (60, None, None), (61, "", "words words")]
    texts = spark.createDataFrame(rows, "item_id bigint, text_a string, text_b string")
    settings = TextVectorization(min_df=3, max_df=0.9, l2=True, sublinear=True)
    weights = lambda: X.tfidf(texts, ["text_a", "text_b"], settings, {"text_b": 0.5})
    key = lambda df: sorted((str(r["item_id"]), r["block"], r["term"], round(r["weight"], 12)) for r in df.collect())
    small = key(weights())
    monkeypatch.setattr(X, "BROADCAST_TERMS", 0)
    large = weights()
    assert key(large) == small and len(small) > 300
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_b" in plan and "hashpartitioning(block#" in plan
    assert not any("item_id" in part.split(")")[0] for part in plan.split("hashpartitioning(")[1:])


@pytest.mark.parametrize("common", [1, 5, 1000])
def test_large_vocabulary_shuffles_only_rare_terms(spark, monkeypatch, common):
    """Entries of the most frequent terms meet a broadcast, also of those that are too frequent; the weights stay the same."""
    rows = [(i, "every " + " ".join(f"w{i % j}x{j}" for j in range(2, 12)), "every" if i % 5 else None) for i in range(80)]
    rows += [(7, "every w1x2 w1x2", "every"), (None, "every w1x2 w1x3", None), (None, "w1x2 w0x2", "every"), (90, None, None), (91, "", "")]
    texts = spark.createDataFrame(rows, "item_id bigint, text_a string, text_b string")
    settings = TextVectorization(min_df=6, max_df=0.5, l2=True, sublinear=True)
    weights = lambda: X.tfidf(texts, ["text_a", "text_b"], settings, {"text_b": 0.5})
    key = lambda df: sorted((str(r["item_id"]), r["block"], r["term"], round(r["weight"], 12)) for r in df.collect())
    small = key(weights())
    monkeypatch.setattr(X, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(X, "COMMON_TERMS", common)
    large = weights()
    assert key(large) == small and len(small) > 300
    assert "every" not in {term for _, _, term, _ in small} and {"7", "None"} <= {item for item, _, _, _ in small}
    plan = large._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # frequent terms leave before the entries are counted and shuffled, and one sort per item replaces those by term
    assert "LeftAnti" in plan and plan.count("Window [") == 1 and plan.count("BroadcastHashJoin") == 2


def test_real_bigrams_are_terms(spark):
    features = spark.createDataFrame(FEATURES, SCHEMA)
    settings = TextVectorization(1, 1.0, l2=False)
    grams = X.tfidf(features, ["text_description_tokens"], settings, analyzer=X.ngram_terms)
    assert {r["term"] for r in grams.filter("item_id = 2").collect()} == {"space", "trade", "space trade"}


def test_weights_and_roles(spark):
    weights = X.feature_column_weights(FeatureWeights(themes=0.5))
    assert weights == {"text_description_tokens": 1.0, "cat_mechanics": 0.8, "cat_categories": 0.8, "cat_themes": 0.5}
    other = X.feature_column_weights(FeatureWeights(), FeatureColumns(text=["rules"], categorical=["mechanics"]))
    assert other == {"text_rules_tokens": 1.0, "cat_mechanics": 0.8}
    frame = spark.createDataFrame([], "item_id bigint, num_user_ratings bigint, num_num_user_ratings double")
    assert X.feature_schema(frame)["numeric"] == ["num_user_ratings", "num_num_user_ratings"]
    assert X.feature_schema(frame, exclude=["num_user_ratings"])["numeric"] == ["num_num_user_ratings"]


def test_numeric_block_refuses_bad_numbers(spark):
    good = spark.createDataFrame([(1, 2.0)], "item_id bigint, num_x double")
    assert X.numeric_block(good, ["num_x"], 0.5).first()["weight"] == 1.0
    bad = spark.createDataFrame([(1, float("nan"))], "item_id bigint, num_x double")
    with pytest.raises(Exception, match="invalid values"):
        X.numeric_block(bad, ["num_x"]).collect()


@pytest.mark.parametrize("limit", [S.BROADCAST_BYTES, 0])
def test_svd_leaves_little_behind(spark, monkeypatch, tmp_path, limit):
    """Of the entries and the factors of the passes nothing is left, and shuffle files go with their step."""
    monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(S, "BLOCK_ENTRIES", 100)
    monkeypatch.setattr(S, "_PACKED_ENTRIES", 30)
    folders, most = [], []

    def folder(_, name):
        folders.append(str(tmp_path / f"{name}-{len(folders)}"))
        most.append(sum(1 for path in folders if os.path.exists(path)))
        return folders[-1]

    monkeypatch.setattr(S, "work_folder", folder)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, during = spark.conf.get(setting), []
    real = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: during.append(spark.conf.get(setting)) or real(df))
    dense, matrix = sparse(spark, n=80)
    items, right, values = S.truncated_svd(matrix, 4, passes=8)
    assert len(folders) > 8 and max(most) <= 1 and not any(os.path.exists(path) for path in folders)
    assert set(during) == {"true"} and spark.conf.get(setting) == before
    assert items.count() == len(np.flatnonzero(dense.any(axis=1))) and right.count() == 25
    assert np.allclose(values, np.linalg.svd(dense, compute_uv=False)[:4], rtol=1e-6)
