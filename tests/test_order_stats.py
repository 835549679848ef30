import math
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import order_stats as O


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_against_sorted_lists(spark, monkeypatch, buckets):
    monkeypatch.setattr(O, "BUCKETS", buckets)
    rng = random.Random(5)
    groups = {
        "ties": [rng.choice([1.0, 2.0, 2.0, 9.0]) for _ in range(200)],
        "wide": [rng.lognormvariate(0, 8) for _ in range(301)],
        "negative": [rng.uniform(-5, 5) for _ in range(50)],
        "one": [3.25],
        "same": [7.0] * 40,
        "signs": [s * 10.0 ** rng.uniform(-300, 300) for s in (-1, 1) for _ in range(60)] + [0.0, -math.inf, math.inf],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("ties", None)]
    ranks = {
        "near": O.nearest_rank(0.3), "high": O.higher_rank(0.95), "index": O.index_rank(0.95),
        "low_mid": O.LOWER_MIDDLE, "up_mid": O.UPPER_MIDDLE,
    }
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: r for r in O.order_statistics(df, ["g"], "v", ranks).collect()}
    for name, values in groups.items():
        values, n = sorted(values), len(values)
        expected = {
            "near": values[math.floor((n - 1) * 0.3 + 0.5)],
            "high": values[math.ceil((n - 1) * 0.95)],
            "index": values[max(0, min(n - 1, int(n * 0.95) - 1))],
            "low_mid": values[(n - 1) // 2],
            "up_mid": values[n // 2],
        }
        assert found[name]["n"] == n
        assert {k: found[name][k] for k in expected} == expected
    whole = O.order_statistics(df, [], "v", {"m": O.nearest_rank(0.5)}).first()
    everything = sorted(v for _, v in rows if v is not None)
    assert whole["m"] == everything[math.floor((len(everything) - 1) * 0.5 + 0.5)]


def test_heavy_tails_leave_few_values_to_sort(spark):
    draws = spark.range(100_000).select(F.lit("g").alias("g"), F.exp(F.rand(3) * 40 - 10).alias("v"))
    counted = draws.select("g", F.col("v").alias("_v"), F.lit(1).cast("bigint").alias("_c"))
    spans = counted.groupBy("g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    targets = spans.select("g", "n", "_lo", "_hi", F.lit("t").alias("_stat"), F.lit(30_000).cast("bigint").alias("_k"))
    for scale in (O._signed_log, O._plain):
        targets = O._narrow(counted, targets, ["g"], True, scale)
    assert O._within(counted, targets, ["g"], True).count() <= 10


def test_large_integers_stay_exact(spark):
    values = [(1 << 53) + i for i in range(5)]
    row = O.order_statistics(spark.createDataFrame([(v,) for v in values], "v long"), [], "v", {"m": O.LOWER_MIDDLE}).first()
    assert row["m"] == values[2]


def test_few_groups_do_not_move_their_values(spark, monkeypatch):
    """A group's values stay spread over the tasks, also where Spark itself would not broadcast the ranges."""
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 0.5).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = O.order_statistics(rows, ["g"], "v", {"q30": O.nearest_rank(0.3)})
        got = {r["g"]: (r["n"], r["q30"]) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(O, "FEW_GROUPS", 2)
        many = O.order_statistics(rows, ["g"], "v", {"q30": O.nearest_rank(0.3)})
        assert {r["g"]: (r["n"], r["q30"]) for r in many.collect()} == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
    for g in range(3):
        values = [i * 0.5 for i in range(5000) if i % 3 == g]
        assert got[g] == (len(values), values[int((len(values) - 1) * 0.3 + 0.5)])
