"""The upsert table: same rows as keeping every batch, bounded reads, repeated batches."""

import random

from pyspark.sql import functions as F

from shelfwise.session import work_folder
from shelfwise.sources import upserts


def plain(batches, before):
    rows = {}
    for batch in batches[:before]:
        rows.update({(k, s): v for k, s, v in batch})
    return {(k, s, v) for (k, s), v in rows.items()}


def test_cover_is_short_and_whole():
    for n in range(600):
        runs = upserts.cover(n)
        assert [first for _, first in runs] == [sum(upserts.FAN**level for level, _ in runs[:i]) for i in range(len(runs))]
        assert sum(upserts.FAN**level for level, _ in runs) == n and len(runs) <= 4 * (upserts.FAN - 1)


def test_upserts_equal_a_plain_dictionary(spark, monkeypatch):
    monkeypatch.setattr(upserts, "FAN", 3)
    draw = random.Random(1)
    path = work_folder(spark, "upserts")
    keys = ["k", "s"]
    assert upserts.current(spark, path, keys) is None and upserts.lookup(spark, path, k=1, s="x") is None
    batches = [[(k, draw.choice("xy"), i) for k in draw.sample(range(12), 4)] for i in range(20)]
    batches = [list({(k, s): (k, s, v) for k, s, v in batch}.values()) for batch in batches]
    for i, batch in enumerate(batches):
        changes = spark.createDataFrame(batch, "k long, s string, v int")
        if i in (9, 10):  # a batch that failed half way and is repeated
            upserts.append(changes.withColumn("v", F.lit(-1)), path, keys, i)
        upserts.append(changes, path, keys, i)
        if i in (0, 2, 3, 8, 9, 18, 19):
            assert {tuple(r) for r in upserts.current(spark, path, keys).select("k", "s", "v").collect()} == plain(batches, i + 1)
            assert {tuple(r) for r in upserts.current(spark, path, keys, before=i).select("k", "s", "v").collect()} == plain(batches, i) if i else True
    some = spark.createDataFrame([(1, "x"), (5, "y"), (5, "y"), (99, "x")], "k long, s string")
    assert {tuple(r) for r in upserts.current(spark, path, keys, only=some).select("k", "s", "v").collect()} == {r for r in plain(batches, 20) if r[:2] in {(1, "x"), (5, "y")}}
    assert {tuple(r) for r in upserts.current(spark, path, keys, only=some.select("k")).select("k", "s", "v").collect()} == {r for r in plain(batches, 20) if r[0] in {1, 5}}
    for k, s, v in list(plain(batches, 20))[:3]:
        assert [tuple(r) for r in upserts.lookup(spark, path, k=k, s=s).select("k", "s", "v").collect()] == [(k, s, v)]
    assert upserts.lookup(spark, path, k=99, s="x").collect() == []


def test_reads_stay_flat_over_many_batches(spark):
    path = work_folder(spark, "upserts")
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(1.5).alias("v")).coalesce(1)
    sizes = {}
    for i in range(100):
        upserts.append(rows.filter(F.col("k") % 5 == i % 5), path, ["k"], i)
        if i % 8 == 4:
            sizes[i] = upserts.live_bytes(spark, path)
    assert len(upserts.live_runs(spark, path, 100)) <= 2 * upserts.FAN
    assert max(sizes[i] for i in sizes if i > 64) <= 2.5 * sizes[12]
    assert upserts.current(spark, path, ["k"]).count() == 200


def test_missing_merges_are_read_through_their_parts(spark, monkeypatch):
    monkeypatch.setattr(upserts, "FAN", 2)
    path = work_folder(spark, "upserts")
    for i in range(4):
        upserts._write(spark.createDataFrame([(i % 2, i)], "k long, v int").withColumn(upserts.BATCH, F.lit(i)), upserts._run(path, 0, i), ["k"])
    assert upserts.written(spark, path) == 4
    assert {tuple(r) for r in upserts.current(spark, path, ["k"]).select("k", "v").collect()} == {(0, 2), (1, 3)}
    assert {tuple(r) for r in upserts.current(spark, path, ["k"], before=2).select("k", "v").collect()} == {(0, 0), (1, 1)}
