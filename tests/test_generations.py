"""Replaced tables: old or new, never a mix."""

import pytest
from pyspark.sql import functions as F

from shelfwise.session import work_folder
from shelfwise.sources import generations as G


def tables(spark, value, rows=3):
    items = spark.range(rows).select("id", F.lit(value).alias("v"))
    return {"items": items, "tags": items.select("id", F.concat(F.lit("tag "), "v").alias("tag"))}


def values(frames):
    return {r["v"] for r in frames["items"].collect()}, {r["tag"] for r in frames["tags"].collect()}


def test_readers_see_one_generation(spark):
    root = work_folder(spark, "generations")
    with pytest.raises(FileNotFoundError):
        G.read(spark, root, "items")
    assert G.replace(spark, root, tables(spark, "a")) == 1
    held = G.read(spark, root, "items", "tags")
    assert values(held) == ({"a"}, {"tag a"})
    # a failure between the two writes
    broken = tables(spark, "b")
    broken["tags"] = broken["tags"].withColumn("tag", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        G.replace(spark, root, broken)
    assert values(G.read(spark, root, "items", "tags")) == ({"a"}, {"tag a"})
    # a load that its check refuses
    with pytest.raises(ValueError, match="too few"):
        G.replace(spark, root, tables(spark, "c", 1), check=lambda t: "too few rows" if t["items"].count() < 2 else None)
    assert values(G.read(spark, root, "items", "tags")) == ({"a"}, {"tag a"})
    number = G.replace(spark, root, tables(spark, "d"), check=lambda t: None)
    assert number == 4 and values(G.read(spark, root, "items", "tags")) == ({"d"}, {"tag d"})
    assert values(held) == ({"a"}, {"tag a"})  # still readable
    assert values(G.read(spark, root, "items", "tags", generation=1)) == ({"a"}, {"tag a"})
    assert [tuple(r) for r in G.pointers(spark, root).select("generation", "n_rows").orderBy("generation").collect()] == [(1, 6), (4, 6)]
    assert G.vacuum(spark, root) == [2, 3] and G.vacuum(spark, root, keep=1) == [1]
    assert values(G.read(spark, root, "items", "tags")) == ({"d"}, {"tag d"})


def test_an_empty_load_is_a_load(spark):
    root = work_folder(spark, "generations")
    G.replace(spark, root, tables(spark, "a"))
    G.replace(spark, root, tables(spark, "b", 0))
    assert values(G.read(spark, root, "items", "tags")) == (set(), set())
