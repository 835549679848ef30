import csv
import os

import pytest
from pyspark.sql import functions as F

from shelfwise.config import CatalogFilters, FeatureColumns, Preprocessing
from shelfwise.operators import catalog as C
from shelfwise.operators import profile as P
from shelfwise.operators.text_features import feature_schema
from shelfwise.plans.preprocess import filtered_catalog, preprocess, quality_report
from shelfwise.sources import files

HEADER = [
    "BGGId", "Name", "Description", "YearPublished", "AvgRating", "NumOwned", "MinPlayers", "MaxPlayers",
    "ComMaxPlaytime", "ComMinPlaytime", "MfgPlaytime", "NumUserRatings", "GameWeight", "ComAgeRec",
]
OVERRIDE = [
    [1, "Classic", "Old", 1950, 4.0, 50000, 2, 6, 90, 60, 120, 20000, 2.5, 10],
    [2, "Cult Classic", "Cult", 1990, 4.3, 60000, 2, 4, 60, 45, 60, 500, 2.5, 10],
    [3, "Obscure", "Dull", 2005, 4.1, 50, 2, 4, 45, 30, 60, 500, 2.5, 10],
    [4, "Modern Gem", "New", 2021, 7.2, 5000, 1, 4, 60, 45, 60, 1200, 2.5, 10],
]


def write(path, header, rows):
    with open(path, "w", newline="") as out:
        csv.writer(out).writerows([header, *rows])
    return str(path)


def tags(spark, tmp_path, name, values):
    header = ["BGGId", *values]
    rows = [[1, *[1 if at == 0 else 0 for at in range(len(values))]], [2] + [0] * len(values)]
    return files.load_tags(spark, write(tmp_path / f"{name}.csv", header, rows), name)


def test_two_item_job(spark, tmp_path):
    rows = [
        [1, "Alpha", "Fast co-op adventure game", 2020, 8.0, 1000, 1, 4, 60, 50, 70, 500, 2.5, 10, 1, 0],
        [2, "Beta", 'Quoted "text", with comma', 2019, 7.0, 900, 2, 4, "", 45, 70, 400, 2.0, 8, 0, 1],
    ]
    path = write(tmp_path / "items.csv", [*HEADER, "Cat: Strategy", "Cat: Family Fun"], rows)
    items = files.load_items(spark, path)
    assert {"cat_strategy", "cat_family_fun"} <= set(items.columns)
    config = Preprocessing(
        filters=CatalogFilters(2025, 0.0, 0.0, 0, 0.0, 8, 240),
        features=FeatureColumns(numeric=("avg_rating", "min_players")),
        stopwords=["game"],
        synonyms={"cooperative": ["co-op"]},
    )
    features = preprocess(
        items,
        subcategories=tags(spark, tmp_path, "subcategories", ["Card"]),
        mechanics=tags(spark, tmp_path, "mechanics", ["Co-op", "Deck Building"]),
        themes=tags(spark, tmp_path, "themes", ["Space"]),
        config=config,
    )
    got = {row["item_id"]: row for row in features.collect()}
    assert got[1]["text_description_tokens"] == "fast cooperative adventure fast cooperative cooperative adventure"
    assert got[1]["cat_mechanics"] == "co op" and got[2]["cat_mechanics"] == ""
    assert got[1]["categories"] == "strategy, Card" and got[2]["categories"] == "family_fun"
    assert got[2]["playing_time_minutes"] == 45
    assert got[1]["num_avg_rating"] == 1.0 and got[2]["num_avg_rating"] == -1.0
    assert "text_description_tokens" in feature_schema(features)["text"]


def test_rating_override(spark, tmp_path):
    items = files.load_items(spark, write(tmp_path / "items.csv", HEADER, OVERRIDE))
    filters = CatalogFilters(None, 0.0, 6.0, 10_000, 0.5, 8, 240)
    timed = items.withColumn("playing_time_minutes", C.playing_time())
    assert {r["name"] for r in C.apply_filters(timed, filters).collect()} == {"Classic", "Cult Classic", "Modern Gem"}
    steps = {r["name"]: r for r in C.filter_report(timed, filters).collect()}
    assert set(steps) == {"min_avg_rating", "max_required_players", "max_playing_time_minutes"}
    assert steps["min_avg_rating"]["kept_by_override"] == 2
    assert steps["min_avg_rating"]["owned_threshold"] == 50000.0


def test_source_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_items(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError, match="AvgRating, Name"):
        kept = [name for name in HEADER if name not in ("Name", "AvgRating")]
        files.load_items(spark, write(tmp_path / "short.csv", kept, [[1] * len(kept)]))
    with pytest.raises(ValueError, match="id column"):
        files.load_tags(spark, write(tmp_path / "tags.csv", ["Other"], [[1]]), "tags")
    with pytest.raises(FileNotFoundError):
        files.read_features(spark, str(tmp_path / "none"))


def test_freshness(spark, tmp_path):
    import datetime

    source = spark.range(3).withColumnRenamed("id", "item_id")
    stored = files.read_features(spark, files.write_features(source, str(tmp_path / "f")))
    assert files.newer_than(stored, None)
    assert files.newer_than(stored, datetime.datetime(2000, 1, 1))
    assert not files.newer_than(stored, datetime.datetime(2200, 1, 1))


def test_word_lists(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("game\n\n  Card \n")
    (tmp_path / "syn.toml").write_text('co-op = ["cooperative"]\nother = 3\n')
    assert files.load_stopwords(spark, str(tmp_path / "stop.txt")) == ["Card", "game"]
    assert files.load_synonyms(spark, str(tmp_path / "syn.toml")) == {"co-op": ["cooperative"]}


def test_empty_profiles(spark):
    empty = spark.createDataFrame([], "item_id bigint, a double, s string")
    assert P.numeric_profile(empty, ["a"]).first().asDict() == {
        "column": "a", "non_null": 0, "coverage": 0.0, "min": 0.0, "max": 0.0, "median": 0.0, "std": 0.0,
    }
    assert P.text_profile(empty, ["s"]).first()["p95_length"] == 0.0
    assert P.categorical_profile(empty, ["s"]).first()["distinct"] == 0
    assert C.duplicate_rows(empty).first()["duplicate_rows"] == 0
    assert C.collapse_categories(empty).schema["categories"].dataType.simpleString() == "string"


def test_report_sections(spark, tmp_path):
    items = files.load_items(spark, write(tmp_path / "items.csv", HEADER, [*OVERRIDE, OVERRIDE[0]]))
    for name in ("mechanics", "themes", "categories"):
        items = items.withColumn(name, F.lit("x, y"))
    config = Preprocessing(filters=CatalogFilters(None, 0.0, 6.0, 10_000, 0.5, 8, 240))
    filtered = filtered_catalog(items, [], config)
    tokens = filtered.select(F.col("description").alias("text_description_tokens"))
    report = quality_report(items, filtered, tokens, config)
    assert report["totals"].first()["rows_removed"] == 1
    assert report["integrity"].first()["duplicate_rows"] == 2
    numeric = {r["column"]: r for r in report["numeric"].collect()}
    assert numeric["year_published"]["median"] == 1970.0  # 1950, 1950, 1990, 2021
    assert {r["section"] for r in spark.read.json(files.write_report(report, str(tmp_path / "r"))).collect()} == set(report)


def test_record_normalization(spark):
    schema = "item_id bigint, name string, min_players double, max_players int, complexity double, avg_rating double, year_published double"
    rows = [
        (101, "Valid", 2.9, 4, 2.5, 7.0, 2000.0),
        (202, "Low", 0.0, 0, 9.0, -1.0, None),
        (303, None, 1.0, 2, None, None, 2001.0),
        (404, "Nan year", 1.0, 2, None, None, float("nan")),
        (505, "Null players", None, 2, None, None, 2001.0),
    ]
    records = C.normalize_records(spark.createDataFrame(rows, schema))
    good = {r["item_id"]: r for r in C.accepted(records).collect()}
    assert set(good) == {101, 202}
    assert (good[101]["min_players"], good[101]["max_players"], good[101]["playing_time_minutes"]) == (2, 4, 1)
    assert (good[202]["min_players"], good[202]["max_players"]) == (1, 1)
    assert (good[202]["complexity"], good[202]["avg_user_rating"], good[202]["year_published"]) == (5.0, 0.0, 0)
    assert good[101]["mechanics"] == []
    reasons = {r["item_id"]: r["reject_reason"] for r in C.rejected(records).collect()}
    assert reasons == {303: "name", 404: "year_published", 505: "min_players"}


def test_quoted_line_breaks_by_default(spark, tmp_path):
    row = [1, "Alpha", "line one\nline two", 2020, 8.0, 1000, 1, 4, 60, 50, 70, 500, 2.5, 10, 1, 0]
    path = write(tmp_path / "items.csv", [*HEADER, "Cat: Strategy", "Cat: Family Fun"], [row])
    found = files.load_items(spark, path).collect()
    assert len(found) == 1 and found[0]["description"] == "line one\nline two"
