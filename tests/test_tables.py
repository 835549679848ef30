"""Search, names, sessions, wishlists and the streaming jobs on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import blocks as B
from shelfwise.operators import names as M
from shelfwise.operators import search as S
from shelfwise.operators import sessions as X
from shelfwise.operators import wishlist as W
from shelfwise.sources import stores
from shelfwise.streaming import jobs


@pytest.fixture()
def catalog(spark):
    rows = [
        (1, "Sky Trade", ["Trading"], ["Space Opera"], ["Family"], 2, 4, 30),
        (2, "Farm", ["Set Collection", "trading post"], [], ["strategy"], 5, 6, 30),
        (3, "100% Farm", [], None, [], 2, 4, 200),
    ]
    schema = (
        "item_id bigint, title string, mechanics array<string>, themes array<string>, genre array<string>, "
        "min_players int, max_players int, playing_time_minutes int"
    )
    return spark.createDataFrame(rows, schema)


def ids(df):
    return [r["item_id"] for r in df.collect()]


def test_facets(catalog):
    assert sorted(ids(S.search(catalog, mechanics=["TRAD"]))) == [1, 2]
    assert sorted(ids(S.search(catalog, mechanics=["", " "], q=""))) == [1, 2, 3]
    assert ids(S.search(catalog, q="farm", genre=["STR"])) == [2]
    assert ids(S.search(catalog, themes=["opera"])) == []
    assert ids(S.search(catalog, q="1%farm")) == [3]


def test_pages(catalog):
    page = S.search_page(catalog, limit=1, offset=1, q="a")
    assert [(r["item_id"], r["total"]) for r in page.collect()] == [(2, 3)]
    assert ids(S.search_page(catalog, limit=0)) == [] and ids(S.search_page(catalog, offset=9)) == []
    assert ids(S.page_after(catalog, 1, 5)) == [2, 3]
    for bad in ((0, 0), (101, 0), (1, -1)):
        with pytest.raises(ValueError):
            S.check_page(*bad)


def test_lookup(catalog):
    assert ids(S.lookup(catalog, 2)) == [2] and ids(S.lookup(catalog, 2**63)) == []
    with pytest.raises(ValueError):
        S.lookup(catalog, 0)
    S.require_complete(catalog.select("item_id"), catalog)
    with pytest.raises(LookupError, match=r"\[5, 7, 9\]"):
        S.require_complete(catalog.select((F.col("item_id") * 2 + 3).alias("item_id")), catalog)


def test_context(spark, catalog):
    ranked = spark.createDataFrame(
        [("r", 3, "short", i, i) for i in (3, 2, 1)] + [("n", 3, None, i, i) for i in (3, 2, 1)],
        "request_id string, players int, duration string, item_id bigint, rank int",
    )
    kept = {(r["request_id"], r["item_id"]) for r in S.filter_for_context(ranked, catalog).collect()}
    assert kept == {("r", 1), ("n", 1), ("n", 3)}
    assert ids(S.list_for_context(catalog, players=5)) == [2]
    assert ids(S.list_for_context(catalog, limit=2)) == [1, 2]


def test_typeahead(spark):
    options = spark.createDataFrame([(12, "Gear"), (3, None), (1, "Ring 12")], "item_id bigint, name string")
    assert ids(S.typeahead(options, "12", 5)) == [1, 12]
    assert ids(S.typeahead(options, "", 2)) == [1, 3]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_nearest_names_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "RIGHT_ROWS", 9)
    monkeypatch.setattr(B, "LEFT_ROWS", 2)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    names = [(i, word().title()) for i in range(60)] + [(60, ""), (61, None)]
    targets = [word() for _ in range(8)]
    found = M.nearest_names(
        spark.createDataFrame([(t,) for t in targets], "target string"),
        spark.createDataFrame(names, "item_id bigint, name string"),
    )
    got = {}
    for row in found.orderBy("target", "place").collect():
        got.setdefault(row["target"], []).append((row["distance"], row["item_id"]))
    for target in set(targets):
        want = sorted((distance(target.lower(), n.lower()), i) for i, n in names if n)[:3]
        assert got[target] == want


def test_missing_report(spark):
    missing = spark.createDataFrame([("g", 1, "Alpa"), ("g", 0, "Gama")], "group string, pos int, target string")
    catalog = spark.createDataFrame([(1, "Alpha"), (2, "Beta"), (3, "Gamma")], "item_id bigint, name string")
    message = M.missing_report(missing, catalog, "Missing").first()["message"]
    assert message == "Missing: 'Gama' (closest: Gamma, Beta, Alpha); 'Alpa' (closest: Alpha, Beta, Gamma)"
    empty = M.missing_report(missing, catalog.limit(0), "Missing").first()["message"]
    assert empty == "Missing: 'Gama'; 'Alpa'"


def test_validation_access_and_resume(spark):
    requests = spark.createDataFrame(
        [(r, u, p, d, n) for r, u, p, d, n in [
            ("ok", 1, 2, None, None), ("dup", 2, 2, None, 5), ("zero", 3, 2, None, 5), ("none", 4, 2, None, 5),
            ("players", 1, 0, None, 5), ("many", 1, 2, None, 101), ("time", 1, 2, "weekend", 5)]],
        "request_id string, user_id bigint, players int, duration string, num_results int",
    )
    liked = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 5), (3, 0)], "user_id bigint, item_id bigint")
    got = {r["request_id"]: (r["reject_reason"], r["num_results"]) for r in X.request_checks(requests, liked).collect()}
    assert got["ok"] == (None, 10)
    assert all(got[k][0] for k in ("dup", "zero", "none", "players", "many", "time"))
    sessions = spark.createDataFrame([("rec-1", "participant-1")], "id string, participant_id string")
    asked = spark.createDataFrame([("rec-1", "participant-1"), ("rec-1", "participant-2"), ("rec-2", "participant-1")], "session_id string, participant_id string")
    assert sorted(r["status"] for r in X.session_access(asked, sessions).collect()) == ["denied", "missing", "ok"]
    known = spark.createDataFrame([("participant-1", "features"), ("x-1", "features")], "participant_id string, study_group string")
    resume = spark.createDataFrame([("participant-1",), ("participant-9",), ("x-1",)], "participant_id string")
    assert sorted(r["status"] for r in X.resume_status(resume, known).collect()) == ["invalid", "missing", "ok"]


def test_upsert_prefers_the_change(spark):
    schema = "id string, created_at int, v string"
    stored = spark.createDataFrame([("a", 1, "old"), ("b", 5, "keep")], schema)
    change = spark.createDataFrame([("a", 1, "new"), ("b", 4, "stale"), ("c", 1, None)], schema)
    got = {r["id"]: r["v"] for r in X.upsert(stored, change, ["id"], "created_at").collect()}
    assert got == {"a": "new", "b": "keep", "c": None}


# ---- wishlist ---------------------------------------------------------------------

EVENTS = "event_id bigint, ts timestamp, user_id bigint, item_id bigint, action string"


def random_events(n=400, seed=4, spread=3000):
    rng = random.Random(seed)
    rows = []
    for at in range(n):
        second = rng.randint(0, spread)
        user = 0 if rng.random() < 0.5 else rng.randint(1, 6)
        rows.append((at, second, user, rng.randint(0, 3), rng.choice(["add", "remove"])))
    return rows


def timed(spark, rows):
    df = spark.createDataFrame(rows, "event_id bigint, s bigint, user_id bigint, item_id bigint, action string")
    return df.select("event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "user_id", "item_id", "action")


def fold(rows):
    state = {}
    for _, _, user, item, action in sorted(rows, key=lambda r: (r[1], r[0])):
        listed, most = state.get(user, (set(), 0))
        listed = listed | {item} if action == "add" else listed - {item}
        state[user] = (listed, max(most, len(listed)))
    return {u: (len(listed), most, int(most >= 2)) for u, (listed, most) in state.items()}


def view(df):
    return {r["user_id"]: (r["n_items"], r["max_items"], r["task_completed"]) for r in df.collect()}


@pytest.mark.parametrize("seconds", [1, 60, 10_000])
def test_wishlist_fold(spark, seconds):
    rows = random_events()
    assert view(W.wishlist_state(timed(spark, rows), slice_seconds=seconds)) == fold(rows)


def test_wishlist_continues_from_a_state(spark):
    rows = sorted(random_events(), key=lambda r: (r[1], r[0]))
    early, late = timed(spark, rows[:250]), timed(spark, rows[250:])
    after = W.wishlist_state(late, W.last_actions(early), W.wishlist_state(early))
    whole = fold(rows)
    assert view(after) == {u: whole[u] for u in view(after)}


def test_wishlist_stream_in_batches(spark, tmp_path):
    """Several files, events out of order within the allowed lateness."""
    rows = sorted(random_events(), key=lambda r: r[1])
    rng = random.Random(1)
    arrival = sorted(rows, key=lambda r: r[1] + rng.randint(0, 500))
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for at in range(0, len(arrival), 100):
        timed(spark, arrival[at : at + 100]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        jobs.wishlist_stream(stream, folder, lateness=600).awaitTermination()
    assert view(jobs.wishlist_view(spark, folder)) == fold(rows)
    assert spark.read.parquet(f"{folder}/late").count() == 0
    timed(spark, [(9999, 1, 0, 1, "add")]).coalesce(1).write.mode("append").parquet(source)
    jobs.wishlist_stream(spark.readStream.schema(EVENTS).parquet(source), folder, lateness=600).awaitTermination()
    assert spark.read.parquet(f"{folder}/late").count() == 1
    assert view(jobs.wishlist_view(spark, folder)) == fold(rows)


def test_registration_is_sticky(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "participant_id string, ts timestamp"
    seen = []
    for names in (["participant-1", "participant-2", "participant-1"], ["participant-2", "participant-3"]):
        rows = spark.createDataFrame([(n,) for n in names], "participant_id string").withColumn("ts", F.timestamp_seconds(F.lit(len(seen))))
        rows.coalesce(1).write.mode("append").parquet(source)
        jobs.registration_stream(spark.readStream.schema(schema).parquet(source), folder).awaitTermination()
        stored = jobs.current(spark, f"{folder}/participants", ["participant_id"])
        seen.append({r["participant_id"]: (r["study_group"], r["ts"]) for r in stored.collect()})
    assert set(seen[0]) == {"participant-1", "participant-2"}
    assert set(seen[1]) == {"participant-1", "participant-2", "participant-3"}
    assert all(seen[1][k] == v for k, v in seen[0].items())


def test_reseed_keeps_the_newest_drop(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "item_id bigint, name string, drop string"
    for drop, names in (("2024-01", ["a", "b", None]), ("2024-02", ["c"]), ("2024-02", ["d"])):
        rows = spark.createDataFrame([(i, n, drop) for i, n in enumerate(names)], schema)
        rows.coalesce(1).write.mode("append").parquet(source)
        jobs.reseed_stream(spark.readStream.schema(schema).parquet(source), folder).awaitTermination()
    assert sorted(r["title"] for r in jobs.seeded_catalog(spark, folder).collect()) == ["c", "d"]


def test_metadata_refreshes_only_stale_entries(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "item_id bigint, description string, image_url string, fetched_at timestamp"
    for second, text in ((0, "first"), (50, "too early"), (500, "later")):
        rows = spark.createDataFrame([(1, text, "")], "item_id bigint, description string, image_url string")
        rows.withColumn("fetched_at", F.timestamp_seconds(F.lit(second))).coalesce(1).write.mode("append").parquet(source)
        jobs.metadata_stream(spark.readStream.schema(schema).parquet(source), folder, ttl_seconds=100).awaitTermination()
        got = jobs.current(spark, f"{folder}/metadata", ["item_id"]).first()["description"]
        assert got == {"first": "first", "too early": "first", "later": "later"}[text]
    merged = S.current_metadata(
        jobs.current(spark, f"{folder}/metadata", ["item_id"]),
        spark.createDataFrame([], schema), F.timestamp_seconds(F.lit(10_000)), ttl_seconds=100,
    ).first()
    assert (merged["state"], merged["description"]) == ("stale", "later")


def test_overlay(spark, catalog):
    records = catalog.select("item_id").withColumns({"description": F.lit("own"), "image_url": F.lit("own")})
    metadata = spark.createDataFrame([(1, "new", ""), (2, "", None)], "item_id bigint, description string, image_url string")
    got = {r["item_id"]: (r["description"], r["image_url"]) for r in S.overlay(records, metadata).collect()}
    assert got == {1: ("new", "own"), 2: ("own", "own"), 3: ("own", "own")}


def test_one_group_rule(spark):
    from shelfwise.functions.numbers import study_group
    from shelfwise.operators.sessions import participant_id, participants, register

    users = spark.range(200).withColumnRenamed("id", "user_id")
    arriving = users.select(participant_id(F.col("user_id")).alias("participant_id"), F.lit(1).alias("ts"))
    known = spark.createDataFrame([], "participant_id string")
    stored = {r["participant_id"]: r["study_group"] for r in register(known, arriving).collect()}
    assert stored == {r[0]: r[1] for r in users.select(*participants(F.col("user_id"))).collect()}
    assert stored == {r[0]: r[1] for r in arriving.select("participant_id", study_group(F.col("participant_id"))).collect()}


def test_drops_are_ordered_by_number(spark, tmp_path):
    from shelfwise.streaming.jobs import _drop_order

    rows = spark.createDataFrame([("9",), ("10",)], "drop string")
    assert rows.agg(F.max_by("drop", _drop_order("drop"))).first()[0] == "10"
