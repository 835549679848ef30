import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import blocks as B
from shelfwise.operators import explain as E
from shelfwise.operators import references as R
from shelfwise.plans.recommend import recommend_postfiltered
from shelfwise.plans.sessions import explained_results, generate_sessions, session_outcomes
from shelfwise.operators import sessions as X

RANKED = "request_id string, user_id bigint, rank int, item_id bigint, score double"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def vectors_of(spark, table):
    return frame(spark, [(int(i), [float(x) for x in v]) for i, v in table.items()], "item_id bigint, vector array<double>")


def likes(spark, pairs):
    return frame(spark, pairs, "user_id bigint, item_id bigint, pos int")


CATALOG = "item_id bigint, title string, mechanics array<string>, themes array<string>, genre array<string>"


def test_no_comparison_shows_the_first_liked(spark):
    store = vectors_of(spark, {10: [1, 0], 11: [0, 1], 12: [1, 1], 13: [1, 2]})
    names = frame(spark, [(10, "Alpha"), (11, "Beta"), (12, None)], "item_id bigint, name string")
    ranked = frame(spark, [("r", 1, 0, 2, 0.9)], RANKED)
    liked = likes(spark, [(1, 11, 1), (1, 10, 0), (1, 12, 2), (1, 13, 3), (1, 99, 4)])
    refs = E.explain_by_references(ranked, liked, store, names).first()["references"]
    assert [(r["liked_id"], r["title"], r["influence"]) for r in refs] == [
        (10, "Alpha", "positive"), (11, "Beta", "positive"), (12, "", "positive"),
    ]


def test_feature_order_without_liked_items(spark):
    catalog = frame(spark, [(2, "Two", ["Deck, Bag Building"], ["Space"], ["Strategy"])], CATALOG)
    ranked = frame(spark, [("r", 1, 0, 2, 0.9), ("r", 1, 1, 3, 0.8)], RANKED)
    store = vectors_of(spark, {2: [1, 0]})
    done = E.explain_by_features(ranked, likes(spark, [(1, 77, 0)]), store, catalog).orderBy("rank").collect()
    assert [(f["label"], f["category"], f["influence"]) for f in done[0]["features"]] == [
        ("Deck, Bag Building", "mechanic", "positive"), ("Space", "theme", "positive"), ("Strategy", "genre", "positive"),
    ]
    assert done[1]["features"] == []


def test_title_stands_in_for_missing_tags(spark):
    catalog = frame(spark, [(1, "Lonely", [], None, []), (2, "", [], [], []), (3, "T", ["a", "a", ""], ["a"], ["g"])], CATALOG)
    hints = {r["item_id"]: [tuple(h) for h in r["hints"]] for r in E.feature_hints(catalog).collect()}
    assert hints == {1: [("Lonely", "theme")], 2: [], 3: [("a", "mechanic"), ("a", "theme"), ("g", "genre")]}


def expected_references(rank, score, top, sims):
    """The influence rules in plain words, for one result."""
    sims = sorted(sims, key=lambda s: (-s[1], s[2]))
    if rank > 2:
        cut = rank % len(sims)
        sims = sims[cut:] + sims[:cut]
    sims = sims[:3]
    strong = rank < 3 or (top > 0 and score >= 0.85 * top)
    best = sims[0][1] or 1e-9
    marks = []
    for at, (_, sim, _) in enumerate(sims):
        if at == 0 or (at == 1 and strong and len(sims) > 1):
            marks.append("positive")
        else:
            marks.append("negative" if sim / best < 0.5 or sim < 0.15 else "neutral")
    if len(marks) > 1:
        if set(marks) == {"positive"}:
            marks[-1] = "neutral"
        if rank >= 3 or (top > 0 and score < 0.7 * top):
            marks[-1] = "negative"
    return [(s[0], m) for s, m in zip(sims, marks)]


@pytest.mark.parametrize("rows", [3, 10_000])
def test_references_against_brute_force(spark, monkeypatch, rows):
    """The same answer whether a user's liked list is split over cells or not."""
    monkeypatch.setattr(R, "keyed_cells", lambda *a, **k: B.keyed_cells(*a, **k, left_rows=rows, right_rows=rows))
    rng = np.random.default_rng(8)
    table = {i: rng.normal(size=4).round(1) for i in range(40)}
    table[7] = np.zeros(4)
    table[9] = table[8]
    owned = {1: list(range(1, 24)), 2: [30], 3: [31, 32], 4: [7]}
    liked = likes(spark, [(u, i, n) for u, picks in owned.items() for n, i in enumerate(picks)])
    results = [(f"r{u}", u, rank, int(item), 1.0 - 0.08 * rank) for u in owned for rank, item in enumerate(rng.permutation(np.arange(24, 40))[:9])]
    names = frame(spark, [(i, f"n{i}") for i in table], "item_id bigint, name string")
    done = E.explain_by_references(frame(spark, results, RANKED), liked, vectors_of(spark, table), names)
    got = {(r["request_id"], r["rank"]): [(x["liked_id"], x["influence"]) for x in r["references"]] for r in done.collect()}
    assert len(got) == len(results)
    for request, user, rank, item, score in results:
        sims = []
        for pos, other in enumerate(owned[user]):
            scale = np.linalg.norm(table[item]) * np.linalg.norm(table[other])
            if scale:
                sims.append((other, round(float(table[item] @ table[other] / scale), 12), pos))
        want = expected_references(rank, score, 1.0, sims) if sims else [(i, "positive") for i in owned[user][:3]]
        assert got[request, rank] == want, (request, rank)


def test_unknown_group_is_an_error(spark):
    ranked = frame(spark, [("r", 1, 0, 2, 0.9)], RANKED)
    groups = frame(spark, [("r", "other")], "request_id string, study_group string")
    catalog = frame(spark, [(2, "Two", [], [], [])], CATALOG)
    with pytest.raises(Exception, match="unknown study group"):
        E.explain_by_group(ranked, groups, likes(spark, [(1, 2, 0)]), vectors_of(spark, {2: [1, 0]}), catalog).collect()


def test_sessions_end_to_end(spark):
    store = vectors_of(spark, {1: [1, 0], 2: [0.9, 0.1], 3: [0.5, 0.5], 4: [0, 1]})
    catalog = frame(
        spark,
        [(i, f"T{i}", ["Trading"], ["Fantasy"], ["family"], 1, 4, 30 if i < 4 else 200) for i in range(1, 5)],
        CATALOG + ", min_players int, max_players int, playing_time_minutes int",
    )
    asked = frame(
        spark,
        [("a", 1, 2, "short", 2), ("b", 1, 9, None, 2), ("c", 1, 0, None, 2), ("d", 2, 2, None, 2), ("e", 3, 2, None, None)],
        "request_id string, user_id bigint, players int, duration string, num_results int",
    )
    liked = frame(spark, [(1, 1), (2, 4), (2, 4), (3, 2)], "user_id bigint, item_id bigint")
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp")
    sessions = generate_sessions(asked, liked, store, catalog, created_at=moment, override=F.lit("references"))
    rows = {r["request_id"]: r for r in sessions.collect()}
    assert set(rows) == {"a", "e"}  # b fits no item, c and d are invalid
    assert [s["item"]["id"] for s in rows["a"]["recommendations"]] == [2, 3]
    assert rows["e"]["intent"]["num_results"] == 10 and len(rows["e"]["recommendations"]) == 3
    assert rows["a"]["recommendations"][0]["explanation"]["references"][0]["liked_id"] == 1
    known = frame(spark, [("participant-1", "features"), ("participant-1", "features"), ("participant-9", "references")], "participant_id string, study_group string")
    registered = generate_sessions(asked, liked, store, catalog, created_at=moment, participants=known)
    (only,) = registered.collect()  # e is asked by somebody who never registered
    assert (only["request_id"], only["experiment_group"]) == ("a", "features")
    told = {r["request_id"]: r["reason"] for r in session_outcomes(asked, liked, registered.select("request_id", F.lit(2).alias("item_id")), catalog, known).collect()}
    assert told["e"] == "participant not found" and told["a"] is None and told["c"] == "players must be positive"
    mine = lambda requests, *rest: requests.select("*", F.lit(3).cast("bigint").alias("item_id"), F.lit(1.0).alias("score"), F.lit(0).alias("rank"))
    other = generate_sessions(asked, liked, store, catalog, created_at=moment, ranker=mine)
    assert all([s["item"]["id"] for s in r["recommendations"]] == [3] for r in other.collect())
    again = generate_sessions(asked, liked, store, catalog, created_at=moment)
    assert {r["id"] for r in again.collect()} == {r["id"] for r in rows.values()}
    decoded = {r["id"]: r for r in X.decode(X.encode(sessions), moment).collect()}
    first = rows["a"]
    assert decoded[first["id"]]["recommendations"][0]["item"]["id"] == 2 and decoded[first["id"]]["skipped"] == 0
    assert decoded[first["id"]]["created_at"] == first["created_at"]


def test_liked_order_and_outcomes(spark):
    store = vectors_of(spark, {1: [1, 0], 2: [1, 0], 3: [0.8, 0.6]})
    catalog = frame(
        spark,
        [(i, f"T{i}", ["Trading"], ["Fantasy"], ["family"], 1, 4, 30) for i in range(1, 4)],
        CATALOG + ", min_players int, max_players int, playing_time_minutes int",
    )
    asked = frame(
        spark,
        [("a", 1, 2, None, 1), ("b", 1, 9, None, 1), ("c", 1, 0, None, 1), ("d", 4, 2, None, 1)],
        "request_id string, user_id bigint, players int, duration string, num_results int",
    )
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp")
    for order in ([1, 2], [2, 1]):
        liked = frame(spark, [(1, item, pos) for pos, item in enumerate(order)], "user_id bigint, item_id bigint, pos int")
        (row,) = generate_sessions(asked, liked, store, catalog, created_at=moment, override=F.lit("references")).collect()
        told = row["recommendations"][0]["explanation"]["references"]
        assert [r["liked_id"] for r in told] == order
    ranked = frame(spark, [("a", 3)], "request_id string, item_id bigint")
    found = {r["request_id"]: tuple(r)[1:] for r in session_outcomes(asked, liked, ranked, catalog).collect()}
    assert found == {
        "a": ("ok", None, 1, 0),
        "b": ("unavailable", "no item suits the request", 0, 0),
        "c": ("rejected", "players must be positive", 0, 0),
        "d": ("rejected", "no liked items", 0, 0),
    }
    bare = session_outcomes(asked, liked, ranked, catalog.filter("item_id <> 3")).filter("request_id = 'a'").first()
    assert tuple(bare)[1:] == ("incomplete", "results without catalog record", 1, 1)


def test_similarities_in_bounded_blocks(spark, monkeypatch):
    """Results of a user with many liked items are compared a few at a time, with the same outcome."""
    draw = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(60, 5)))], "item_id bigint, vector array<double>")
    ranked = vectors.select(F.lit("r").alias("request_id"), F.lit(1).alias("user_id"), (F.col("item_id") % 12).cast("int").alias("rank"), "item_id").filter("item_id < 12")
    liked = vectors.filter("item_id >= 20").select(F.lit(1).alias("user_id"), "item_id", F.lit(0).alias("pos"))
    rows = lambda: sorted(tuple(r) for r in R.liked_similarities(ranked, liked, vectors).select("rank", "place", "liked_id", "n").collect())
    whole = rows()
    monkeypatch.setattr(R, "_CELLS", 100)
    assert rows() == whole and {n for *_, n in whole} == {40}


def test_equal_requests_share_one_ask(spark):
    """However many requests ask the same, the ranker and the explainer see them once; every request gets the results."""
    store = vectors_of(spark, {1: [1, 0], 2: [0.9, 0.1], 3: [0.5, 0.5]})
    catalog = frame(
        spark, [(i, f"T{i}", ["Trading"], [], [], 1, 4, 30) for i in range(1, 4)],
        CATALOG + ", min_players int, max_players int, playing_time_minutes int",
    )
    asked = frame(
        spark,
        [(f"r{i}", 1, 2, None, 2) for i in range(40)] + [("s", 1, 2, None, 1), ("t", 2, 2, None, 2)],
        "request_id string, user_id bigint, players int, duration string, num_results int",
    )
    liked = frame(spark, [(1, 1), (2, 3)], "user_id bigint, item_id bigint")
    seen = {}

    def ranker(requests, *rest):
        seen["ranked"] = requests.count()
        return recommend_postfiltered(requests, *rest)

    def explainer(ranked, *rest):
        seen["explained"] = ranked.count()
        return E.explain_by_group(ranked, *rest)

    _, results = explained_results(asked, liked, store, catalog, ranker=ranker, explainer=explainer)
    got = {}
    for row in results.collect():
        got.setdefault(row["request_id"], []).append((row["rank"], row["item_id"], row["title"]))
    assert seen == {"ranked": 3, "explained": 5}
    assert all(sorted(got[f"r{i}"]) == [(0, 2, "T2"), (1, 3, "T3")] for i in range(40))
    assert got["s"] == [(0, 2, "T2")] and sorted(got["t"]) == [(0, 2, "T2"), (1, 1, "T1")]
