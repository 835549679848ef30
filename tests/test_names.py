"""Nearest names through letter pairs: the bound never exceeds the distance, results equal a plain search."""

import random

import numpy as np

from shelfwise.operators.names import PairIndex, edit_distances, name_comparisons, nearest_names


def points(texts):
    return [np.fromiter(map(ord, text), np.int32, len(text)) for text in texts]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bound_is_below_the_distance():
    draw = random.Random(3)
    texts = ["".join(draw.choices("abé", k=draw.randint(0, 12))) for _ in range(80)] + ["a" * 200, "ab" * 90, "é"]
    index = PairIndex(points(texts))
    for text in texts[::4]:
        least = index.least_distances(points([text])[0])
        for other, bound in zip(texts, least, strict=True):
            assert bound <= distance(text, other)
    codes = np.full((2, 3), -1, np.int32)
    codes[0, :3], codes[1, :1] = [ord(c) for c in "abc"], [ord("a")]
    assert list(edit_distances("abd", codes, np.array([3, 1]))) == [1, 2]


def test_nearest_names_equal_a_plain_search(spark):
    draw = random.Random(4)
    names = ["".join(draw.choices("stone raking", k=draw.randint(1, 25))) for _ in range(400)] + ["", "Stone", "stone", "STONE"]
    targets = ["stone", "rakin stones", "", "zzz", names[7].upper(), names[9][:-1] + "x"]
    catalog = spark.createDataFrame(list(enumerate(names)), "item_id long, name string")
    wanted = spark.createDataFrame([(t,) for t in targets], "target string")
    found = {}
    for r in nearest_names(wanted, catalog).orderBy("target", "place").collect():
        found.setdefault(r["target"], []).append((r["distance"], r["item_id"]))
    for target in targets:
        plain = sorted((distance(target.lower(), name.lower()), i) for i, name in enumerate(names) if name)[:3]
        assert found[target] == plain
    work = {r["target"]: r for r in name_comparisons(wanted, catalog).collect()}
    assert all(r["n_names"] == 403 and r["n_compared"] <= 403 for r in work.values()) and work["stone"]["n_compared"] < 100
