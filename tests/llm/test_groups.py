"""Near-duplicate groups of rows whose ids repeat or are missing, against a comparison of all rows."""

import collections
import random

import numpy as np
import pytest
from test_queries import Groups, shingles

from shelfwise.llm import frames, signatures, vector_graph

DRAW = random.Random(9)


def text(words=60):
    return " ".join("".join(DRAW.choices("abcdefghij", k=6)) for _ in range(words))


def altered(source):
    words = source.split(" ")
    words[DRAW.randrange(len(words))] = "changed"
    return " ".join(words)


def brute(rows, words, by_id):
    sets = [shingles(t, words) for _, t in rows]
    groups = Groups(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                groups.join(i, j)
            if by_id and rows[i][0] is not None and rows[i][0] == rows[j][0] and a and sets[j]:
                groups.join(i, j)
    return sets, [groups.top(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    a, b, c, d = text(), text(), text(), text()
    found = [(5, a), (5, b), (8, altered(b)), (9, altered(b)), (7, altered(a)), (None, c), (None, c), (None, altered(c)), (None, d), (20, altered(d))]
    found += [(30, text()), (30, found[0][1]), (31, None), (31, None), (None, None), (32, ""), (33, " \n "), (34, "one two"), (34, "one two"), (35, "ONE  two")]
    return found + [(40, "e " + e) for e in [text()] for _ in range(50)] + [(41, text()), (41, text())]


SCHEMA = "doc_id long, text string"


def test_rows_of_one_id_are_joined(spark, rows):
    sets, tops = brute(rows, 4, True)
    ids = collections.defaultdict(list)
    for (i, _), top, words in zip(rows, tops, sets, strict=True):
        if i is not None and words:
            ids[top].append(i)
    wanted = collections.Counter()
    for (i, _), top, words in zip(rows, tops, sets, strict=True):
        component = (min(ids[top]) if ids[top] else None) if words else i
        wanted[i, len(words), component, i == component] += 1
    found = signatures.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=4)
    assert collections.Counter(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect()) == wanted


def test_one_row_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], SCHEMA + ", `_group` int, `_first` string")
    sets, tops = brute(rows, 5, False)
    kept = signatures.keep_one(docs).collect()
    numbers = [r["_group"] for r in kept]
    assert list(kept[0].asDict()) == docs.columns and len(set(numbers)) == len(numbers)
    assert {n for n in range(len(rows)) if not sets[n]} <= set(numbers)
    worded = [n for n in numbers if sets[n]]
    assert sorted(tops[n] for n in worded) == sorted({top for top, words in zip(tops, sets, strict=True) if words})
    for n in worded:
        assert (rows[n][0] is None, rows[n][0] or 0) == min((rows[m][0] is None, rows[m][0] or 0) for m in range(len(rows)) if tops[m] == tops[n])
    assert sorted(r["_group"] for r in signatures.keep_one(docs).collect()) == sorted(numbers)


def test_full_filters_drop_nothing_else(spark, monkeypatch):
    monkeypatch.setattr(frames, "FILTER_BITS", 64)
    docs = spark.range(500).selectExpr("if(id % 50 = 0, null, id) AS a", "CAST(id AS string) AS b")
    key = (frames.quoted("a"), frames.quoted("b"))
    left = frames.without(docs, key, docs.filter("CAST(b AS int) % 4 = 0"), docs)
    assert sorted(int(r["b"]) for r in left.collect()) == [i for i in range(500) if i % 4]


def test_vectors_of_one_id_are_joined(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(60, 12))
    rows = []
    for i in range(400):
        vector = base[i % 60] + 0.12 * draw.normal(size=12) * (i % 3 > 0)
        rows.append((int(i - i % 7 * (i % 5 == 0)), [float(v) for v in vector], int(i % 60 % 4)))
    rows += [(500, rows[0][1], 0), (500, rows[1][1], 1), (None, rows[0][1], 0), (501, None, 0), (501, rows[2][1], 2)] + [(600 + i, rows[3][1], 3) for i in range(40)]
    x = [np.array(v) / np.linalg.norm(v) if v and i is not None else None for i, v, _ in rows]
    groups, counts = Groups(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(x):
        for j, b in enumerate(x):
            if i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and a @ b >= 0.93:
                counts[i] += 1
                groups.join(i, j)
            if i != j and a is not None and b is not None and rows[i][0] == rows[j][0]:
                groups.join(i, j)
    lowest = {}
    for i, (name, _, _) in enumerate(rows):
        if name is not None:
            lowest[groups.top(i)] = min(name, lowest.get(groups.top(i), name))
    wanted = collections.Counter()
    for i, (name, _, _) in enumerate(rows):
        component = name if x[i] is None else lowest[groups.top(i)]
        wanted[name, counts[i], component, name == component] += 1
    table = spark.createDataFrame([(*r, 0, "n") for r in rows], "vec_id long, embedding array<double>, label int, rep int, name string")
    found = vector_graph.near_duplicate_vectors(table).select("vec_id", "n_links", "component_id", "kept")
    assert collections.Counter(tuple(r) for r in found.collect()) == wanted
