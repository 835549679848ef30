"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, on small fixtures."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import bpe, html_layout, language, line_runs, mixing, pii, quality_cascade, signatures, token_counts, vector_graph
from shelfwise.llm.frames import stored

LONG = "lorem ipsum " * 15 + "\n" + "dolor sit amet consectetur " * 14
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, size string, `_gone` int, `a.b` string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, LONG + "\nfirst", "la", "a"), (2, "other start\n" + LONG, "la", "b"), (3, None, None, None), (4, "", "la", "a"),
        (5, " \t\n", "la", None), (6, "x" * 50_000, "la", "a"), (7, "one two", "la", "a"), (7, "one two", "la", "a"), (None, "one two", "la", "b"),
        (8, "12345 ??", "la", "b"), (9, "word " * 20_000, "la", "c"),
    ]
    return spark.createDataFrame([(*r, "t", "s", 0, "q") for r in rows], SCHEMA)


OPERATORS = [
    (lambda d: token_counts.count_tokens(d, "word_bpe_49k.json"), True), (lambda d: bpe.encoding_digest(d, "word_bpe_49k.json"), True),
    (lambda d: bpe.with_encoding(d, "word_bpe_49k.json"), True), (language.identify, True), (language.keep_identified, False),
    (mixing.mix, True), (mixing.with_mix, False), (quality_cascade.judge, True), (line_runs.report, True), (line_runs.clean, True),
    (signatures.near_duplicates, True), (signatures.keep_one, False), (pii.find_personal_data, True), (pii.with_redaction, True),
]


@pytest.mark.parametrize("operator, every", OPERATORS)
def test_odd_rows_and_empty_tables(docs, operator, every):
    rows = operator(docs).collect()
    assert len(rows) == docs.count() if every else rows is not None
    assert operator(docs.limit(0)).collect() == []


def test_odd_vectors(spark):
    v = [1.0, 0.0, 0.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, [1.0, 0.01, 0.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1),
        (9, [1.0, None, 0.0], 1), (10, [1.0, float("nan"), 0.0], 1), (11, [float("inf"), 0.0, 0.0], 1), (12, [1e-300, 0.0, 0.0], 1), (None, v, 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_graph.near_duplicate_vectors(table).collect()}
    assert found[1] == found[2] == found[3] == found[12] == (3, 1)
    assert all(found[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and found[None] == (0, None)
    assert vector_graph.near_duplicate_vectors(table.limit(0)).collect() == []


def test_graph_search_finds_a_mass_of_near_copies():
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(size=(300, 32)), draw.normal(size=32) + 0.05 * draw.normal(size=(300, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = vector_graph.search(x, x, vector_graph.prune(x), 0.93, 32)
    assert not (found & (x @ x.T < 0.9299)).any() and found.sum() >= 0.99 * (x @ x.T >= 0.93).sum()


def test_chunks_are_spliced():
    draw = random.Random(3)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"), chunk=80, overlap=8)
    for _ in range(200):
        text = "".join(draw.choices("aeiéß Σ5<|endoftext|>\n'’🙂", k=draw.randint(80, 900)))
        assert counter.count_long(text) == len(library.encode(text, add_special_tokens=False))
    assert counter.widened


def test_speculation_equals_merging():
    coder = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(4)
    pieces = list({"".join(draw.choices("thenrasiouéing", k=draw.randint(1, 24))) for _ in range(3000)})
    exact = [[coder.vocab[t] for t in coder.merge(coder.symbols(piece))] for piece in pieces]
    assert coder.encode_pieces(pieces) == exact and 0 < coder.repaired < coder.checked


def test_mixed_text_is_split_into_spans(spark):
    rows = [(i, "la casa ñandú niño mañana " * 20, "es") for i in range(0, 40, 2)] + [(i, "the house with thought " * 20, "en") for i in range(1, 40, 2)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ~language.held_out(), "doc_id", "text", "lang")
    (found,) = model.predict(["the house thought with the house la casa mañana niño ñandú la casa"])
    assert [span[2] for span in found[2]] == ["en", "es"] and found[2][0][:2] == (0, 6)
    assert model.predict([None, "", "123"]) == [("und", 0.0, [])] * 3


def test_later_runs_go(docs):
    rows = {(r["doc_id"], r["text"]) for r in line_runs.clean(docs).select("doc_id", "text").collect()}
    assert (1, LONG + "\nfirst") in rows and (2, "other start") in rows


def test_added_personal_data():
    draw = random.Random(6)

    def line():
        return f"call me at +1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)} or mail joe{draw.randint(1, 99)}@mail.example.com today 2020-01-02 12345678901234 end"

    detector = pii.train([line() for _ in range(400)])
    text = "write to ann.lee [at] host.example [dot] org soon"
    assert "email" in {kind for kind, _, _ in detector.spans(text)[1]}
    assert detector.spans("nothing to see at the house")[1] == [] and detector.spans(None)[1] == []


def test_numbers_side_by_side():
    draw = random.Random(7)

    def card():
        digits = "".join(draw.choice("0123456789") for _ in range(15))
        return next(digits + last for last in "0123456789" if pii.luhn(digits + last))

    texts = [f"paid with {card()} then, from 10.{draw.randint(0, 255)}.{draw.randint(0, 255)}.7 or +1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)} on" for _ in range(400)]
    detector = pii.train(texts)

    def found(text):
        return [(kind, text[a:b]) for kind, a, b in detector.spans(text)[1]]

    assert found("sum 7536784127813050 4845168114407329 here") == [("card", "7536784127813050"), ("card", "4845168114407329")]
    assert found("tel 555-123-4567 555-987-6543 here") == [("phone", "555-123-4567"), ("phone", "555-987-6543")]
    assert found("sum 4111.1111.1111.1111 12/26 here") == [("card", "4111.1111.1111.1111")]
    assert found("tel 555-123-4567 2024-01-02 here") == [("phone", "555-123-4567")]
    assert found("seen 12345678901234567890123456789012 here") == []


def test_every_kind_is_learned_from_all_documents(spark, caplog):
    draw = random.Random(8)
    rows = [(i, f"seen from 10.{draw.randint(0, 255)}.{draw.randint(0, 255)}.{draw.randint(0, 255)} on") for i in range(300)] + [(300, "seen from 10. 2. 3. 4 on")]
    with caplog.at_level("WARNING"):
        found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[300] == "ip:10:21"
    assert "email, card, phone" in caplog.text


def test_layout():
    page = """<head><title>no</title></head><h1>A &amp; B</h1><p>one<br>two <b>bold</b><p hidden>gone<p>three
    <ul><li>x<li>y<ol start=3><li>z</ol></ul><table><tr><th>n<th>value<tr><td>1<td>long cell<tr><td colspan=2>all</table><script>var a="<p>";</script>
    <pre>a
  b</pre><div style="display:none">gone</div><!-- gone -->end <x<y"""
    laid_out = "A & B\n\none\ntwo bold\n\nthree\n\n- x\n- y\n  3. z\n\nn | value\n1 | long cell\nall\n\na\n  b\n\nend"
    assert html_layout.visible_text(page).startswith(laid_out)
    assert html_layout.visible_text(None) == html_layout.visible_text("") == ""
    assert html_layout.visible_text("<div>" * 5000 + "deep") == "deep"


def test_layout_of_pages_without_end_of_head():
    text = html_layout.visible_text
    assert text("<html><head><title>T</title><p>Hello <b>you</b><p>all") == "Hello you\n\nall"
    assert text("<head>\n<meta charset=x><style>p{}</style><script>a</script>\n Hello <div>you") == "Hello\nyou"
    assert text("<head><title>T</title></head><body><p>Hello") == text("<title>T</title><p>Hello") == "Hello"
    assert text("<head><noscript><p>no</p></noscript><template><p>no</p></template><br>Hello") == "Hello"


def test_layout_of_drawings_formulas_and_options():
    text = html_layout.visible_text
    assert text("<p>one <svg class=a /> two <math/> three") == "one two three"
    assert text("<p>one <svg><path d=x><g/><use/></svg> two") == "one two"
    assert text("<p>a <svg><title>no</title><desc>no</desc>no<g><text>in <tspan>it</tspan></text><text>and</text><rect/></g><defs><text>no</text></defs></svg> b") == "a in it and b"
    assert text("<svg><foreignObject><div>one<p>two</div></foreignObject><text>three</text></svg>") == "one\n\ntwo\n\nthree"
    assert text("<p>a <svg><g><p>b") == "a\n\nb"
    assert text("<p>x <math><mi>y</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> z") == "x y=1 z"
    assert text("<p>pick <select>no<option hidden>no<option selected>red<optgroup label=more><option>blue<option label=green>no</select> end") == "pick\nred\nmore\nblue\ngreen\nend"
    assert text("<datalist><option>no</datalist>end") == "end"


def test_every_small_source_gets_its_target(spark):
    rows = [(i, "word " * n, f"site{i}") for i, n in enumerate([1, 2, 5, 10, 20, 30, 40, 63, 64, 65, 90, 130, 200, 511] * 12)]
    rows += [(1000 + i, "word " * 2000, "large") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs).collect()
    small = [r for r in mixed if r["doc_id"] < 1000]
    assert len(mixed) == len(rows) and all(r["taken"] == max(1, int(r["target"])) for r in small if int(r["target"]) <= mixing.EXACT * mixing.BLOCK)
    assert {r["doc_id"] for r in mixing.with_mix(docs).select("doc_id").collect()} >= {r["doc_id"] for r in small}


def test_mix_is_known_by_place_for_nearly_all_rows(spark, monkeypatch):
    rows = [(i, "word " * (i % 90 + 1), "abc"[i % 3]) for i in range(3000)]
    rows += [(i, "other words", "b") for i in range(0, 40, 2)] + [(None, "no id", None), (5000, "", "a"), (5001, None, "c"), (5002, "lone", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tables = []
    monkeypatch.setattr(mixing, "stored", lambda df, *old: tables.append(stored(df, *old)) or tables[-1])
    found = Counter(tuple(r) for r in mixing.with_mix(docs).collect())
    taken, size = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        if r["taken"]:
            taken[r["doc_id"]] += r["taken"]
            size[r["doc_id"]] += r["size"]
    times = {i: max(1, int(taken[i] / size[i] + 0.5)) for i in taken}
    assert found == Counter({row: n * times[row[0]] for row, n in Counter(rows).items() if row[0] in times})
    # only these go through a shuffle with their texts
    listed = [t.count() for t in tables if set(t.columns) == {"_doc", "_right"}]
    assert len(listed) == 1 and listed[0] <= 30


def test_unlike_sets_share_no_minima():
    draw = np.random.default_rng(7)
    sets = draw.integers(0, 2**63, size=(3000, 400)).astype(np.uint64)
    values = np.array([signatures.signature(np.unique(s), 48) for s in sets])
    assert sum(len(column) - len(np.unique(column)) for column in values.T) <= 1
