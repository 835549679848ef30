"""Pages and texts that a careless scan would read again and again, and tables whose cells span rows."""

import re
import time

import pytest

from shelfwise.llm import html_layout, pii

PAGES = ["<a " * 300_000, '<a ">"' * 150_000, "<!-- >" * 150_000, "<div>" * 150_000, "<p><button>" + "<div>" * 150_000, "<div>" * 80_000 + "</x>" * 80_000]


@pytest.mark.parametrize("page", PAGES)
def test_a_megabyte_of_open_tags(page):
    start = time.perf_counter()
    html_layout.visible_text(page)
    assert time.perf_counter() - start < 30


def test_open_tags_and_comments():
    text = html_layout.visible_text
    assert text('<p title="a>b">one</p><p title="c>two') == "one\n\ntwo"
    assert text("<!-- a > b <!-- c > d") == "b d"
    assert text("<!-- a > b --> c") == "c"
    assert text("one <a href=x") == "one <a href=x"


def test_cells_that_span_rows():
    text = html_layout.visible_text
    assert text("<table><tr><td rowspan=2>A<td>B<tr><td>C<td>D</table>") == "A | B\n  | C | D"
    assert text("<table><tr><td>x<td rowspan=3 colspan=2>yy<tr><td>z<tr><td>w<td>last<tr><td>1<td>2</table>") == "x | yy\nz |\nw |      | last\n1 | 2"  # two columns of 1 and 0, and the bar between them
    assert text("<table><tr><td>日本<td>x<tr><td>ab<td>y</table>") == "日本 | x\nab   | y"


def test_pages_as_a_table(spark):
    rows = [(1, "<p>a", "x", 1), (1, "<p>a", "y", 2), (2, None, "x", 3), (None, "", None, 4)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    found = sorted(map(tuple, html_layout.extract_text(pages).collect()), key=str)
    assert found == sorted([(1, "a", 1, 1), (1, "a", 1, 1), (2, "", 0, 0), (None, "", 0, 0)], key=str)
    assert html_layout.extract_text(pages.limit(0)).collect() == []


def test_addresses_in_long_runs_of_digits():
    plain = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    for source in ("1.2.3.4.5.6.7.8.9", "12.34.5.6a7.8.9.10", "1..2.3.4.5", "0001.2.3.4 999.1.1.1"):
        assert [m.span() for m in pii._IP.finditer(source)] == [m.span() for m in plain.finditer(source)]
    start = time.perf_counter()
    assert not pii.base_spans("7" * 1_000_000)["ip"]
    assert time.perf_counter() - start < 10
