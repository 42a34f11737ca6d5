"""Cells at their exact columns, whatever spans and sizes their tables have."""

import random
import re

import pytest

from strandlake.llm import html_text, queries
from strandlake.llm.html_text import aligned, visible_text


def test_spans_over_many_columns_count():
    assert visible_text("<table><tr><td colspan=1000 rowspan=3>a<td>x<tr><td>b<tr><td>c</table>") == "a  x\n   b\n   c"


def test_a_cell_from_above_stays_below_a_shorter_one():
    page = "<table><tr><td>p<td rowspan=4>q<tr><td colspan=2 rowspan=2>r<tr><td>s<tr><td>t<td>u</table>"
    assert visible_text(page) == "p  q\nr\n      s\nt     u"


def test_only_white_space_that_is_written_counts():
    long = "w" * 3000
    page = "<table>" + "<tr><td>a<td>b" * 100 + f"<tr><td>long name<td>{long}</table>"
    assert visible_text(page).split("\n") == ["a          b"] * 100 + [f"long name  {long}"]


def test_many_wide_cells_stay_aligned():
    page = "<table><tr>" + "<td>a" * 200 + "<tr>" + "<td>aa" * 200 + "<tr><td colspan=200>b" * 100 + "</table>"
    assert visible_text(page).split("\n") == ["a   " * 199 + "a", "aa  " * 199 + "aa"] + ["b"] * 100


def grid_of(rows):
    """Each cell's first column: cells of (text, columns, rows) placed one by one."""
    taken, out = set(), []
    for r, row in enumerate(rows):
        c, here = 0, []
        for _, across, down in row:
            while (r, c) in taken:
                c += 1
            here.append(c)
            taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
            c += across
        out.append(here)
    return out


@pytest.mark.parametrize("growth", [16, float("inf")])
def test_placed_as_in_a_plain_grid(growth):
    rng = random.Random(5)
    for _ in range(150):
        rows = [[(f"t{rng.randrange(10 ** rng.randrange(1, 4))}", rng.choice((1, 1, 2, 7, 60)), rng.choice((1, 1, 2, 3, 30))) for _ in range(rng.randrange(1, 7))] for _ in range(rng.randrange(1, 12))]
        lines = aligned([[([t], a, d) for t, a, d in row] for row in rows], growth)
        start = {}
        for line, row, columns in zip(lines, rows, grid_of(rows), strict=True):
            found = [(m[0], m.start()) for m in re.finditer(r"\S+", line)]
            assert [t for t, _ in found] == [t for t, _, _ in row]
            for c, (_, at) in zip(columns, found, strict=True):
                assert start.setdefault(c, at) == at, (rows, lines)
        assert [start[c] for c in sorted(start)] == sorted(set(start.values()))


def test_the_query_pads_every_table(spark, tmp_path):
    n = 1000
    wide = f"<table><tr><td>{'w' * 10 * n}<td>y{'<tr><td>a<td>b' * n}</table>"
    pages = spark.createDataFrame([(i, "u", None if i == 3 else wide if i % 2 else "<p>x") for i in range(12)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.queries()["op9_html"](spark, str(tmp_path)).selectExpr("page_id", "length(text) as n", "substring(text, 1, 30) as a", "right(text, 10003) as z").collect()}
    assert len(got) == 12 and got[3].n is None and got[4].a == "x" and got[1].a == "w" * 30
    assert {r.n for i, r in got.items() if i % 2 and i != 3} == {(10 * n + 3) * (n + 1) + n} and got[5].z == "a" + " " * (10 * n + 1) + "b"
    assert 5 * got[1].n > html_text.TOGETHER  # so these rows came in several batches
