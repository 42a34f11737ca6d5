"""Visible text against expected layouts and a plain renderer, hostile pages, and edge cases."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from strandlake.llm import html_text
from strandlake.llm.html_text import visible_text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<title>x</title><h1>A  b</h1><p>one<p>two <b>x</b>y<ul><li>a<li>b<ol><li>c<li>d</ol></ul><table><tr><th>n<th>long name<tr><td>1<td>2</table><div hidden>zz</div><div style='display:none'>q<p>r</div><pre>a\n  b</pre>end<br>z<script>var t='</p>'</script>", "A b\n\none\n\ntwo xy\n\n- a\n- b\n  1. c\n  2. d\n\nn  long name\n1  2\n\na\n  b\n\nend\nz"),
        ("<table><tr><td rowspan=2>A<td>1<tr><td>2</table>", "A  1\n   2"),
        ("<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>", "wide cell  x\na  b       c"),
        ("<select><option>a<option selected>b</select> <select><option>c<option>d</select> <select multiple><option>e<option>f</select>", "b\nc\ne\nf"),
        ("<math><mi>x</mi><annotation>tex</annotation></math> <svg><title>t</title><text>lab</text></svg> <span aria-hidden=true>*</span>", "x lab *"),
        ("<style>.x, p.y{display:none} @media print{.z{display:none}} #k{display:block} i{visibility:hidden}</style><p class=x>no<p class=y>no<p class=z>yes<p class=x id=k>yes<i>h<b style='visibility:visible'>s</b></i>", "yes\n\nyess"),
        ("a &amp; b<td>c</tr></p>", "a & b\nc"), ("", ""), ("<b>x</i></b></b>y", "xy"), ("<textarea>a\nb</textarea>", "a\nb"),
        ("<p style='display:inline'>a</p><div style='visibility:hidden'>b</div>c", "a\n\nc"),
    ],
)
def test_layouts(page, want):
    assert visible_text(page) == want


def invented(rng, depth=0):
    """A page's part and the words that show, in order."""
    word = f"w{rng.randrange(1000)}"
    kind = rng.randrange(9 if depth < 4 else 2)
    if kind < 2:
        return f"{word} ", [word]
    inner = [invented(rng, depth + 1) for _ in range(rng.randrange(1, 4))]
    body, shown = "".join(a for a, _ in inner), [w for _, v in inner for w in v]
    if kind == 2:
        return f"<div>{body}</div>", shown
    if kind == 3:
        return f"<p>{word} <b>{word}</b></p>", [word, word]
    if kind == 4:
        return f"<ul>{''.join(f'<li>{a}</li>' for a, _ in inner)}</ul>", shown
    if kind == 5:
        cells = [[f"c{rng.randrange(1000)}" for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in cells) + "</table>", [c for r in cells for c in r]
    hide = ("<div hidden>{}</div>", '<div style="display: none">{}</div>', "<div class=gone>{}</div>", "<script>{}</script>", "<!-- {} -->", '<span style="visibility:hidden">{}</span>')
    return rng.choice(hide).format(word if kind == 8 else re.sub("<!--.*?-->|<script>.*?</script>", "", body, flags=re.S)), []


def test_all_visible_words_and_no_others():
    rng = random.Random(12)
    for _ in range(400):
        parts = [invented(rng) for _ in range(4)]
        page = "<style>.gone{display:none}</style>" + "".join(a for a, _ in parts)
        assert [w for w in visible_text(page).split() if w != "-"] == [w for _, v in parts for w in v], page


def columns_of(rows):
    """A plain grid: cells (text, columns, rows spanned) placed one by one."""
    grid = {}
    for r, row in enumerate(rows):
        c = 0
        for k, (text, across, down) in enumerate(row):
            while (r, c) in grid:
                c += 1
            for i in range(down):
                for j in range(across):
                    grid.setdefault((r + i, c + j), text if not i and not j else "")
    return grid


def test_cells_stand_below_their_columns():
    rng = random.Random(3)
    for _ in range(300):
        rows = [[(f"t{rng.randrange(10 ** rng.randrange(1, 6))}", rng.choice((1, 1, 1, 2)), rng.choice((1, 1, 1, 2))) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 5))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}</td>" for t, a, d in row) + "</tr>" for row in rows) + "</table>"
        lines = visible_text(html).split("\n")
        grid = columns_of(rows)
        start = {}
        for r, row in enumerate(rows):
            words = [(m[0], m.start()) for m in re.finditer(r"\S+", lines[r])]
            placed = sorted((c, t) for (rr, c), t in grid.items() if rr == r and t)
            assert [w for w, _ in words] == [t for _, t in placed]
            for (c, _), (_, at) in zip(placed, words, strict=True):
                assert start.setdefault(c, at) == at, (html, lines)
        assert [start[c] for c in sorted(start)] == sorted(start.values())


def test_hostile_pages_take_linear_time():
    n = 20_000
    pages = ["<b>" * n + "</i>" * n, "<i><table>" + "<b>" * n + "</i>" * n, "<table><tr><td>x" * n, "<ul><li>x" * n, "<table><tr>" + "<td rowspan=60000>a" * n + "<tr><td>b" * n, "<table><tr><td>" + "x" * n * 10 + "<td>y" + "<tr><td>a<td>b" * n]
    pages += ["<table>" + "<tr><td colspan=1000>a<td>b" * n, "<select>" * n + "<option>a" * n, "<style>.a{display:none}</style><p class='a b'>" * n, "<style>" + ".a{display:none}" * n + "</style>" + "<p class=a>" * n, "<div>" * n + "deep"]
    for page in pages:
        t = time.process_time()
        text = visible_text(page)
        assert time.process_time() - t < 10 and len(text) < 64 * len(page) + 1000, page[:40]


def test_html_query(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").withColumn("text", F.lit(3)).withColumn("a.b", F.lit(1))
    rows = html_text.extract(pages).collect()
    assert len(rows) == pages.count() and all(r.text and "track(" not in r.text for r in rows)
    some = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "<p>" + "word " * 200_000)], "page_id long, html string")
    assert sorted(len(r.text) if r.text is not None else -1 for r in html_text.extract(some).collect()) == [-1, -1, 0, 999_999]
    assert html_text.extract(some.limit(0)).count() == 0


def test_selectors_of_descendants_and_children():
    css = "<style>div > p.x{display:none} .a .b{display:none} #k > .m > i , ul li em{visibility:hidden} .a .b.c{display:none} nav > {display:none}</style>"
    page = css + "<div><p class=x>one</p><section><p class=x>two</p></section></div><p class=b>three</p><div class=a><span><i class=b>four</i></span>five</div><div id=k><b class=m><i>six</i><s><i>seven</i></s></b></div><ul><li>eight <b><em>nine</em></b></ul><nav>ten</nav>"
    assert html_text.visible_text(page).split() == ["two", "three", "five", "seven", "-", "eight", "ten"]
    # the more exact selector wins, then the later one
    assert html_text.visible_text("<style>.a p{display:none} .a p.s{display:block} div p{display:none}</style><div class=a><p class=s>x</p><p>y</p></div>") == "x"


def test_closed_details_ruby_and_inputs():
    page = "<details><summary>more</summary>hidden <p>too</p></details><details open><summary>s</summary>shown</details>"
    assert html_text.visible_text(page).split() == ["more", "s", "shown"]
    assert html_text.visible_text("<details>no summary</details>a") == "a"
    assert html_text.visible_text("<ruby>x<rp>(</rp><rt>y</rt><rp>)</rp></ruby>") == "xy"
    assert html_text.visible_text('a <input value=b> <input type=PASSWORD value=c> <input type=checkbox value=d> <input type=email value=e> <input type=hidden value=f>') == "a b e"


def test_block_spacing_and_list_markers():
    page = "<h1>t</h1><p>a<p>b<div>c</div><div>d</div><ul><li>x<ul><li>y<li>z</ul><li>w</ul><ol><li>1<li>2</ol>e<br><br>f<pre>  g\n h</pre>"
    assert html_text.visible_text(page) == "t\n\na\n\nb\n\nc\nd\n\n- x\n  - y\n  - z\n- w\n\n1. 1\n2. 2\n\ne\n\nf\n\n  g\n h"


def test_bounds_on_white_space_can_be_lifted():
    rows = "<tr><td>a<td>b</tr>" * 40
    wide = f"<table>{rows}<tr><td>{'w' * 3000}<td>c</tr></table>"
    plain = html_text.visible_text(wide).split("\n")
    padded = html_text.visible_text(wide, growth=None).split("\n")
    assert plain[0] == "a  b" and padded[0] == "a" + " " * 3001 + "b" and [x.split() for x in plain] == [x.split() for x in padded]
    deep = "<ul><li>x" * 50
    assert html_text.visible_text(deep).split("\n")[-1] == " " * 64 + "- x" and html_text.visible_text(deep, deep=None).split("\n")[-1] == " " * 98 + "- x"
