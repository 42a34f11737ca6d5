"""Quotation linking against a plain linker over random conversations, and its edge cases."""

import random

from pyspark.sql import functions as F

from strandlake.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def invented(rng, conv, n):
    """Messages that quote earlier ones, nested, in part, after other words, and sometimes what nobody wrote."""
    out = []
    for turn in range(n):
        lines = []
        for _ in range(rng.randrange(3)):
            if out and rng.random() < 0.8:
                old = rng.choice(out).split("\n")
                a = rng.randrange(len(old))
                if rng.random() < 0.3:
                    lines.append("On Monday, X wrote:")
                lines += [f"> {x}" if rng.random() < 0.8 else f">  {x} " for x in old[a : a + rng.randrange(1, 5)]]
            else:
                lines.append(f">>> nobody {rng.randrange(50)}")
            lines += ["", f"Reply {rng.randrange(12)} here"][rng.randrange(2) :]
        lines += [f"own {rng.randrange(30)}", "", "bye"][: rng.randrange(1, 4)]
        out.append("\n".join(lines))
    return [(conv, t, "u", x) for t, x in enumerate(out)]


def plain(rows):
    """conv, turn -> text, n_quotes, n_linked, parent, thread, place, by looking at every earlier message."""
    out = {}
    for conv in {r[0] for r in rows}:
        said, parent, children = {}, {}, {}
        for _, turn, _, text in sorted(r for r in rows if r[0] == conv):
            found, owner = quotes.parse(text)
            gone, best = set(), []
            for k, (level, p) in enumerate(found):
                before = [t for t, own in said.items() if p and level and p in own]
                if before:
                    gone.add(k)
                    best.append((level, -max(before)))
            said[turn] = {p for level, p in found if not level and p}
            kept = [x for x, k in zip(text.split("\n"), owner, strict=True) if k not in gone]
            if best:
                parent[turn] = -min(best)[1]
                children.setdefault(parent[turn], []).append(turn)
            out[conv, turn] = ["\n".join(kept).strip("\n") if gone else text, sum(level > 0 for level, _ in found), len(gone), parent.get(turn)]

        for top in (t for c, t in list(out) if c == conv and t not in parent):
            walk, waiting = [], [top]
            while waiting:
                walk.append(waiting.pop())
                waiting += sorted(children.get(walk[-1], []), reverse=True)
            for place, turn in enumerate(walk):
                out[conv, turn] += [top, place]
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, r.parent_turn, r.thread_turn, r.reply_pos) for r in quotes.conversations(df).collect()}


def test_against_a_plain_linker(spark, monkeypatch):
    rng = random.Random(4)
    rows = [r for conv in range(12) for r in invented(rng, conv, rng.randrange(1, 25))]
    want = plain(rows)
    assert sum(v[2] for v in want.values()) > 40 and sum(v[1] > v[2] for v in want.values()) > 10 and any(v[5] > 3 for v in want.values())
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df) == want
    monkeypatch.setattr(quotes, "STRIPE", 3)
    assert got(df) == want


def test_quotes_nobody_wrote_stay(spark):
    text = "look:\n>>> import os\n>>> os.getcwd()\nfails"
    assert got(spark.createDataFrame([(1, 0, "u", text)], SCHEMA)) == {(1, 0): (text, 1, 0, None, 0, 0)}


def test_branches_do_not_interleave(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "> a\nb"), (1, 2, "u", "> a\nc"), (1, 3, "u", "> b\nd"), (1, 4, "u", "> c\ne"), (1, 5, "u", "f")]
    out = sorted((r.thread_turn, r.reply_pos, r.turn) for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [t for _, _, t in out] == [0, 1, 3, 2, 4, 5]


def test_long_chains_and_many_replies(spark):
    rows = [(1, i, "u", (f"> m{i - 1}\n" if i else "") + f"m{i}") for i in range(70)] + [(2, i, "u", f"> first\nr{i}" if i else "first") for i in range(70)]
    out = {(r.conv_id, r.turn): (r.thread_turn, r.reply_pos) for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {(c, i): (0, i) for c in (1, 2) for i in range(70)}


def test_nulls_repeats_long_texts_and_clashes(spark):
    long = "x " * 300_000
    rows = [
        (1, 0, "u", "Hello there\nfriend\n\nSecond par"), (1, 1, "a", "On Monday, X wrote:\n> hello  there\n> friend\nMy answer"), (1, 3, "u", "> second par\nreply"),
        (1, 3, "u", "> second par\nreply"), (2, 0, "u", "> hello there friend\nother"), (None, 4, "u", None), (3, None, "u", "> x"), (4, 0, "u", long), (4, 1, "u", f"> {long}\nyes"), (5, 0, None, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("a.b", F.lit(1))
    out = sorted((str(r.conv_id), str(r.turn), (r.text or "")[:9], r.n_quotes, r.n_linked, r.parent_turn, r.thread_turn) for r in quotes.conversations(df).collect())
    assert out == [
        ("1", "0", "Hello the", 0, 0, None, 0), ("1", "1", "My answer", 1, 1, 0, 0), ("1", "3", "reply", 1, 1, 0, 0), ("1", "3", "reply", 1, 1, 0, 0), ("2", "0", "> hello t", 1, 0, None, 0),
        ("3", "None", "> x", 1, 0, None, None), ("4", "0", "x x x x x", 0, 0, None, 0), ("4", "1", "yes", 1, 1, 0, 0), ("5", "0", "", 0, 0, None, 0), ("None", "4", "", 0, 0, None, 4),
    ]
    assert quotes.conversations(df.limit(0)).count() == 0
