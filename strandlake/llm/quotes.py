"""Quotation linking: conversations in reply order, without what they quote.

A message's lines have quote levels (leading '>' marks). Lines of one level between
blank lines or changes of level are a passage; its normalised text (white space as
single spaces, lower case) is hashed. A quoted passage is linked to the latest earlier
message of its conversation that has the passage among its own (level 0). The parent of
a message is the latest original of its passages of the lowest linked level. Linked
passages go from the text, with the line that introduces them; a quote without an
original stays, as its words are nowhere else.

Reply order: trees of parents are walked depth first, children by turn. thread_turn is the
turn of the tree's first message and reply_pos the place in the walk (0 for the first), so
(conv_id, thread_turn, reply_pos) puts each reply after what it answers and before the
next branch; messages that answer nothing keep the order of turns.

Links come from passages with the same hash in a conversation, kept only where somebody
quotes one, by sorted passes over STRIPE turns at a time with a table of what lies before
each, so neither a passage that everybody repeats nor a long conversation makes pairs or
one task's work. Places in the walk come from pointer doubling over the tree's tour, in
which every item has one successor, so a message with many replies is no hot key.
Messages without quotes are not shuffled, but for their passages' hashes.

Null texts have no passages and stay null; very long ones are parsed whole. Turns that
repeat within a conversation are one message for links; each keeps its row. Rows of null
conv_id or turn link nothing: thread_turn is the turn, reply_pos 0. Empty tables give no
rows; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

STRIPE = 1024
_MARK = re.compile(r"[ \t]*(?:>[ \t]?)+")
_QUOTES = r"(?:^|\n)[ \t]*>"
#: How mail programs introduce a quotation.
_HEADER = re.compile(r"\s*(?:On|Am|Le|El)\b.*(?:wrote|schrieb|a écrit|escribió) ?:\s*", re.S)


def parse(text: str) -> tuple[list[tuple[int, str]], list[int]]:
    """(level, normalised text) of all passages, and for each line the quoted passage that it belongs to or introduces, else -1."""
    passages: list[tuple[int, list[str]]] = []
    owner: list[int] = []
    own_line = -1  # the last line of the writer with words
    level_before, opened, waiting = 0, False, []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        m = _MARK.match(line)
        level, rest = (m[0].count(">"), line[m.end() :]) if m else (0, line)
        words = rest.split()
        owner.append(-1)
        if not level and words:
            waiting = []
        if words:
            if not opened or level != level_before:
                if level and own_line >= 0 and not level_before and _HEADER.fullmatch(lines[own_line]):
                    owner[own_line] = len(passages)
                    passages[-1][1].pop()
                passages.append((level, []))
            passages[-1][1].append(" ".join(words))
            if level:
                for k in [*waiting, i]:
                    owner[k] = len(passages) - 1
                waiting = []
            else:
                own_line = i
            opened, level_before = True, level
        else:
            opened = False
            if level and level_before and passages and not waiting:  # an empty quoted line ends the passage before it
                owner[i] = len(passages) - 1
            elif level:
                waiting.append(i)
    return [(k, " ".join(v).lower()) for k, v in passages], owner


def without(text: str, owner: list[int], gone: set[int]) -> str:
    """The text without the lines of some passages."""
    return "\n".join(line for line, k in zip(text.split("\n"), owner, strict=True) if k not in gone).strip("\n") if gone else text


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, place, level, hash: a row for each passage of messages (conv_id, turn, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                found = [(k, level, blake2b(p.encode(), digest_size=16).digest()) for k, (level, p) in enumerate(parse(t)[0] if t else []) if p]
                at += [i] * len(found)
                rows += found
            take = pa.array(at, pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], names=["conv_id", "turn", "place", "level", "hash"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in messages.schema.fields[:2])
    return messages.mapInArrow(run, f"{fields}, place int, level int, hash binary")


def latest_before(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """rows (read twice) with the greatest value of the keys' rows of lower turns, if any."""
    r = rows.withColumn("_v", value).withColumn("_s", F.floor(F.col("turn") / STRIPE))
    inside = F.max("_v").over(W.partitionBy(*keys, "_s").orderBy("turn").rangeBetween(W.unboundedPreceding, -1))
    stripes = r.groupBy(*keys, "_s").agg(F.max("_v").alias("_v"))
    carried = stripes.withColumn("_c", F.max("_v").over(W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1))).drop("_v")
    return r.withColumn("_i", inside).join(carried, [*keys, "_s"]).withColumn(name, F.coalesce("_i", "_c")).drop("_v", "_s", "_i", "_c")


def links(messages: DataFrame, quoting: Column) -> DataFrame:
    """conv_id, turn, place, level, original (a turn): of each quoted passage that has an original. messages: conv_id, turn (neither null), text."""
    quoted = checkpointed(passages(messages.filter(quoting)).filter("level > 0"))
    own = passages(messages).filter("level = 0").select("conv_id", "turn", "hash").distinct().join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    own = own.select("conv_id", "turn", F.lit(None).cast("int").alias("place"), F.lit(0).alias("level"), "hash")
    both = checkpointed(quoted.unionByName(own))
    seen = latest_before(both, ["conv_id", "hash"], F.when(F.col("level") == 0, F.col("turn")), "original")
    return seen.filter("level > 0 and original is not null").select("conv_id", "turn", "place", "level", "original")


def reply_order(parents: DataFrame) -> DataFrame:
    """conv_id, turn, parent (an earlier turn) -> conv_id, turn, thread_turn, reply_pos.

    The tour goes down to each message and up from it. Down comes after up from the sibling
    before, else after down to the parent; up comes after up from the last child, else after
    down to the message itself. Places are the downs so far, by pointer doubling.
    """
    p = checkpointed(parents.select("conv_id", "turn", "parent"))
    sibling = latest_before(p, ["conv_id", "parent"], F.col("turn"), "sibling")
    replies = p.select("conv_id", F.col("turn").alias("parent"), F.lit(True).alias("replies"))
    # only first children ask whether their parent is a reply itself: one row a parent
    first = sibling.filter("sibling is null").join(replies, ["conv_id", "parent"], "left")
    down = first.unionByName(sibling.filter("sibling is not null").withColumn("replies", F.lit(None).cast("boolean"))).select(
        "conv_id", "turn", F.lit(0).alias("side"),
        F.when(F.col("sibling").isNotNull(), F.col("sibling")).when(F.col("replies"), F.col("parent")).alias("to"), F.col("sibling").isNotNull().cast("int").alias("to_side"),
        F.lit(1).cast("long").alias("n"), F.when(F.col("sibling").isNull() & F.col("replies").isNull(), F.col("parent")).alias("top"),
    )
    last = p.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.max("turn").alias("child"))
    up = p.join(last, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.lit(1).alias("side"), F.coalesce("child", "turn").alias("to"), F.col("child").isNotNull().cast("int").alias("to_side"),
        F.lit(0).cast("long").alias("n"), F.lit(None).cast(parents.schema["parent"].dataType).alias("top"),
    )
    state = checkpointed(down.unionByName(up))
    while not state.filter("to is not null").isEmpty():
        far = state.select("conv_id", F.col("turn").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("_to"), F.col("to_side").alias("_side"), F.col("n").alias("_n"), F.col("top").alias("_top"))
        # items that have arrived stay out of the join, where all of a conversation would share one key
        step = state.filter("to is not null").join(far, ["conv_id", "to", "to_side"])
        state = checkpointed(state.filter("to is null").unionByName(step.select("conv_id", "turn", "side", F.col("_to").alias("to"), F.col("_side").alias("to_side"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("top", "_top").alias("top"))))
    return state.filter("side = 0").select("conv_id", "turn", F.col("top").alias("thread_turn"), F.col("n").alias("reply_pos"))


def _rendered(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text, gone (places), and more: text without these, n_quotes, n_linked."""
    new = {"n_quotes": "long", "n_linked": "long"}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, quotes, linked = [], [], []
            for t, gone in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found, owner = parse(t) if t else ([], [])
                texts.append(without(t, owner, set(gone)) if gone else t)
                quotes.append(sum(level > 0 for level, _ in found))
                linked.append(len(gone or []))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), *batch.columns[4:], pa.array(quotes, pa.int64()), pa.array(linked, pa.int64())], names=[*batch.schema.names, *new])

    return rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"{k} {v}" for k, v in new.items())]))


def conversations(messages: DataFrame) -> DataFrame:
    """op2: conv_id, turn, role, text, n_quotes, n_linked, parent_turn, thread_turn, reply_pos; a row for each message."""
    rows = messages.select("conv_id", "turn", "role", "text")
    quoting = F.coalesce(F.col("text").rlike(_QUOTES), F.lit(False))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    linked = checkpointed(links(rows.filter(known).select("conv_id", "turn", "text"), quoting))
    facts = linked.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("original")).alias("o"))).alias("m"), F.collect_set("place").alias("gone"))
    facts = checkpointed(facts.select("conv_id", "turn", (-F.col("m.o")).alias("parent"), "gone"))
    order = reply_order(facts)
    out = [F.col("parent").alias("parent_turn"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("reply_pos", F.lit(0)).cast("long").alias("reply_pos")]
    base = ["conv_id", "turn", "role", "text"]
    joined = rows.filter(quoting & known).join(facts, ["conv_id", "turn"], "left").join(order, ["conv_id", "turn"], "left")
    nothing = [F.lit(None).cast("array<int>").alias("gone"), *(F.lit(None).cast("long").alias(c) for c in ("parent", "thread_turn", "reply_pos"))]
    changed = _rendered(joined.select(*base, "gone", "parent", "thread_turn", "reply_pos").unionByName(rows.filter(quoting & ~known).select(*base, *nothing)))
    plain = rows.filter(~quoting).select(*base, F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), *nothing[1:])
    both = changed.drop("gone").unionByName(plain)
    return both.select(*base, "n_quotes", "n_linked", *out)
