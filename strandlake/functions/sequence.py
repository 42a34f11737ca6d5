"""Column functions on nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACTG", "TGAC"))


def fixed_length(s: Column, n: int) -> Column:
    return F.rpad(s, n, "N")


def one_hot(s: Column, strict: bool = False) -> Column:
    """An array of [A, C, G, T] for each letter; other letters are zero, or with strict an error where they aren't N or a code for several bases."""
    if strict:
        s = F.when(s.rlike("^[ACGTNYRMSWK]*$"), s).otherwise(F.raise_error(F.concat(F.lit("letters that are no bases: "), s)).cast("string"))
    return F.transform(F.split(s, ""), lambda c: F.array(*(F.when(c == b, 1).otherwise(0) for b in "ACGT")))


def from_one_hot(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda r: F.coalesce(F.get(F.array(*map(F.lit, "ACGT")), F.array_position(r, 1).cast("int") - 1), F.lit("N"))), "")


def base_count(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def gc_percent(s: Column, length: Column | None = None) -> Column:
    """Whole percent by integer arithmetic, rounding halves up; null for length 0."""
    n = F.length(s) if length is None else length
    return F.floor((F.lit(200) * base_count(s, "GC") + n) / F.nullif(2 * n, F.lit(0)))


def only_acgt(s: Column) -> Column:
    return s.rlike("^[ACGT]+$")


def centre(s: Column, n: int) -> Column:
    return s.substr(F.floor((F.length(s) - n) / 2).cast("int") + 1, F.lit(n))


def purine_forward(s: Column) -> Column:
    return 2 * base_count(s, "AG") > F.length(s)


def round_to_multiple(x: Column, y: int, up: bool = False) -> Column:
    return F.ceil(x / y) * y if up else x - x % y
