"""Column helpers for work on the matches inside one row, all of them native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    return F.translate(text, _UPPER, _LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_Step = Callable[[Column, Column], Column]


def _running(steps: Column, start: Column, step: _Step) -> Column:
    """The fold of ``start`` and the steps before each step; appending makes it quadratic, so ``steps`` must be short."""
    first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(steps, first, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def _prefixes(steps: Column, zero: int, step: _Step) -> Column:
    """For each element of an array of longs the fold of those before it.

    Folds run inside blocks of about the square root of the length and over the
    block totals, so n steps cost n**1.5 and not n**2 element copies.
    """
    start = F.lit(zero).cast("bigint")

    def blocked(xs: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))

        def with_width(b: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, b), lambda at: F.slice(xs, at + 1, b))

            def with_blocks(parts: Column) -> Column:
                totals = F.transform(parts, lambda p: F.aggregate(p, start, step))
                return let(_running(totals, start, step), lambda starts: F.flatten(F.transform(parts, lambda p, i: _running(p, F.get(starts, i), step))))

            return let(blocks, with_blocks)

        return let(width, with_width)

    return F.when(F.size(steps) > 0, let(steps, blocked)).otherwise(F.array().cast("array<bigint>"))


def prefix_sums(steps: Column) -> Column:
    """Exclusive prefix sums of an array of longs."""
    return _prefixes(steps, 0, lambda a, x: a + x)


def prefix_maxima(steps: Column) -> Column:
    """For each element of an array of longs the largest one before it, -1 for the first."""
    return _prefixes(steps, -1, lambda a, x: F.greatest(a, x))


def match_spans(text: Column, pattern: Column, group: int = 0, shift: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, found), in code points.

    ``found`` is the text of ``group``.  Split parts and matches alternate, so
    the running sum of their lengths gives every start in one pass.
    """
    as_long = lambda xs: F.transform(xs, lambda x: F.length(x).cast("bigint"))
    base = F.lit(0).cast("bigint") if shift is None else shift

    def spans(whole: Column, gaps: Column, found: Column) -> Column:
        steps = F.zip_with(gaps, whole, lambda g, m: g + m)
        starts = F.zip_with(prefix_sums(steps), gaps, lambda s, g: s + g + base)
        ends = F.zip_with(starts, whole, lambda s, m: s + m)
        return F.zip_with(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end"))), found, lambda p, f: F.struct(p["start"].alias("start"), p["end"].alias("end"), f.alias("found")))

    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    found = F.regexp_extract_all(text, pattern, F.lit(group))
    parts = F.split(text, pattern, -1)
    return let(as_long(whole), lambda w: let(F.slice(as_long(parts), F.lit(1), F.size(w)), lambda g: spans(w, g, found)))
