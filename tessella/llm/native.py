"""Spans of regular expressions, in code points, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches are summed up in stretches of this many, so that positions cost no square of their number.
STRETCH = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda t, x: t + x)


def running_max(values: Column) -> Column:
    """The largest of the values up to each of them; of a stretch first, then of those before it."""

    def of(v: Column) -> Column:
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int")), lambda b: F.array_max(F.slice(v, b * STRETCH + 1, STRETCH)))
        place = lambda t: F.transform(v, lambda _, i: F.greatest(F.array_max(F.slice(t, 1, F.floor(i / STRETCH).cast("int"))), F.array_max(F.slice(v, F.floor(i / STRETCH).cast("int") * STRETCH + 1, i % STRETCH + 1))))
        return let(tops, place)

    return let(values, of)


FOUND = "array<struct<start:int,end:int,value:string>>"


def _cut(text: Column, pattern: str) -> Column:
    """The matches of a pattern, and the lengths of what lies before, between and after them."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))


def _placed(s: Column) -> Column:
    """FOUND of one or more matches, cut by _cut."""
    step = F.zip_with(s["values"], F.slice(s["gaps"], 1, F.size(s["values"])), lambda v, g: F.length(v) + g)
    sums = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(s["values"]) - 1) / STRETCH).cast("int")), lambda b: total(F.slice(a, b * STRETCH + 1, STRETCH)))
    prefix = lambda a: F.transform(a, lambda _, b: total(F.slice(a, 1, b)))
    place = lambda q: F.transform(
        s["values"],
        lambda v, i: let(
            F.element_at(q["prefix"], F.floor(i / STRETCH).cast("int") + 1) + total(F.slice(q["step"], F.floor(i / STRETCH).cast("int") * STRETCH + 1, i % STRETCH + 1)),
            lambda end: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")),
        ),
    )
    return let(step, lambda st: let(let(sums(st), prefix), lambda p: place(F.struct(p.alias("prefix"), st.alias("step")))))


def found(text: Column, pattern: str) -> Column:
    """FOUND: (start, end, value) of the leftmost matches that do not overlap, in order. The pattern matches no empty string."""
    spans = let(_cut(text, pattern), lambda s: F.when(F.size(s["values"]) > 0, _placed(s)))
    return F.coalesce(spans, F.lit(None).cast(FOUND), F.array().cast(FOUND))


def found_each(text: Column, patterns: list[tuple[Column, str]]) -> Column:
    """Array of FOUND, one for each (test, pattern); a text that fails the test has none. Smaller a plan than so many of `found`."""
    cuts = F.array(*(F.when(test, _cut(text, pattern)) for test, pattern in patterns))
    return F.transform(cuts, lambda s: F.when(F.size(s["values"]) > 0, _placed(s)).otherwise(F.array().cast(FOUND)))


def where(test: Column, spans: Column) -> Column:
    """Spans of texts that pass a cheap test, which all texts with a match pass."""
    return F.when(test, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def named(spans: Column, kind: str, order: int) -> Column:
    """Spans as (start, order, kind, end), which sort as they are listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted named spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])
