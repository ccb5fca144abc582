"""Pattern matches with their places, in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut_at(text: Column, pattern: str, *groups: int) -> Column:
    """Array of structs (before, g0, g1, ...): the text before each match and the asked groups.

    Matches are leftmost and do not overlap. The last element has what follows the last match and
    null groups. The parts before the matches and the matches together are the text.
    """
    names = ["before", *(f"g{g}" for g in groups)]
    columns = [F.split(text, pattern, -1), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups)]
    return F.arrays_zip(*(c.alias(n) for c, n in zip(columns, names)))


STEP = 64  # values in a block of running sums


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + v)


def _sums_within(values: Column) -> Column:
    """Running sums of a short array of numbers."""
    return F.transform(values, lambda _, i: _sum(F.slice(values, F.lit(1), i + 1)))


def _blocks(values: Column) -> Column:
    n = F.size(values)
    begins = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    return F.transform(begins, lambda b: F.slice(values, b + 1, F.lit(STEP)))


def _over_blocks(values: Column, tops: Callable[[Column], Column]) -> Column:
    """Running sums within blocks, each moved by the sum of the blocks before it, which ``tops`` tells."""

    def with_blocks(blocks: Column) -> Column:
        def with_sums(sums: Column) -> Column:
            def with_tops(up: Column) -> Column:
                return F.flatten(F.transform(blocks, lambda block, b: once(
                    F.struct(block.alias("block"), (F.get(up, b) - F.get(sums, b)).alias("before")),
                    lambda x: F.transform(_sums_within(x["block"]), lambda v: v + x["before"]))))

            return once(tops(sums), with_tops)

        return once(F.transform(blocks, _sum), with_sums)

    return once(_blocks(values), with_blocks)


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of numbers, in steps that grow with its length.

    One fold would copy its result at each element, which is quadratic. Sums are made within blocks of
    64, over blocks, and over blocks of blocks: some 64 steps an element up to millions of elements.
    """
    return once(values, lambda v: _over_blocks(v, lambda sums: _over_blocks(sums, _sums_within)))


def places(text: Column, pattern: str, kind: int, value: int = 0, least: int = 0) -> Column:
    """Array of structs (start, kind, end, value) of the matches whose group ``value`` has ``least`` characters.

    Places are in code points, the end exclusive. A text without a match costs one search.
    """
    groups = (0,) if value == 0 else (0, value)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def measured(parts: Column) -> Column:
        lengths = F.transform(parts, lambda x: F.length(x["before"]) + F.coalesce(F.length(x["g0"]), F.lit(0)))
        return once(F.struct(parts.alias("parts"), running_sums(lengths).alias("ends")), placed)

    def placed(x: Column) -> Column:
        def one(part: Column, end: Column) -> Column:
            start = end - F.length(part["g0"])
            return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), part[f"g{value}"].alias("value"))

        return F.filter(F.zip_with(x["parts"], x["ends"], one), lambda s: F.length(s["value"]) >= least)

    return F.when(F.regexp_like(text, F.lit(pattern)), once(cut_at(text, pattern, *groups), measured)).otherwise(none)
