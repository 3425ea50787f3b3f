"""Set functions over array columns without nulls; null arrays count as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count(a: Column | str) -> Column:
    return F.greatest(F.size(_c(a)), F.lit(0))


def known(a: Column | str) -> Column:
    return count(a) > 0


def both_known(a: Column | str, b: Column | str) -> Column:
    return known(a) & known(b)


def shared(a: Column | str, b: Column | str) -> Column:
    return F.when(both_known(a, b), F.size(F.array_intersect(_c(a), _c(b)))).otherwise(0)


def overlap(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.arrays_overlap(_c(a), _c(b)), F.lit(False))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """|a & b| / |a | b| of two sets; 0 if either is empty."""
    n = shared(a, b)
    return F.when(both_known(a, b), n / (F.size(_c(a)) + F.size(_c(b)) - n)).otherwise(F.lit(0.0))


def symmetric_difference(a: Column | str, b: Column | str) -> Column:
    return F.array_union(F.array_except(_c(a), _c(b)), F.array_except(_c(b), _c(a)))


def cross(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    """f of every element of a with every element of b, as one array."""
    left, right = _c(a), _c(b)
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: f(x, y))))


def cross_max(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    """Greatest f over the cross product, null if that is empty."""
    return F.array_max(cross(a, b, f))


def cross_min(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    return F.array_min(cross(a, b, f))


def least_gap(a: Column | str, b: Column | str) -> Column:
    """Least difference of a number of one array and one of the other, null if either is empty.

    It stands between neighbours of the sorted union, so it takes one sort and
    one pass instead of the cross product.
    """

    def tagged(c: Column, side: int) -> Column:
        return F.transform(c, lambda x: F.struct(x.cast("long").alias("v"), F.lit(side).alias("s")))

    none = F.lit(None).cast("long")
    start = F.struct(none.alias("v"), F.lit(-1).alias("s"), none.alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when((acc["s"] >= 0) & (acc["s"] != x["s"]), F.least(acc["gap"], x["v"] - acc["v"])).otherwise(acc["gap"])
        return F.struct(x["v"].alias("v"), x["s"].alias("s"), gap.alias("gap"))

    return F.aggregate(F.array_sort(F.concat(tagged(_c(a), 0), tagged(_c(b), 1))), start, step, lambda acc: acc["gap"])


def ratio(a: Column, b: Column) -> Column:
    """min / max of two counts, with a denominator of one at least."""
    return F.least(a, b) / F.greatest(a, b, F.lit(1))


def flag(c: Column) -> Column:
    """1.0 or 0.0; null counts as false."""
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def sign(a: Column, b: Column) -> Column:
    return flag(a) - flag(b)


def sorted_set(a: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(_c(a))))


def first_sorted(a: Column | str, n: int) -> Column:
    return F.slice(sorted_set(a), 1, n)


def json_ints(text: Column) -> Column:
    """Integers of a JSON array; empty where it does not parse."""
    return F.coalesce(F.array_compact(F.from_json(text, "array<bigint>")), F.array().cast("array<bigint>"))


def durations(ms: Column, all_ms: Column) -> Column:
    """Sorted set of a duration (unless 0) and a JSON list of them."""
    own = F.when(F.coalesce(ms, F.lit(0)) != 0, F.array(ms.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_union(own, json_ints(all_ms)))
