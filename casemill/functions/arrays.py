"""Running sums and maxima of arrays, native and in nearly linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded one by one; an array that grows by one element is copied each time.
BLOCK = 128


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; inside a lambda, Spark computes anything else again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(value: Column) -> Column:
    """``value`` as a column that Spark neither writes into other expressions nor into filters that it pushes down.

    Without it, a filter on a result takes all expressions below it along, over and over.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def running(values: Column, combine: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """array<int>: at each place the combination of all values up to it (``combine`` must be associative, ``start`` neutral).

    Blocks are combined first, so that no array of more than ``BLOCK`` elements, or of as many as there are blocks, is
    ever extended one by one.
    """
    follow = lambda xs, first: F.slice(F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x)))), 2, F.size(xs))

    def whole(xs: Column) -> Column:
        short = F.when(F.size(xs) == 0, xs).otherwise(follow(xs, F.lit(start)))
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1), lambda k: F.slice(xs, k * BLOCK + 1, BLOCK))

        def joined(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(start), combine))
            before = F.slice(F.concat(F.array(F.lit(start)), follow(totals, F.lit(start))), 1, F.size(blocks))
            return F.flatten(F.zip_with(blocks, before, follow))

        return F.when(F.size(xs) <= BLOCK, short).otherwise(bound(cut, joined))

    return bound(values, whole)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    """Of values that are not negative."""
    return running(values, lambda a, b: F.greatest(a, b))
