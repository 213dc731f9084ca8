"""Sets, maps and sorted lists as Columns over arrays and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _alike(a: Column, b: Column, same: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def same_set(a: Column, b: Column) -> Column:
    """Arrays with the same elements, order and repeats aside; null equals null alone."""
    return _alike(a, b, (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0))


def same_map(a: Column, b: Column) -> Column:
    """Maps with the same entries; null equals null alone."""
    entries = lambda m: F.array_sort(F.map_entries(m))
    return _alike(a, b, entries(a) == entries(b))


def map_elements(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, f)


def sorted_add(a: Column, x: Column) -> Column:
    return F.array_sort(F.concat(a, F.array(x)))


def sorted_remove(a: Column, x: Column) -> Column:
    """Without one ``x``, if there is one."""
    at = F.array_position(a, x).cast("int")
    return F.when(at > 0, F.concat(F.slice(a, F.lit(1), at - 1), F.slice(a, at + 1, F.size(a)))).otherwise(a)


def up_to(a: Column, x: Column) -> Column:
    """What is left of a sorted list when everything bigger than ``x`` is removed."""
    return F.filter(a, lambda e: e <= x)


def bigger(a: Column, x: Column) -> Column:
    """What that removes, the biggest first."""
    return F.reverse(F.filter(a, lambda e: e > x))


def place_of(a: Column, x: Column) -> Column:
    """The place of ``x`` from 0 on, -1 if it is not there."""
    return F.array_position(a, x) - 1
