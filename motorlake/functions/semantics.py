"""Rounding and null rules that differ between SQL dialects, in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even_int(x: Column) -> Column:
    """To an integer, halves to the even neighbour; a cast would cut off."""
    return F.rint(x).cast("int")


def half_up(x: Column) -> Column:
    """To a whole number, halves towards plus infinity; round() goes away from zero."""
    return F.floor(x + F.lit(0.5))


def half_up_to(x: Column, digits: int) -> Column:
    return half_up(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null; an empty group is null too."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def surely(condition: Column) -> Column:
    """Unknown counts as false, so that ``~surely(c)`` is the complement of ``c``."""
    return F.coalesce(condition, F.lit(False))


def whole_number(text: Column, most_digits: int = 18) -> Column:
    """The digits of a dirty number as bigint; null if there are none or too many."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits).between(1, most_digits), digits.try_cast("bigint"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a name, so that it stands once in the plan however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
