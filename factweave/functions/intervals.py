"""Integer intervals [lo, hi] as pairs of columns; null is unbounded. An empty interval is a null struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(lo: Column, hi: Column) -> Column:
    """The struct, or null if lo > hi."""
    return F.when(F.coalesce(lo <= hi, F.lit(True)), F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi")))


def _both(f, a: Column, b: Column) -> Column:
    """f where both are bounded, the bounded one where one is."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b))


def intersect(a: Column, b: Column) -> Column:
    """What both hold; null when disjoint."""
    return interval(_both(F.greatest, a["lo"], b["lo"]), _both(F.least, a["hi"], b["hi"]))


def hull(a: Column, b: Column) -> Column:
    """The smallest interval that holds both."""
    return F.struct(F.when(a["lo"].isNotNull() & b["lo"].isNotNull(), F.least(a["lo"], b["lo"])).alias("lo"), F.when(a["hi"].isNotNull() & b["hi"].isNotNull(), F.greatest(a["hi"], b["hi"])).alias("hi"))


def contains(a: Column, b: Column) -> Column:
    """Whether ``a`` holds all of ``b``."""
    low = a["lo"].isNull() | F.coalesce(a["lo"] <= b["lo"], F.lit(False))
    high = a["hi"].isNull() | F.coalesce(a["hi"] >= b["hi"], F.lit(False))
    return low & high


def disjoint(a: Column, b: Column) -> Column:
    return F.coalesce(a["hi"] < b["lo"], F.lit(False)) | F.coalesce(b["hi"] < a["lo"], F.lit(False))


def add(a: Column, b: Column) -> Column:
    """Sums; a bound that overflows 64 bits is unbounded."""
    return F.struct(F.try_add(a["lo"], b["lo"]).alias("lo"), F.try_add(a["hi"], b["hi"]).alias("hi"))


def subtract(a: Column, b: Column) -> Column:
    return F.struct(F.try_subtract(a["lo"], b["hi"]).alias("lo"), F.try_subtract(a["hi"], b["lo"]).alias("hi"))


def negate(a: Column) -> Column:
    return F.struct(F.try_subtract(F.lit(0).cast("long"), a["hi"]).alias("lo"), F.try_subtract(F.lit(0).cast("long"), a["lo"]).alias("hi"))


def multiply(a: Column, b: Column) -> Column:
    """Products of bounded intervals; otherwise, and on overflow, unbounded."""
    ends = F.array(*[F.try_multiply(a[x], b[y]) for x in ("lo", "hi") for y in ("lo", "hi")])
    sure = F.forall(ends, lambda e: e.isNotNull())
    return F.struct(F.when(sure, F.array_min(ends)).alias("lo"), F.when(sure, F.array_max(ends)).alias("hi"))


def narrow(a: Column, op: str, value: Column) -> Column:
    """The part of ``a`` for which ``x op value`` can hold."""
    one = F.lit(1).cast("long")
    none = F.lit(None).cast("long")
    lo, hi = {"<": (none, F.try_subtract(value, one)), "<=": (none, value), ">": (F.try_add(value, one), none), ">=": (value, none), "==": (value, value)}[op]
    return intersect(a, F.struct(lo.alias("lo"), hi.alias("hi")))
