"""Straight-line dataflow as windows, and taint as reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factweave.plans.closure import reachable


def dead_writes(events: DataFrame, scope: list[str], order: list[str], is_write: Column) -> DataFrame:
    """Writes whose next event on the same variable is a write too, or that are the last: nothing reads them."""
    w = Window.partitionBy(*scope).orderBy(*order)
    following = F.lead(is_write).over(w)
    return events.withColumn("__next", following).filter(is_write & F.coalesce("__next", F.lit(True))).drop("__next")


def unreachable(statements: DataFrame, block: list[str], order: list[str], diverges: Column) -> DataFrame:
    """Statements after one that leaves its block."""
    w = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return statements.withColumn("__left", F.max(diverges.cast("int")).over(w)).filter("__left = 1").drop("__left")


def unreachable_catches(catches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Catches (try_id, pos, class) after one of the same or a super class; ``pairs`` (child, ancestor) is the closure."""
    earlier = catches.select("try_id", F.col("pos").alias("before"), F.col("class").alias("ancestor"))
    over = pairs.select("child", "ancestor").unionByName(catches.select(F.col("class").alias("child"), F.col("class").alias("ancestor"))).distinct()
    met = catches.join(over, F.col("class") == F.col("child")).drop("child").join(earlier, ["try_id", "ancestor"]).filter("before < pos")
    return met.select("try_id", "pos", "class").distinct()


def tainted(sources: DataFrame, flows: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None = None) -> DataFrame:
    """(node, depth) of the ``sinks`` (node) that a value from ``sources`` (node) reaches along ``flows`` (src, dst).

    A sanitizer (node) passes nothing on, and is no source.
    """
    if sanitizers is not None:
        clean = sanitizers.select("node").distinct()
        flows = flows.join(clean.withColumnRenamed("node", "src"), "src", "left_anti")
        sources = sources.join(clean, "node", "left_anti")
    return reachable(sources, flows).join(sinks.select("node").distinct(), "node", "left_semi")


def tainted_calls(args: DataFrame, sinks: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Tainted arguments (callee, class, pos, is_tainted) in a sink's position; ``sinks``: callee, class, pos.

    With ``pairs`` (child, ancestor) a method sink covers subclasses.
    """
    hot = args.filter("is_tainted")
    if pairs is None:
        return hot.join(sinks, ["callee", "class", "pos"], "left_semi")
    below = sinks.join(pairs.select("child", F.col("ancestor").alias("class")), "class").select("callee", F.col("child").alias("class"), "pos")
    return hot.join(sinks.unionByName(below).distinct(), ["callee", "class", "pos"], "left_semi")


def merge_branches(left: DataFrame, right: DataFrame, keys: list[str], types: str = "types") -> DataFrame:
    """Environments after a branch: union of types; a variable of one side only is possibly undefined."""
    from factweave.functions.types import union

    a, b = left.select(*keys, F.col(types).alias("__a")), right.select(*keys, F.col(types).alias("__b"))
    met = a.join(b, keys, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return met.select(*keys, F.when(both, union(F.col("__a"), F.col("__b"))).otherwise(F.coalesce("__a", "__b")).alias(types), (~both).alias("possibly_undefined"))
