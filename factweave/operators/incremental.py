"""Maintenance of facts by edits: what changed, what it spoils, what may be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.plans.closure import reachable


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def compare(old: DataFrame, new: DataFrame, path: str = "path", content: str = "content_hash", surface: str = "surface_hash") -> DataFrame:
    """(path, change): added, removed, same, body (the surface is as before) or surface. A null or empty surface counts as changed."""
    a = old.select(path, F.col(content).alias("a"), F.col(surface).alias("sa"))
    b = new.select(path, F.col(content).alias("b"), F.col(surface).alias("sb"))
    met = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), path, "full")
    known = (F.coalesce("sa", F.lit("")) != "") & (F.coalesce("sb", F.lit("")) != "")
    change = (
        F.when(F.col("in_a").isNull(), "added")
        .when(F.col("in_b").isNull(), "removed")
        .when(F.col("a").eqNullSafe(F.col("b")), "same")
        .when(known & (F.col("sa") == F.col("sb")), "body")
        .otherwise("surface")
    )
    return met.select(path, change.alias("change"))


def evict(changes: DataFrame, edges: DataFrame, path: str = "path") -> DataFrame:
    """(path): files to be redone because of what they depend on. Only changed surfaces, added and removed files cascade, over
    edges (src depends on dst); the changed files themselves are not in the result."""
    seeds = changes.filter("change in ('surface', 'removed', 'added')").select(F.col(path).alias("node"))
    changed = changes.filter("change <> 'same'").select(F.col(path).alias("node"))
    found = reachable(seeds, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return found.join(changed, "node", "left_anti").select(F.col("node").alias(path))


def upsert(table: DataFrame, edits: DataFrame, path: str = "path", content: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(table after the edits, edits that change something): equal content is no edit."""
    fresh = edits.join(table.select(path, F.col(content).alias("__old")), path, "left").filter(~F.col("__old").eqNullSafe(F.col(content))).drop("__old")
    return table.join(fresh.select(path), path, "left_anti").unionByName(fresh.select(*table.columns)), fresh


def replace_facts(facts: DataFrame, fresh: DataFrame, touched: DataFrame, path: str = "path") -> DataFrame:
    """Facts of the touched files replaced by ``fresh``."""
    return facts.join(touched.select(path).distinct(), path, "left_anti").unionByName(fresh)


def warm_start(cache: DataFrame, files: DataFrame, unresolved: DataFrame, path: str = "path", content: str = "content_hash") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reused, to do, to verify): cached files whose content is the same; the other files; reused ones with unresolved names."""
    reused = files.join(cache.select(path, content), [path, content], "left_semi")
    todo = files.join(cache.select(path, content), [path, content], "left_anti")
    return reused, todo, reused.join(unresolved.select(path).distinct(), path, "left_semi").select(path)


def deleted_files(cache: DataFrame, analysed: DataFrame, on_disk: DataFrame, path: str = "path") -> DataFrame:
    """Cached files that are neither analysed nor on disk."""
    return cache.select(path).distinct().join(analysed.select(path), path, "left_anti").join(on_disk.select(path), path, "left_anti")


def update_winners(winners: DataFrame, decls: DataFrame, touched: DataFrame, key: str, **how) -> DataFrame:
    """The symbol index after some keys (touched) changed: only their winners are found anew."""
    from factweave.operators.index import symbol_winner

    keys = touched.select(key).distinct()
    return winners.join(keys, key, "left_anti").unionByName(symbol_winner(decls.join(keys, key, "left_semi"), key, **how).select(*winners.columns))


def lazy_load(names: DataFrame, known: DataFrame, load, key: str = "key", rounds: int = 10) -> DataFrame:
    """Known declarations after loading what is missing, again and again: ``load(missing)`` returns (declarations, names they use)."""
    for _ in range(rounds):
        missing = names.select(key).distinct().join(known.select(key), key, "left_anti")
        if missing.isEmpty():
            break
        more, names = load(missing)
        if more.isEmpty():
            break
        known = known.unionByName(more.select(*known.columns))
    return known
