"""Joins of references and declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(refs: DataFrame, decls: DataFrame, key: str) -> DataFrame:
    """References with their declaration's columns. Catalyst broadcasts the declarations while their size allows."""
    return refs.join(decls, key)


def unresolved(refs: DataFrame, decls: DataFrame, key: str) -> DataFrame:
    """References whose key no declaration has; a null key is unresolved."""
    return refs.join(decls.select(key).distinct(), key, "left_anti")


def unreferenced(decls: DataFrame, refs: DataFrame, key: str, exempt: Column | None = None) -> DataFrame:
    """Declarations that no reference names and that are not exempt."""
    left = decls if exempt is None else decls.filter(~F.coalesce(exempt, F.lit(False)))
    return left.join(refs.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def find_references(refs: DataFrame, keys: DataFrame, key: str, scope: DataFrame | None = None, file: str = "file", declarations: DataFrame | None = None) -> DataFrame:
    """The distinct references to any of ``keys``, inside the files of ``scope``, with the declarations if given."""
    found = refs.join(keys.select(key).distinct(), key, "left_semi")
    if scope is not None:
        found = found.join(scope.select(file).distinct(), file, "left_semi")
    if declarations is not None:
        found = found.unionByName(declarations.join(keys.select(key).distinct(), key, "left_semi").select(*found.columns))
    return found.distinct()


def mention_gate(texts: DataFrame, doc: str, tokens: Column, needles: DataFrame, needle: str) -> DataFrame:
    """(doc): texts that hold any needle as a whole token. Tokens are made once; new needles cost a semi-join, not a scan."""
    held = texts.select(F.col(doc), F.explode(tokens).alias(needle))
    return held.join(needles.select(needle).distinct(), needle, "left_semi").select(doc).distinct()


def dependencies(refs: DataFrame, defined: DataFrame, key: str, file: str = "file") -> DataFrame:
    """(src, dst): files that use what other files define; no file depends on itself."""
    src, dst = refs.select(F.col(file).alias("src"), key).distinct(), defined.select(F.col(file).alias("dst"), key).distinct()
    return src.join(dst, key).filter("src <> dst").select("src", "dst").distinct()


def reverse_dependencies(edges: DataFrame) -> DataFrame:
    """(dst, dependents): who depends on each file, sorted."""
    return edges.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("dependents"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def resolve_names(names: DataFrame, imports: DataFrame, known: DataFrame) -> DataFrame:
    """(file, name, namespace) with ``resolved``.

    A leading backslash goes; reserved names stay; then the alias of the first segment, exactly or else in folded case; then
    a qualified name that is known; else the namespace is put before. ``imports``: file, alias, fqcn; ``known``: key (folded).
    """
    from factweave.functions.keys import RESERVED, fold

    bare = names.withColumn("bare", F.regexp_replace("name", r"^\\", "")).withColumn("head", F.substring_index("bare", "\\", 1))
    exact = imports.groupBy("file", F.col("alias").alias("head")).agg(F.min("fqcn").alias("exact"))
    loose = imports.groupBy("file", fold("alias").alias("folded")).agg(F.min("fqcn").alias("loose"))
    seen = known.select(F.col("key").alias("whole"), F.lit(True).alias("is_known")).distinct()
    joined = (
        bare.withColumn("folded", fold("head"))
        .withColumn("whole", fold("bare"))
        .join(exact, ["file", "head"], "left")
        .join(loose, ["file", "folded"], "left")
        .join(seen, "whole", "left")
    )
    alias = F.coalesce("exact", "loose")
    rest = F.substring(F.col("bare"), F.length("head") + 1, F.length("bare"))
    qualified = F.instr("bare", "\\") > 0
    spaced = F.when(F.coalesce("namespace", F.lit("")) == "", F.col("bare")).otherwise(F.concat("namespace", F.lit("\\"), "bare"))
    out = (
        F.when(F.startswith("name", F.lit("\\")), F.col("bare"))
        .when(fold("bare").isin(*RESERVED), F.col("bare"))
        .when(alias.isNotNull(), F.concat(alias, rest))
        .when(qualified & F.coalesce("is_known", F.lit(False)), F.col("bare"))
        .otherwise(spaced)
    )
    return joined.select("file", "name", "namespace", out.alias("resolved"))


def symbol_at(spans: DataFrame, offsets: DataFrame, width: int = 4096) -> DataFrame:
    """(file, offset) with the smallest span that covers it, identifiers before calls.

    ``spans``: file, start, end, fallback, name. A range join on bins of ``width``: spans go to every bin they touch, offsets to one.
    """
    bins = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest("start", F.col("end") - 1) / width))))
    met = offsets.withColumn("bin", F.floor(F.col("offset") / width)).join(bins, ["file", "bin"]).filter("start <= offset and offset < end")
    return met.groupBy("file", "offset").agg(F.min_by("name", F.struct("fallback", F.col("end") - F.col("start"), "start", "name")).alias("name"))


def range_lookup(points: DataFrame, at: Column, spans: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """Points with every span [start, end) that holds them, by bins instead of a nested loop; spans should be few bins long."""
    p = points.withColumn("__at", at).withColumn("__bin", F.floor(F.col("__at") / width))
    s = spans.withColumn("__start", start).withColumn("__end", end).filter("__start < __end")
    s = s.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__start") / width), F.floor((F.col("__end") - 1) / width))))
    return p.join(s, "__bin").filter("__start <= __at and __at < __end").drop("__bin", "__at", "__start", "__end")


def prefix_matches(items: DataFrame, item: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(``item``, ``prefix``): every prefix that an item starts with, the empty one included.

    An equi-join: an item is tried under its beginnings of the lengths that prefixes have, so no pair of item and prefix is
    compared, and an item costs as many rows as there are lengths up to its own.
    """
    known = prefixes.select(F.col(prefix).alias("__prefix"), F.length(prefix).alias("__n")).filter("__prefix is not null").distinct()
    lengths = [r["__n"] for r in known.select("__n").distinct().orderBy("__n").collect()]  # as many as the longest prefix is long, at most
    tried = items.select(F.col(item).alias("__item")).filter("__item is not null").distinct()
    tried = tried.select("__item", F.explode(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("__item"))).alias("__n"))
    hit = tried.withColumn("__prefix", F.substring(F.col("__item"), F.lit(1), F.col("__n"))).join(known.select("__prefix"), "__prefix")
    return hit.select(F.col("__item").alias(item), F.col("__prefix").alias(prefix))


def longest_prefix(items: DataFrame, item: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Items with the longest prefix that they start with (null: none)."""
    hit = prefix_matches(items, item, prefixes, prefix).groupBy(item).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return items.join(hit, item, "left")


def autoload(names: DataFrame, rules: DataFrame, files: DataFrame, classmap: DataFrame) -> DataFrame:
    """(fqcn, path) by the first rule that leads to an existing file.

    ``rules``: scheme ('psr-4', 'psr-0'), is_project, prefix, dir. A rule holds for all names that start with its prefix,
    whatever sign it ends in. Order: psr-4 before psr-0 before ``classmap`` (fqcn, path),
    project before vendor, longer prefixes first.
    """
    tried = prefix_matches(names, "fqcn", rules, "prefix").join(rules, "prefix")
    rest = F.substring(F.col("fqcn"), F.length("prefix") + 1, F.length("fqcn"))
    base = F.concat(F.regexp_replace("dir", "/$", ""), F.lit("/"))
    psr4 = F.concat(base, F.replace(rest, F.lit("\\"), F.lit("/")), F.lit(".php"))
    space, last = F.substring_index("fqcn", "\\", -1), F.col("fqcn")
    head = F.substring(last, F.lit(1), F.length(last) - F.length(space))
    psr0 = F.concat(base, F.replace(head, F.lit("\\"), F.lit("/")), F.replace(space, F.lit("_"), F.lit("/")), F.lit(".php"))
    rank = F.when(F.col("scheme") == "psr-4", 0).otherwise(2) + F.when(F.col("is_project"), 0).otherwise(1)
    found = tried.select("fqcn", F.when(F.col("scheme") == "psr-4", psr4).otherwise(psr0).alias("path"), rank.alias("rank"), (-F.length("prefix")).alias("near"))
    mapped = classmap.join(names, "fqcn", "left_semi").select("fqcn", "path", F.lit(4).alias("rank"), F.lit(0).alias("near"))
    live = found.unionByName(mapped).join(files.select("path").distinct(), "path", "left_semi")
    return live.groupBy("fqcn").agg(F.min_by("path", F.struct("rank", "near", "path")).alias("path"))


def bind_arguments(args: DataFrame, params: DataFrame) -> DataFrame:
    """Arguments with the parameter that takes each: by name, else by position, extra ones to a variadic last parameter.

    ``args``: call_id, callee, pos, name; ``params``: callee, pos, name, is_variadic. ``param`` is null where none takes it.
    """
    named = params.select("callee", F.col("name"), F.col("pos").alias("named_pos"))
    rest = params.filter("is_variadic").groupBy("callee").agg(F.min("pos").alias("rest_pos"))
    at = args.join(named, ["callee", "name"], "left").join(rest, "callee", "left")
    place = F.coalesce("named_pos", F.when(F.col("name").isNull(), F.least("pos", "rest_pos")), F.col("rest_pos"))
    place = F.when(F.col("name").isNull() & F.col("rest_pos").isNull(), F.col("pos")).otherwise(place)
    target = params.select("callee", F.col("pos").alias("at"), F.col("name").alias("param"))
    return at.withColumn("at", place).join(target, ["callee", "at"], "left").select("call_id", "callee", "pos", "name", "param")
