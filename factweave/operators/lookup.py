"""Questions about single symbols, asked for many at once: a table of keys in, a table of answers out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.keys import fold
from factweave.functions.types import ATOM, union


def definition(wanted: DataFrame, index: DataFrame, key: str, place: str) -> DataFrame:
    """``wanted`` with the place of each key and a status: found, no source location, or not found."""
    known = index.select(key, F.col(place).alias("__place"), F.lit(True).alias("__known")).dropDuplicates([key])
    met = wanted.join(known, key, "left")
    status = F.when(F.col("__place").isNotNull(), "found").when(F.col("__known"), "no source location").otherwise("not found")
    return met.select(*wanted.columns, F.col("__place").alias(place), status.alias("status"))


def hover(wanted: DataFrame, index: DataFrame, docs: DataFrame, key: str, place: str, shown: str, doc: str) -> DataFrame:
    """:func:`definition` with what is shown of the symbol and its documentation."""
    about = index.select(key, shown).dropDuplicates([key]).join(docs.select(key, doc).dropDuplicates([key]), key, "left")
    return definition(wanted, index, key, place).join(about, key, "left")


def exists(wanted: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """``wanted`` with ``known``."""
    have = index.select(key, F.lit(True).alias("known")).distinct()
    return wanted.join(have, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def at_position(wanted: DataFrame, decls: DataFrame, file: str, position: str) -> DataFrame:
    """Declarations by file and number."""
    return wanted.select(file, position).join(decls, [file, position])


def own_member(wanted: DataFrame, members: DataFrame, folded: bool = True) -> DataFrame:
    """Members that a class declares itself; method names fold case, others do not. Columns: class, name."""
    name = fold if folded else F.col
    have = members.withColumn("__n", name("name")).drop("name")
    return wanted.withColumn("__n", name("name")).join(have, ["class", "__n"]).drop("__n")


def receiver(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References (receiver, within) with ``target``: self and static are the enclosing class, parent its parent; parents: child, parent."""
    up = parents.select(F.col("child").alias("within"), F.col("parent").alias("__up")).dropDuplicates(["within"])
    low = fold("receiver")
    target = F.when(low.isin("self", "static"), F.col("within")).when(low == "parent", F.col("__up")).otherwise(F.col("receiver"))
    return refs.join(up, "within", "left").withColumn("target", target).drop("__up")


def member_family(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, member_of): a class, its ancestors and its subtypes, whose keys name the same member; pairs: child, ancestor."""
    own = classes.select("class", F.col("class").alias("member_of"))
    up = classes.join(pairs.select(F.col("child").alias("class"), F.col("ancestor").alias("member_of")), "class")
    down = classes.join(pairs.select(F.col("ancestor").alias("class"), F.col("child").alias("member_of")), "class")
    return own.unionByName(up).unionByName(down).distinct()


def import_references(imports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Imports (file, alias, fqcn) of the wanted names (fqcn), ASCII case apart."""
    keys = wanted.select(fold("fqcn").alias("__k")).distinct()
    return imports.withColumn("__k", fold("fqcn")).join(keys, "__k", "left_semi").drop("__k")


def trait_constraints(uses: DataFrame, required: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, trait, required): classes that use a trait without extending or implementing what it requires."""
    have = pairs.select(F.col("child").alias("class"), F.col("ancestor").alias("required")).distinct()
    return uses.select("class", "trait").join(required.select("trait", "required"), "trait").join(have, ["class", "required"], "left_anti").select("class", "trait", "required")


def name_range(decls: DataFrame, texts: DataFrame, name: Column) -> DataFrame:
    """Declarations (file, line) with ``name_start`` and ``name_end``, the columns of the name token on its line; null if it is not there."""
    lines = texts.select("file", F.split("text", "\n").alias("__lines"))
    line = F.try_element_at(F.col("__lines"), F.col("line").cast("int"))
    at = F.position(name, line) - 1
    out = decls.join(lines, "file", "left").withColumn("name_start", F.when(at >= 0, at))
    return out.withColumn("name_end", F.col("name_start") + F.length(name)).drop("__lines")


def inferred_types(returns: DataFrame, key: str, types: str = "types") -> DataFrame:
    """The union of all types that a callable returns, one row each; ``types`` is an array of atoms."""
    gathered = returns.groupBy(key).agg(F.array_sort(F.collect_set(types)).alias("__sets"))
    start = F.array().cast(f"array<{ATOM}>")
    return gathered.select(key, F.aggregate("__sets", start, lambda acc, x: union(acc, x)).alias(types))


def project_arguments(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(child, ancestor, args): type arguments of a class mapped onto a generic ancestor two steps up.

    ``edges``: child, parent, args (map from the parent's parameter to a type text, which may be a parameter of the child);
    ``names``: child, parent, args of the step below.
    """
    up = edges.select(F.col("child").alias("parent"), F.col("parent").alias("ancestor"), F.col("args").alias("__up"))
    put = F.transform_values("__up", lambda _, v: F.coalesce(F.try_element_at(F.col("args"), v), v))
    return names.join(up, "parent").select("child", "ancestor", put.alias("args"))
