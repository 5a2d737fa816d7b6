"""Sets of type atoms: ``array<struct<tag, lit_str, lo, hi, ref_class>>``, by native higher-order functions.

``tag`` names the atom; ``lit_str`` is a literal's text, ``lo`` and ``hi`` an integer's interval (null: unbounded), ``ref_class``
a class name. An empty set is the type that no value has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ATOM = "struct<tag:string,lit_str:string,lo:bigint,hi:bigint,ref_class:string>"

#: Tags of each family (fixed values).
STRINGS = ("string", "literal-string", "callable-string", "class-string", "non-empty-string", "numeric-string", "interface-string", "enum-string", "trait-string")
INTS = ("int", "positive-int", "negative-int", "non-negative-int")
FLOATS = ("float", "integral-float", "literal-float")
BOOLS = ("bool", "true", "false")
ARRAYS = ("array", "list", "non-empty-array", "non-empty-list", "keyed-array")
OBJECTS = ("object", "named-object", "static", "self", "parent", "intersection", "enum-case")
CALLABLES = ("callable", "closure")
TOP = ("mixed", "template")
#: Atoms that are never falsy, and never truthy (fixed values).
NEVER_FALSY = ("class-string", "interface-string", "enum-string", "trait-string", "callable-string", "positive-int", "negative-int", "true", "non-empty-array", "non-empty-list", *OBJECTS, *CALLABLES, "resource")
NEVER_TRUTHY = ("null", "void", "never", "false")


def atom(tag: str, lit_str: str | None = None, lo: int | None = None, hi: int | None = None, ref_class: str | None = None) -> Column:
    values = zip((tag, lit_str, lo, hi, ref_class), ("tag", "lit_str", "lo", "hi", "ref_class"), ("string", "string", "bigint", "bigint", "string"), strict=True)
    return F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in values])


def is_in(a: Column, *tags: str) -> Column:
    return a["tag"].isin(*tags)


def can_be_falsy(a: Column) -> Column:
    literal = F.when(a["tag"] == "literal-string", a["lit_str"].isNull() | a["lit_str"].isin("", "0"))
    number = F.when(is_in(a, *INTS), F.coalesce(a["lo"] <= 0, F.lit(True)) & F.coalesce(a["hi"] >= 0, F.lit(True)))
    return F.when(is_in(a, *NEVER_FALSY), F.lit(False)).otherwise(F.coalesce(literal, number, F.lit(True)))


def can_be_truthy(a: Column) -> Column:
    literal = F.when(a["tag"] == "literal-string", a["lit_str"].isNull() | ~a["lit_str"].isin("", "0"))
    number = F.when(is_in(a, *INTS), ~F.coalesce((a["lo"] == 0) & (a["hi"] == 0), F.lit(False)))
    return F.when(is_in(a, *NEVER_TRUTHY), F.lit(False)).otherwise(F.coalesce(literal, number, F.lit(True)))


def _range_in(sub: Column, sup: Column) -> Column:
    low = sup["lo"].isNull() | F.coalesce(sub["lo"] >= sup["lo"], F.lit(False))
    high = sup["hi"].isNull() | F.coalesce(sub["hi"] <= sup["hi"], F.lit(False))
    return low & high


def atom_subtype(sub: Column, sup: Column) -> Column:
    """Structural acceptance of one atom by another. ``mixed`` accepts and is accepted; integers widen to float."""
    same = sub["tag"] == sup["tag"]
    strings = is_in(sub, *STRINGS) & ((sup["tag"] == "string") | (is_in(sup, "non-empty-string") & ~(is_in(sub, "string", "literal-string")) & (sub["tag"] != "numeric-string")))
    literal = (sub["tag"] == "literal-string") & (
        ((sup["tag"] == "literal-string") & (sup["lit_str"].isNull() | (sub["lit_str"] == sup["lit_str"])))
        | ((sup["tag"] == "non-empty-string") & (F.coalesce(sub["lit_str"], F.lit("")) != ""))
        | ((sup["tag"] == "numeric-string") & sub["lit_str"].rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"))
    )
    arrays = (
        ((sup["tag"] == "array") & is_in(sub, *ARRAYS))
        | ((sup["tag"] == "list") & is_in(sub, "non-empty-list"))
        | ((sup["tag"] == "non-empty-array") & is_in(sub, "non-empty-list"))
    )
    objects = ((sup["tag"] == "object") & is_in(sub, *OBJECTS, "closure")) | (same & is_in(sub, "named-object") & (F.lower(sub["ref_class"]) == F.lower(sup["ref_class"])))
    plain = same & ~is_in(sub, "named-object", "literal-string", *INTS) & sub["lit_str"].eqNullSafe(sup["lit_str"])
    return F.coalesce(
        is_in(sup, "mixed") | is_in(sub, "mixed", "never")
        | plain | strings | literal | arrays | objects
        | (is_in(sub, *INTS) & is_in(sup, *INTS) & _range_in(sub, sup))
        | (is_in(sub, *INTS) & (sup["tag"] == "float"))
        | ((sup["tag"] == "float") & is_in(sub, *FLOATS))
        | ((sup["tag"] == "bool") & is_in(sub, *BOOLS))
        | ((sup["tag"] == "callable") & is_in(sub, "closure", "callable-string")),
        F.lit(False),
    )


def union(a: Column, b: Column) -> Column:
    """Both sets' atoms; mixed absorbs all, an atom goes that another one includes (of equals the first stays), and true with false
    is bool."""
    every = F.array_distinct(F.concat(a, b))
    top = F.filter(every, lambda x: x["tag"] == "mixed")
    placed = F.transform(every, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def needed(p: Column) -> Column:
        over = lambda q: (q["i"] != p["i"]) & atom_subtype(p["x"], q["x"]) & (~atom_subtype(q["x"], p["x"]) | (q["i"] < p["i"])) & ~(is_in(p["x"], *INTS) & (q["x"]["tag"] == "float"))
        return ~F.exists(placed, over)

    kept = F.transform(F.filter(placed, needed), lambda p: p["x"])
    whole = F.exists(every, lambda x: x["tag"] == "true") & F.exists(every, lambda x: x["tag"] == "false") & ~F.exists(every, lambda x: x["tag"] == "bool")
    merged = F.transform(F.filter(kept, lambda x: x["tag"] != "false"), lambda x: F.when(x["tag"] == "true", atom("bool")).otherwise(x))
    return F.when(F.size(top) > 0, F.slice(top, 1, 1)).when(whole, merged).otherwise(kept)


def intersect(a: Column, b: Column) -> Column:
    """The narrower of each related pair; ``mixed`` changes nothing. Ranges that overlap without nesting give nothing."""
    left = F.filter(a, lambda x: F.exists(b, lambda y: atom_subtype(x, y)))
    right = F.filter(b, lambda y: F.exists(a, lambda x: atom_subtype(y, x) & ~atom_subtype(x, y)))
    is_top = lambda s: F.exists(s, lambda x: x["tag"] == "mixed")
    return F.when(is_top(a), b).when(is_top(b), a).otherwise(F.array_distinct(F.concat(left, right)))


def subset(sub: Column, sup: Column) -> Column:
    """Every atom of ``sub`` is accepted by one of ``sup``."""
    return F.forall(sub, lambda x: F.exists(sup, lambda y: atom_subtype(x, y)))


def remove(a: Column, *tags: str) -> Column:
    """Difference by tag; a removed true or false leaves the other half of bool."""
    out = F.filter(a, lambda x: ~is_in(x, *tags))
    if "true" in tags and "false" not in tags:
        out = F.transform(out, lambda x: F.when(x["tag"] == "bool", atom("false")).otherwise(x))
    if "false" in tags and "true" not in tags:
        out = F.transform(out, lambda x: F.when(x["tag"] == "bool", atom("true")).otherwise(x))
    return out


def truthy(a: Column) -> Column:
    """What is left where the value is truthy."""
    kept = F.filter(a, can_be_truthy)
    return F.transform(kept, lambda x: F.when(x["tag"] == "bool", atom("true")).otherwise(x))


def falsy(a: Column) -> Column:
    kept = F.filter(a, can_be_falsy)
    zero = F.struct(F.lit("int").alias("tag"), F.lit(None).cast("string").alias("lit_str"), F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi"), F.lit(None).cast("string").alias("ref_class"))
    return F.transform(kept, lambda x: F.when(x["tag"] == "bool", atom("false")).when(is_in(x, *INTS), zero).otherwise(x))


#: Tags that each family test keeps (fixed values).
FAMILIES: dict[str, tuple[str, ...]] = {
    "string": STRINGS,
    "int": INTS,
    "float": FLOATS,
    "bool": BOOLS,
    "null": ("null",),
    "array": ARRAYS,
    "list": ("list", "non-empty-list", "array", "keyed-array"),
    "object": (*OBJECTS, "closure"),
    "callable": (*CALLABLES, "callable-string", "string", "array", "object", "named-object"),
    "scalar": (*STRINGS, *INTS, *FLOATS, *BOOLS),
    "iterable": (*ARRAYS, "iterable", "named-object"),
    "countable": (*ARRAYS, "named-object"),
    "resource": ("resource",),
    "numeric": (*INTS, *FLOATS, "numeric-string"),
    "class-string": ("class-string", "interface-string", "enum-string", "trait-string"),
}


def narrow(a: Column, family: str) -> Column:
    """The atoms of a family; mixed becomes the family's widest atom."""
    tags = FAMILIES[family]
    return F.transform(F.filter(a, lambda x: is_in(x, *tags) | is_in(x, "mixed")), lambda x: F.when(x["tag"] == "mixed", atom(tags[0])).otherwise(x))


def exclude(a: Column, family: str) -> Column:
    """The atoms outside a family."""
    return F.filter(a, lambda x: ~is_in(x, *FAMILIES[family]))


def exists(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(a, test)


def disjoint(a: Column, b: Column) -> Column:
    """No atom of one is related to any of the other."""
    return ~F.exists(a, lambda x: F.exists(b, lambda y: atom_subtype(x, y) | atom_subtype(y, x)))


def clone_validity(a: Column) -> Column:
    """'valid' if all atoms are objects, 'invalid' if none is, else 'possibly'."""
    obj = lambda x: is_in(x, *OBJECTS, "closure", "mixed")
    return F.when(F.forall(a, obj), F.lit("valid")).when(F.exists(a, obj), F.lit("possibly")).otherwise(F.lit("invalid"))


def display(a: Column) -> Column:
    """``int<0,5>|'a'|App\\User`` in the set's order."""
    bound = lambda v, word: F.coalesce(v.cast("string"), F.lit(word))

    def one(x: Column) -> Column:
        return (
            F.when((x["tag"] == "literal-string") & x["lit_str"].isNotNull(), F.concat(F.lit("'"), x["lit_str"], F.lit("'")))
            .when((x["tag"] == "int") & x["lo"].isNull() & x["hi"].isNull(), F.lit("int"))
            .when((x["tag"] == "int") & (x["lo"] == x["hi"]), x["lo"].cast("string"))
            .when(x["tag"] == "int", F.concat(F.lit("int<"), bound(x["lo"], "min"), F.lit(","), bound(x["hi"], "max"), F.lit(">")))
            .when(x["tag"] == "named-object", x["ref_class"])
            .otherwise(x["tag"])
        )

    return F.when(F.size(a) == 0, F.lit("never")).otherwise(F.array_join(F.transform(a, one), "|"))


def substitute(a: Column, bindings: Column) -> Column:
    """Template atoms (tag ``template``, name in ``ref_class``) replaced by what ``bindings`` (map from name to set) gives them."""
    one = lambda x: F.coalesce(F.when(x["tag"] == "template", F.try_element_at(bindings, x["ref_class"])), F.array(x))
    return F.aggregate(F.transform(a, one), F.array().cast(f"array<{ATOM}>"), lambda acc, x: union(acc, x))


def infer(params: Column, args: Column) -> Column:
    """Bindings of the templates that stand alone in ``params``, from the sets in ``args``; both are arrays of sets."""
    pairs = F.filter(F.arrays_zip(params.alias("p"), args.alias("a")), lambda x: (F.size(x["p"]) == 1) & (x["p"][0]["tag"] == "template") & x["a"].isNotNull())
    names = F.array_distinct(F.transform(pairs, lambda x: x["p"][0]["ref_class"]))
    empty = F.array().cast(f"array<{ATOM}>")
    value = lambda n: F.aggregate(F.filter(pairs, lambda x: x["p"][0]["ref_class"] == n), empty, lambda acc, x: union(acc, x["a"]))
    return F.map_from_arrays(names, F.transform(names, value))


def broken_bounds(bindings: Column, bounds: Column) -> Column:
    """Names whose binding is not inside its bound."""
    bad = F.map_filter(bindings, lambda n, b: F.coalesce(~subset(b, F.try_element_at(bounds, n)), F.lit(False)))
    return F.array_sort(F.map_keys(bad))


def conditional(subject: Column, test: Column, yes: Column, no: Column) -> Column:
    """``subject is test ? yes : no``: one side where the test is decided, else both."""
    return F.when(subset(subject, test), yes).when(disjoint(subject, test), no).otherwise(union(yes, no))
