"""Names, keys and text positions as native expressions.

Class-likes, functions and methods fold ASCII case; properties and constants do not. Columns count code points.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of symbol keys and their prefixes (fixed values).
PREFIXES = {"class": "cls:", "function": "fn:", "method": "meth:", "property": "prop:", "constant": "cnst:", "global_constant": "gcnst:"}
#: Names that a resolver leaves alone (fixed values).
RESERVED = ("self", "static", "parent")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(name: Column | str) -> Column:
    """Lower case in A-Z only."""
    return F.translate(_c(name), string.ascii_uppercase, string.ascii_lowercase)


def short_name(fqcn: Column | str) -> Column:
    """The last part of a name."""
    return F.substring_index(_c(fqcn), "\\", -1)


def namespace_of(fqcn: Column | str) -> Column:
    """What stands before the last part; empty for the global namespace."""
    name = _c(fqcn)
    return F.when(F.instr(name, "\\") > 0, F.substring(name, F.lit(1), F.length(name) - F.length(short_name(name)) - 1)).otherwise(F.lit(""))


def symbol_key(kind: str, owner: Column | str, member: Column | str | None = None) -> Column:
    """The reference key of a symbol: kind prefix, owner, and ``::member`` for members; class, function and method names fold."""
    name = fold(owner) if kind != "global_constant" else _c(owner)
    if member is None:
        return F.concat(F.lit(PREFIXES[kind]), name)
    own = fold(member) if kind == "method" else _c(member)
    return F.concat(F.lit(PREFIXES[kind]), name, F.lit("::"), own)


def owner_of(key: Column | str) -> Column:
    """The owner in a symbol key: the prefix and the member go."""
    return F.substring_index(F.regexp_replace(_c(key), "^(?:cls|fn|meth|prop|cnst|gcnst):", ""), "::", 1)


def identifier_tokens(text: Column | str) -> Column:
    """The distinct lower-cased ASCII identifiers of a text."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit("([a-z0-9_]+)"), F.lit(1)))


def mentions(text: Column | str, needle: str) -> Column:
    """Whether a text holds ``needle`` as a whole identifier, ASCII case apart."""
    import re

    folded = needle.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return fold(text).rlike(f"(?<![a-z0-9_]){re.escape(folded)}(?![a-z0-9_])")


def glob(pattern: str) -> str:
    """A path pattern with ``*`` for any run of characters, as an anchored regular expression."""
    import re

    return "^" + ".*".join(map(re.escape, pattern.split("*"))) + "$"


def array_key(value: Column | str) -> Column:
    """An array key as the language stores it: canonical decimal strings in the 64-bit range are integers, in a string here."""
    text = _c(value)
    return F.when(text.rlike(r"^(?:0|-?[1-9][0-9]*)$") & text.try_cast("bigint").isNotNull(), text.try_cast("bigint").cast("string"))


def is_numeric_string(value: Column | str) -> Column:
    """Leading and trailing blanks, a sign, digits with a point and an exponent; no names of infinities."""
    return _c(value).rlike(r"^[ \t\n\r\x0B\f]*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \t\n\r\x0B\f]*$")


def line_of(text: Column | str, offset: Column) -> Column:
    """1-based line of a 0-based code-point offset."""
    before = F.substring(_c(text), F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column | str, offset: Column) -> Column:
    """0-based column, in code points, of a 0-based code-point offset."""
    return F.length(F.substring_index(F.substring(_c(text), F.lit(1), offset), "\n", -1))


def version_in_range(version: Column, since: Column, removed: Column, least_major: int = 4, most_major: int = 9) -> Column:
    """since <= version < removed on ``major * 100 + minor``; null and implausible bounds do not count."""
    sane = lambda v: F.when((F.floor(v / 100) >= least_major) & (F.floor(v / 100) <= most_major), v)
    return F.coalesce(sane(since) <= version, F.lit(True)) & F.coalesce(version < sane(removed), F.lit(True))


def fnv1a(text: Column | str) -> Column:
    """64-bit FNV-1a of a text's UTF-8 bytes, as 16 hex digits; each step stays in long arithmetic without overflow errors."""
    digits = F.hex(F.encode(_c(text), "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) / 2, F.lit(1)).cast("int")), lambda i: F.conv(F.substring(digits, (i - 1) * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    # x * 0x100000001b3 modulo 2**64 = x * 0x1b3 + (x << 40), with x in two 32-bit halves
    mask = F.lit(0xFFFFFFFF)

    def step(h: Column, b: Column) -> Column:
        lo, hi = h["lo"].bitwiseXOR(b), h["hi"]
        low = lo * 0x1B3
        carry = F.shiftright(low, 32)
        high = hi * 0x1B3 + carry + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(low.bitwiseAND(mask).alias("lo"), high.bitwiseAND(mask).alias("hi"))

    start = F.struct(F.lit(0x84222325).cast("long").alias("lo"), F.lit(0xCBF29CE4).cast("long").alias("hi"))
    bytes_ = F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(codes)
    return F.aggregate(bytes_, start, step, lambda h: F.concat(F.lpad(F.lower(F.hex(h["hi"])), 8, "0"), F.lpad(F.lower(F.hex(h["lo"])), 8, "0")))


def xml_escape(text: Column | str) -> Column:
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
