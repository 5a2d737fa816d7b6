"""Value functions by the names that analysed programs call them by, as native column expressions.

``BUILTINS[name](*columns)`` builds the expression. Arrays are lists (``array<T>``) or maps (``map<K, V>``) as each function needs;
texts count code points; a null argument gives null. ``call_expression`` applies one by name, and ``register`` makes the unary
and binary ones callable from SQL under a prefix.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from factweave.functions.keys import array_key, is_numeric_string

Make = Callable[..., Column]
BUILTINS: dict[str, Make] = {}


def builtin(*names: str) -> Callable[[Make], Make]:
    def add(f: Make) -> Make:
        BUILTINS.update(dict.fromkeys(names, f))
        return f

    return add


def _l(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- arrays as lists
builtin("array_map")(lambda f, a: F.transform(a, f))
builtin("array_filter")(lambda a, f: F.filter(a, f))
builtin("array_reduce")(lambda a, f, start: F.aggregate(a, start, f))
builtin("array_merge")(lambda *a: F.concat(*a))
builtin("array_fill")(lambda start, n, value: F.map_from_entries(F.transform(F.sequence(_l(0), _l(n) - 1), lambda i: F.struct(i + start, _l(value)))))
builtin("implode", "join")(lambda glue, a: F.array_join(a, glue))
builtin("explode")(lambda sep, s: F.split(s, F.concat(F.lit(r"\Q"), _l(sep), F.lit(r"\E"))))
builtin("str_split")(lambda s: F.filter(F.split(s, ""), lambda c: c != ""))
builtin("array_reverse")(lambda a: F.reverse(a))
builtin("array_unique")(lambda a: F.array_distinct(a))
builtin("array_diff", "array_udiff")(lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x)))
builtin("array_intersect", "array_uintersect")(lambda a, b: F.filter(a, lambda x: F.array_contains(b, x)))
builtin("array_pad")(lambda a, n, v: F.concat(a, F.array_repeat(_l(v), F.greatest(_l(n) - F.size(a), F.lit(0)))))
builtin("array_column")(lambda a, name: F.transform(a, lambda x: x[name]))
builtin("range")(lambda a, b, step=1: F.sequence(_l(a), _l(b), _l(step)))
builtin("array_pop")(lambda a: F.try_element_at(a, F.lit(-1)))
builtin("array_shift")(lambda a: F.try_element_at(a, F.lit(1)))
builtin("reset", "current")(lambda a: F.try_element_at(a, F.lit(1)))
builtin("end")(lambda a: F.try_element_at(a, F.lit(-1)))
builtin("next")(lambda a, at: F.try_element_at(a, _l(at) + 2))
builtin("prev")(lambda a, at: F.when(_l(at) > 0, F.try_element_at(a, _l(at))))
builtin("array_rand")(lambda a, n=1: F.slice(F.shuffle(a), 1, n))
builtin("shuffle")(lambda a: F.shuffle(a))
builtin("count", "sizeof")(lambda a: F.size(a))
builtin("array_search")(lambda v, a: F.when(F.array_contains(a, v), F.array_position(a, v) - 1))
builtin("in_array")(lambda v, a: F.array_contains(a, v))
builtin("sort")(lambda a: F.sort_array(a))
builtin("rsort")(lambda a: F.sort_array(a, asc=False))
builtin("usort")(lambda a, f: F.array_sort(a, f))
builtin("array_walk", "array_walk_recursive")(lambda a, f: F.transform(a, f))
builtin("array_sum")(lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x))
builtin("array_product")(lambda a: F.aggregate(a, F.lit(1.0), lambda s, x: s * x))


@builtin("array_slice")
def array_slice(a: Column, offset, length=None) -> Column:
    """From a 0-based offset, negative from the end; without length to the end."""
    at = F.when(_l(offset) >= 0, _l(offset)).otherwise(F.greatest(F.size(a) + _l(offset), F.lit(0)))
    n = F.size(a) if length is None else F.when(_l(length) >= 0, _l(length)).otherwise(F.greatest(F.size(a) - at + _l(length), F.lit(0)))
    return F.slice(a, (at + 1).cast("int"), n.cast("int"))


@builtin("array_splice")
def array_splice(a: Column, offset: int, length: int, put: Column) -> Column:
    """The array with ``length`` elements from ``offset`` replaced."""
    return F.concat(F.slice(a, 1, offset), put, F.slice(a, offset + length + 1, F.greatest(F.size(a) - offset - length, F.lit(0))))


@builtin("array_chunk")
def array_chunk(a: Column, n: int) -> Column:
    count = F.ceil(F.size(a) / n).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count), lambda i: F.slice(a, i * n + 1, F.lit(n)))


@builtin("array_count_values")
def array_count_values(a: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(a), lambda v: F.struct(v, F.size(F.filter(a, lambda x: x == v)))))


# --- arrays as maps
builtin("array_values")(lambda m: F.map_values(m))
builtin("array_keys")(lambda m: F.map_keys(m))
builtin("array_key_first")(lambda m: F.try_element_at(F.map_keys(m), F.lit(1)))
builtin("array_key_last")(lambda m: F.try_element_at(F.map_keys(m), F.lit(-1)))
builtin("array_key_exists", "key_exists")(lambda k, m: F.map_contains_key(m, k))
builtin("key")(lambda m, at: F.try_element_at(F.map_keys(m), _l(at) + 1))
builtin("array_combine")(lambda k, v: F.map_from_arrays(k, v))
builtin("array_fill_keys")(lambda k, v: F.map_from_arrays(k, F.transform(k, lambda _: _l(v))))
builtin("array_flip")(lambda m: F.map_from_arrays(F.map_values(m), F.map_keys(m)))
builtin("array_change_key_case")(lambda m, upper=False: F.transform_keys(m, lambda k, _: F.upper(k) if upper else F.lower(k)))
builtin("array_diff_key", "array_diff_ukey")(lambda a, b: F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)))
builtin("array_intersect_key", "array_intersect_ukey")(lambda a, b: F.map_filter(a, lambda k, _: F.map_contains_key(b, k)))
builtin("array_diff_assoc", "array_udiff_assoc", "array_diff_uassoc", "array_udiff_uassoc")(lambda a, b: F.map_filter(a, lambda k, v: ~v.eqNullSafe(F.try_element_at(b, k)) | ~F.map_contains_key(b, k)))
builtin("array_intersect_assoc", "array_uintersect_assoc", "array_intersect_uassoc", "array_uintersect_uassoc")(lambda a, b: F.map_filter(a, lambda k, v: v.eqNullSafe(F.try_element_at(b, k)) & F.map_contains_key(b, k)))
builtin("array_merge_recursive")(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.concat(F.coalesce(x, F.array()), F.coalesce(y, F.array()))))
builtin("array_replace")(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))
builtin("compact")(lambda **named: F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]))

# sorts of maps keep each key with its value
builtin("ksort")(lambda m: _ordered(m, lambda e: F.struct(e["key"])))
builtin("krsort")(lambda m: _ordered(m, lambda e: F.struct(e["key"]), up=False))
builtin("asort")(lambda m: _ordered(m, lambda e: F.struct(e["value"])))
builtin("arsort")(lambda m: _ordered(m, lambda e: F.struct(e["value"]), up=False))
builtin("natsort")(lambda m: _ordered(m, lambda e: F.struct(_natural(e["value"]))))
builtin("natcasesort")(lambda m: _ordered(m, lambda e: F.struct(_natural(F.lower(e["value"])))))
builtin("uasort")(lambda m, f: F.map_from_entries(F.array_sort(F.map_entries(m), lambda x, y: f(x["value"], y["value"]))))
builtin("uksort")(lambda m, f: F.map_from_entries(F.array_sort(F.map_entries(m), lambda x, y: f(x["key"], y["key"]))))


def _ordered(m: Column, by: Callable[[Column], Column], up: bool = True) -> Column:
    """The map in order of ``by``; equal entries stay in their order."""
    placed = F.transform(F.map_entries(m), lambda e, i: F.struct(by(e).alias("by"), (i if up else -i).alias("i"), e.alias("e")))
    return F.map_from_entries(F.transform(F.sort_array(placed, asc=up), lambda p: p["e"]))


def _natural(s: Column) -> Column:
    """Runs of digits by their number, all else by code points."""
    return F.transform(F.regexp_extract_all(s, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.regexp_replace(x, "^0+", ""), 40, "0"))).otherwise(x))


# --- texts
builtin("strlen")(lambda s: F.octet_length(s))
builtin("mb_strlen")(lambda s: F.length(s))
builtin("strtolower")(lambda s: F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
builtin("strtoupper")(lambda s: F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
builtin("mb_strtolower")(lambda s: F.lower(s))
builtin("mb_strtoupper")(lambda s: F.upper(s))
builtin("ucfirst")(lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))
builtin("lcfirst")(lambda s: F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))))
builtin("ucwords", "mb_convert_case")(lambda s: F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " "))
builtin("trim")(lambda s: F.regexp_replace(s, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", ""))
builtin("ltrim")(lambda s: F.regexp_replace(s, r"^[ \t\n\r\x00\x0B]+", ""))
builtin("rtrim", "chop")(lambda s: F.regexp_replace(s, r"[ \t\n\r\x00\x0B]+$", ""))
builtin("strrev")(lambda s: F.reverse(s))
builtin("str_repeat")(lambda s, n: F.repeat(s, _l(n)))
builtin("str_contains")(lambda s, x: F.contains(s, _l(x)))
builtin("str_starts_with")(lambda s, x: F.startswith(s, _l(x)))
builtin("str_ends_with")(lambda s, x: F.endswith(s, _l(x)))
builtin("strpos")(lambda s, x: F.when(F.contains(s, _l(x)), F.octet_length(F.substring(s, F.lit(1), F.position(_l(x), s) - 1))))
builtin("mb_strpos")(lambda s, x: F.when(F.contains(s, _l(x)), F.position(_l(x), s) - 1))
builtin("mb_substr")(lambda s, at, n=None: F.substring(s, F.when(_l(at) >= 0, _l(at) + 1).otherwise(_l(at)).cast("int"), F.length(s) if n is None else _l(n)))
builtin("substr_replace")(lambda s, put, at, n: F.overlay(s, _l(put), _l(at) + 1, _l(n)))
builtin("str_replace")(lambda a, b, s: F.replace(s, _l(a), _l(b)))
builtin("number_format")(lambda x, n=0: F.format_number(F.round(x, n) + F.lit(0), n))  # halves away from zero, no negative zero
builtin("htmlspecialchars", "htmlentities")(lambda s: _chain(s, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")))
builtin("htmlspecialchars_decode", "html_entity_decode")(lambda s: _chain(s, ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")))
builtin("addslashes")(lambda s: F.regexp_replace(s, r"(['\"\\])", r"\\$1"))
builtin("nl2br")(lambda s: F.regexp_replace(s, r"(\r\n|\n|\r)", "<br />$1"))
builtin("urlencode")(lambda s: F.url_encode(s))
builtin("rawurlencode")(lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")))
builtin("urldecode")(lambda s: F.url_decode(s))
builtin("rawurldecode")(lambda s: F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
builtin("base64_encode")(lambda s: F.base64(F.encode(s, "UTF-8")))
builtin("base64_decode")(lambda s: F.decode(F.unbase64(s), "UTF-8"))
builtin("bin2hex")(lambda s: F.lower(F.hex(F.encode(s, "UTF-8"))))
builtin("md5")(lambda s: F.md5(s))
builtin("sha1")(lambda s: F.sha1(s))
builtin("crc32")(lambda s: F.crc32(F.encode(s, "UTF-8")))
builtin("str_rot13")(lambda s: F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"))
builtin("str_pad")(lambda s, n, fill=" ": F.when(F.length(s) >= _l(n), s).otherwise(F.rpad(s, n, fill)))
builtin("chunk_split")(lambda s, n=76, end="\r\n": F.regexp_replace(s, f"(?s)(.{{1,{n}}})", "$1" + end))
builtin("wordwrap")(lambda s, n=75: F.regexp_replace(s, f"(.{{1,{n}}})(?: |$)", "$1\n").substr(F.lit(1), F.length(s)))
builtin("count_chars")(lambda s: array_count_values(F.filter(F.split(s, ""), lambda c: c != "")))
builtin("mb_convert_encoding", "iconv")(lambda s, to: F.encode(s, to))
builtin("preg_match")(lambda pattern, s: F.regexp_like(s, F.lit(_pattern(pattern))).cast("int"))
builtin("preg_match_all")(lambda pattern, s: F.regexp_extract_all(s, F.lit(_pattern(pattern)), F.lit(0)))
builtin("preg_replace")(lambda pattern, put, s: F.regexp_replace(s, _pattern(pattern), re.sub(r"\\(\d)|\$\{(\d+)\}", lambda m: "$" + (m[1] or m[2]), put)))
builtin("preg_split")(lambda pattern, s: F.split(s, _pattern(pattern)))
builtin("levenshtein")(lambda a, b: F.levenshtein(a, b))
builtin("soundex")(lambda s: F.soundex(s))

# --- numbers
builtin("abs")(lambda x: F.abs(x))
builtin("floor")(lambda x: F.floor(x))
builtin("ceil")(lambda x: F.ceil(x))
builtin("round")(lambda x, n=0: F.round(x, n))
builtin("intdiv")(lambda a, b: F.when(_l(b) != 0, F.call_function("div", a, _l(b))))
builtin("fmod")(lambda a, b: F.try_mod(a, _l(b)))
builtin("min")(lambda *a: F.array_min(a[0]) if len(a) == 1 else F.least(*a))
builtin("max")(lambda *a: F.array_max(a[0]) if len(a) == 1 else F.greatest(*a))
builtin("pow")(lambda a, b: F.pow(a, _l(b)))
builtin("sqrt")(lambda x: F.sqrt(x))
builtin("rand", "mt_rand", "random_int")(lambda a, b: F.floor(F.rand() * (_l(b) - _l(a) + 1) + a))
builtin("is_numeric")(lambda s: is_numeric_string(s))
builtin("array_key_canonical")(lambda s: array_key(s))

# --- dates
builtin("date", "gmdate", "date_format")(lambda form, t: F.date_format(t, _date_form(form)))


@builtin("filter_var")
def filter_var(s: Column, kind: str = "int") -> Column:
    """Validation filters: int, float, bool, email; null where the text does not pass."""
    text = F.trim(s)
    if kind == "int":
        return F.when(text.rlike(r"^[+-]?(?:0|[1-9][0-9]*)$"), text.try_cast("bigint").cast("string"))
    if kind == "float":
        return F.when(is_numeric_string(text), text.try_cast("double").cast("string"))
    if kind == "bool":
        low = F.lower(text)
        return F.when(low.isin("1", "true", "on", "yes"), "true").when(low.isin("", "0", "false", "off", "no"), "false")
    return F.when(text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"), text)


@builtin("substr")
def substr(s: Column, at, n=None) -> Column:
    """Bytes from a 0-based offset, negative from the end; a negative length leaves so many bytes at the end out."""
    raw = F.encode(s, "UTF-8")
    size = F.octet_length(raw)
    start = F.when(_l(at) >= 0, F.least(_l(at), size)).otherwise(F.greatest(size + _l(at), F.lit(0)))
    rest = size - start if n is None else F.when(_l(n) >= 0, _l(n)).otherwise(F.greatest(size + _l(n) - start, F.lit(0)))
    return F.substring(raw, (start + 1).cast("int"), rest.cast("int")).cast("string")


@builtin("preg_replace_callback")
def preg_replace_callback(pattern: str, f: Callable[[Column], Column], s: Column) -> Column:
    """Each match, which must not be empty, as ``f`` makes it."""
    found = F.transform(F.regexp_extract_all(s, F.lit(f"({_pattern(pattern)})"), F.lit(1)), f)
    return F.array_join(F.zip_with(F.split(s, _pattern(pattern), -1), F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _pattern(pattern: str) -> str:
    """A pattern in delimiters with flags as one with inline flags; one without delimiters stays."""
    m = re.fullmatch(r"(?s)([/#~@%!|{(\[<])(.*)([/#~@%!|})\]>])([imsxuUD]*)", pattern)
    if not m or m[3] != {"{": "}", "(": ")", "[": "]", "<": ">"}.get(m[1], m[1]) or (m[1] in "([{<" and not m[4] and m[1] != "{"):
        return pattern
    flags = "".join(sorted(set(m[4]) & set("imsx"))) + ("uU" if "u" in m[4] else "")
    return (f"(?{flags})" if flags else "") + m[2].replace("\\" + m[1], m[1] if m[1] not in ".|()[]{}" else "\\" + m[1])


@builtin("sprintf", "vsprintf")
def sprintf(form: str, *args: Column) -> Column:
    """Directives %[n$][+][-][0 or 'c][width][.digits]type with the types b c d e f F o s u x X and %%."""
    out, taken, last = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?(\+)?(-)?(0|'.)?(-)?(\d+)?(?:\.(\d+))?([bcdeEfFosuxX%])", form):
        out.append(F.lit(form[last : m.start()]))
        last = m.end()
        kind = m[8]
        if kind == "%":
            out.append(F.lit("%"))
            continue
        at = int(m[1]) - 1 if m[1] else taken
        taken += not m[1]
        x, digits = _l(args[at]), int(m[7]) if m[7] else 6
        whole = x.cast("long")
        text = {
            "b": lambda: F.bin(whole), "c": lambda: F.char(whole), "o": lambda: F.conv(whole.cast("string"), 10, 8), "u": lambda: F.conv(whole.cast("string"), 10, 10), "d": lambda: whole.cast("string"),
            "x": lambda: F.lower(F.hex(whole)), "X": lambda: F.hex(whole), "s": lambda: x.cast("string") if m[7] is None else F.substring(x.cast("string"), 1, digits),
        }.get(kind, lambda: F.format_string(f"%.{digits}f", F.round(x.cast("double"), digits)) if kind in "fF" else F.regexp_replace(F.format_string(f"%.{digits}{kind}", x.cast("double")), r"([eE][+-])0+(\d)", "$1$2"))()
        signed = kind in "deEfF"
        if m[2] and signed:
            text = F.when(F.startswith(text, F.lit("-")), text).otherwise(F.concat(F.lit("+"), text))
        if m[6]:
            width, fill = int(m[6]), (m[4] or " ")[-1]
            if m[3] or m[5]:
                padded = F.rpad(text, width, " " if fill == "0" and signed else fill)
            elif fill == "0" and signed:
                sign = F.regexp_extract(text, "^[+-]?", 0)
                padded = F.concat(sign, F.lpad(F.regexp_replace(text, "^[+-]", ""), F.lit(width) - F.length(sign), F.lit("0")))
            else:
                padded = F.lpad(text, width, fill)
            text = F.when(F.length(text) >= width, text).otherwise(padded)
        out.append(text)
    return F.concat(*out, F.lit(form[last:]))


#: Date letters and their pattern letters (fixed values).
DATE = {"Y": "yyyy", "y": "yy", "m": "MM", "n": "M", "d": "dd", "j": "d", "H": "HH", "G": "H", "h": "hh", "g": "h", "i": "mm", "s": "ss", "A": "a", "D": "EEE", "l": "EEEE", "M": "MMM", "F": "MMMM"}


def _date_form(form: str) -> str:
    return "".join(DATE.get(c, f"'{c}'" if c.isalpha() else c) for c in form)


def _chain(s: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def call_expression(name: str, *args, **named) -> Column:
    return BUILTINS[name.lower().lstrip("\\")](*args, **named)


#: Built-ins whose SQL text is one expression of x, for registration (fixed values).
SQL_UNARY = {"ucfirst": "concat(upper(substring(x, 1, 1)), substring(x, 2))", "str_rot13": "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')", "nl2br": "regexp_replace(x, '(\\r\\n|\\n|\\r)', '<br />$1')"}


def register(spark: SparkSession, prefix: str = "php_") -> list[str]:
    """Temporary SQL functions, inlined by the optimizer; their names."""
    for name, body in SQL_UNARY.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURNS STRING RETURN {body}")
    return [prefix + n for n in SQL_UNARY]
