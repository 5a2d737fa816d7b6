import pytest

from pyspark.sql import functions as F

from factweave.operators import lookup
from factweave.operators.kernel import analyse_scopes, run_scope
from factweave.plugins import Plugin, Registry
from factweave.sources.cache import ResultCache
from factweave.sources.files import TextSource, autoload_rules, baseline, scan
from factweave.sources.sinks import ci_lines, json_lines, junit_suites, sarif, text_lines, write_baseline, write_junit, write_sarif


def run(*ops):
    events = [(i, *(o if isinstance(o, tuple) else (o, None)), ["int"]) for i, o in enumerate(ops)]
    return {(p, k) for p, k, _, _ in run_scope(events) if k != "env"}


A, R = ("assign", "x"), ("read", "x")


@pytest.mark.parametrize(
    ("ops", "want"),
    [
        ([A, R], set()),
        ([R], {(0, "UndefinedVariable")}),
        ([A, A, R], {(0, "UnusedVariable")}),
        (["branch", A, "endif", R], {(3, "PossiblyUndefinedVariable")}),
        (["branch", A, "else", A, "endif", R], set()),
        (["branch", A, "else", "leave", "endif", R], set()),
        (["branch", "leave", "else", "leave", "endif", R], {(5, "UnreachableCode")}),
        (["leave", A, R], {(1, "UnreachableCode")}),
        (["loop", R, A, "endloop"], {(1, "PossiblyUndefinedVariable")}),
        ([A, "loop", R, A, "endloop"], set()),
        (["loop", A, "leave", "endloop", R], {(4, "PossiblyUndefinedVariable")}),
        ([], set()),
    ],
)
def test_kernel(ops, want):
    assert run(*ops) == want


def test_types_join_over_branches_and_loops():
    events = [(0, "assign", "x", ["int"]), (1, "loop", None, []), (2, "read", "x", []), (3, "branch", None, []), (4, "assign", "x", ["string"]), (5, "endif", None, []), (6, "endloop", None, []), (7, "read", "x", [])]
    assert {p: t for p, k, _, t in run_scope(events) if k == "env"} == {2: ["int", "string"], 7: ["int", "string"]}


def test_scopes_are_apart_and_order_is_by_position(spark):
    rows = [("f", "a", 2, "read", "x", None), ("f", "a", 1, "assign", "x", ["int"]), ("f", "b", 1, "read", "x", None)]
    out = analyse_scopes(spark.createDataFrame(rows, "file string, scope string, pos long, op string, var string, types array<string>"))
    assert sorted((r.scope, r.pos, r.kind) for r in out.collect()) == [("a", 2, "env"), ("b", 1, "UndefinedVariable"), ("b", 1, "env")]


def test_lookups(spark):
    make = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    refs = make("receiver string, within string", ("self", "A"), ("Parent", "A"), ("static", "A"), ("X", None))
    got = lookup.receiver(refs, make("child string, parent string", ("A", "B"))).collect()
    assert sorted((r.receiver, r.target) for r in got) == [("Parent", "B"), ("X", "X"), ("self", "A"), ("static", "A")]
    imports = make("file string, alias string, fqcn string", ("f", "A", "N\\A"), ("g", "B", "n\\a"), ("g", "C", "N\\C"))
    assert lookup.import_references(imports, make("fqcn string", ("N\\a",))).count() == 2
    own = lookup.own_member(make("class string, name string", ("A", "Run"), ("A", "x")), make("class string, name string, p int", ("A", "run", 1)))
    assert [(r["name"], r.p) for r in own.collect()] == [("Run", 1)]
    at = lookup.name_range(make("file string, line int, name string", ("f", 2, "B"), ("f", 9, "B")), make("file string, text string", ("f", "a\nclass B {}")), F.col("name"))
    assert sorted((r.line, r.name_start, r.name_end) for r in at.collect()) == [(2, 6, 7), (9, None, None)]
    gone = lookup.trait_constraints(make("class string, trait string", ("A", "T"), ("B", "T")), make("trait string, required string", ("T", "I")), make("child string, ancestor string", ("A", "I")))
    assert [(r["class"], r.required) for r in gone.collect()] == [("B", "I")]
    step = lambda c, p, a: (c, p, a)
    schema = "child string, parent string, args map<string,string>"
    projected = lookup.project_arguments(make(schema, step("Mid", "Top", {"V": "T"})), make(schema, step("Leaf", "Mid", {"T": "int"}))).collect()
    assert [(r.child, r.ancestor, r.args) for r in projected] == [("Leaf", "Top", {"V": "int"})]


def test_plugins(spark):
    issues = spark.createDataFrame([("K", "f"), ("L", "f")], "kind string, file string")
    more = Plugin("Own", rules=[lambda facts: issues.sparkSession.createDataFrame([("M", "g")], "kind string, file string")], veto=lambda i: i["kind"] == "L", returns={"\\Make": lambda F: F.lit("Made")})
    r = Registry(more)
    with pytest.raises(ValueError, match="already"):
        r.add(Plugin("\\own"))
    assert sorted(x["kind"] for x in r.issues(None, issues).collect()) == ["K", "M"]
    calls = r.return_types(spark.createDataFrame([("make",), ("other",)], "callee string")).collect()
    assert [x.returned for x in calls] == ["Made", None]


def test_cache_keeps_the_newest_whole_snapshot(spark, tmp_path):
    c = ResultCache(spark, str(tmp_path / "cache"), {"entry": "path string, content_hash string"})
    assert c.read("entry").count() == 0
    for n in (1, 2):
        c.write(entry=spark.createDataFrame([(f"p{i}", "h") for i in range(n)], "path string, content_hash string"))
    assert c.read("entry").count() == 2
    (tmp_path / "cache" / "f1-000000000009-cut").mkdir()
    assert ResultCache(spark, str(tmp_path / "cache"), c.tables).read("entry").count() == 2
    assert ResultCache(spark, str(tmp_path / "cache"), c.tables, format_version=2).read("entry").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "src" / "vendor").mkdir(parents=True)
    (tmp_path / "src" / "a.php").write_text("<?php é", encoding="utf-8")
    (tmp_path / "src" / "b.txt").write_text("x")
    (tmp_path / "src" / "vendor" / "c.php").write_text("<?php")
    assert [(r.path.rpartition("/")[2], r.text) for r in scan(spark, str(tmp_path / "src")).collect()] == [("a.php", "<?php é")]
    spark.dataSource.register(TextSource)
    assert spark.read.format("factweave_texts").option("json", '{"p": "t", "q": "u"}').load().count() == 2
    rules = autoload_rules(spark, '{"autoload": {"psr-4": {"A\\\\": ["x", "y"]}}, "autoload-dev": {"psr-0": {"": "t"}}}')
    assert rules.count() == 3
    issue = ("UnusedX", "0001", "info", "s/a.php", 3, 4, 0, 7, "50% <b>\nx", 'say "a" & b')
    rows = spark.createDataFrame([issue, issue[:3] + ("z.php",) + issue[4:-1] + (None,)], "kind string, code string, severity string, file string, line int, line_end int, col_start int, col_end int, message string, snippet string")
    assert text_lines(rows).first()[0] == "s/a.php:3:0 info[0001] UnusedX: 50% <b>\nx"
    assert ci_lines(rows).first()[0] == "::notice file=s/a.php,line=3,col=1::UnusedX: 50%25 <b>%0Ax"
    assert '"kind":"UnusedX"' in json_lines(rows).first()[0]
    assert 'message="50% &lt;b&gt;' in junit_suites(rows).filter("file = 'z.php'").first().value
    log = __import__("json").loads(sarif(rows, "factweave"))
    (rule,) = log["runs"][0]["tool"]["driver"]["rules"]
    assert log["runs"][0]["results"][0]["rank"] == 99.0 and rule["id"] == rule["name"] == "UnusedX" and rule["defaultConfiguration"] == {"level": "note"} and rule["properties"] == {"tags": ["maintainability"]}
    for few in (rows, rows.limit(0)):
        write_sarif(few, str(tmp_path / "sarif"), "tool")
        text = "".join(p.read_text() for p in sorted((tmp_path / "sarif").glob("part-*")))
        assert len(__import__("json").loads(text)["runs"][0]["results"]) == few.count()
        write_junit(few, str(tmp_path / "junit"), "t")
        whole = "".join(p.read_text() for p in sorted((tmp_path / "junit").glob("part-*")))
        assert [s.get("failures") for s in __import__("xml.etree.ElementTree", fromlist=["x"]).fromstring(whole).iter("testsuite")] == ["0"] * few.count()
    write_baseline(rows, str(tmp_path / "base"))
    whole = "\n".join(p.read_text() for p in sorted((tmp_path / "base").glob("part-*")))
    (tmp_path / "base.xml").write_text(whole)
    assert sorted((r.file, r["kind"], r.snippet) for r in baseline(spark, str(tmp_path / "base.xml")).collect()) == [("s/a.php", "UnusedX", 'say "a" & b'), ("z.php", "UnusedX", "")]


def test_value_functions_at_their_edges(spark):
    from pyspark.sql import functions as F

    from factweave.functions.builtins import BUILTINS as B

    row = spark.range(1).select(F.lit("éa").alias("s"), F.lit(9007199254740993).alias("big"), F.lit(-5).alias("n"), F.lit(1234.5).alias("x"), F.create_map(*map(F.lit, ("b", "img12", "c", "img2", "a", "IMG10"))).alias("m"))
    s, big, n, x, m = (F.col(c) for c in ("s", "big", "n", "x", "m"))
    cases = [
        (B["strpos"](s, "a"), 2), (B["mb_strpos"](s, "a"), 1), (B["strpos"](s, "z"), None), (B["strlen"](s), 3), (B["substr"](s, 2), "a"), (B["substr"](s, -1), "a"), (B["substr"](s, 0, -1), "é"), (B["mb_substr"](s, 1), "a"),
        (B["intdiv"](big, 1), 9007199254740993), (B["intdiv"](n, 2), -2), (B["intdiv"](n, 0), None), (B["number_format"](F.lit(0.5)), "1"), (B["number_format"](F.lit(-0.4)), "0"), (B["number_format"](x, 1), "1,234.5"),
        (F.map_keys(B["ksort"](m)), ["a", "b", "c"]), (F.map_keys(B["krsort"](m)), ["c", "b", "a"]), (F.map_keys(B["asort"](m)), ["a", "b", "c"]), (F.map_keys(B["arsort"](m)), ["c", "b", "a"]), (F.map_keys(B["natsort"](m)), ["a", "c", "b"]), (F.map_keys(B["natcasesort"](m)), ["c", "a", "b"]),
        (B["preg_match"]("/^É/iu", s), 1), (B["preg_match"]("^a", s), 0), (B["preg_replace"]("~(a)~", "<\\1>", s), "é<a>"), (B["preg_replace_callback"]("/[a-z]/", lambda c: F.upper(c), F.lit("a1b2")), "A1B2"),
        (B["sprintf"]("%05d|%5s|%-5s|%'*7.2f|%x|%b|%%|%2$s|%+d", n, s, s, x, F.lit(255), F.lit(5), F.lit(3)), "-0005|   éa|éa   |1234.50|ff|101|%|éa|+3"), (B["sprintf"]("%e", x), "1.234500e+3"),
    ]
    got = row.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for have, (_, want) in zip(got, cases, strict=True):
        assert have == want


def test_prefixes_of_any_ending(spark):
    from factweave.operators import references

    items = spark.createDataFrame([("Twig_Env",), ("Twig",), ("",), (None,), ("A\\B\\C",)], "x string")
    rules = spark.createDataFrame([("Twig_",), ("A\\",), ("A\\B",), ("Tw",), (None,)], "p string")
    got = {r.x: r.p for r in references.longest_prefix(items, "x", rules, "p").collect()}
    assert got == {"Twig_Env": "Twig_", "Twig": "Tw", "": None, None: None, "A\\B\\C": "A\\B"}
    names, files = items.filter("x = 'Twig_Env'").toDF("fqcn"), spark.createDataFrame([("lib/Twig/Env.php",)], "path string")
    psr0 = spark.createDataFrame([("psr-0", False, "Twig_", "lib")], "scheme string, is_project boolean, prefix string, dir string")
    assert [tuple(r) for r in references.autoload(names, psr0, files, spark.createDataFrame([], "fqcn string, path string")).collect()] == [("Twig_Env", "lib/Twig/Env.php")]


def test_cycles_equal_mutual_reachability(spark):
    import random

    from factweave.plans import closure

    rng = random.Random(6)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)} | {(100 + i, 101 + i) for i in range(20)} | {(120, 110), (200, 200), (300, 301), (301, 300), (301, 302)}
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    for _ in range(60):
        reach = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
    want = {a: max(b for b in bs if a in reach.get(b, ())) for a, bs in reach.items() if a in bs}
    assert dict(map(tuple, closure.cycles(spark.createDataFrame(sorted(edges), "src long, dst long")).collect())) == want


def test_deltas_of_null_keys_and_walks_of_many_children(spark):
    from factweave.operators.index import symbol_delta
    from factweave.plans import closure

    a, b = (spark.createDataFrame(rows, "k string") for rows in ([(None,), ("x",)], [(None,), ("y",)]))
    assert sorted(map(tuple, symbol_delta(a, b, "k").collect())) == [("x", "deleted"), ("y", "added")]
    edges = spark.createDataFrame([("r", "late", 12345), ("r", "soon", 9000)], "src string, dst string, ord int")
    assert [r.node for r in closure.linearised(edges, spark.createDataFrame([("r",)], "start string")).orderBy("rank").collect()] == ["r", "soon", "late"]


def test_a_table_of_deltas_and_snapshots(spark, tmp_path):
    from factweave.streaming.edits import VersionedTable

    table, state, states = VersionedTable(spark, str(tmp_path / "t"), "path string, n long", every=3), {}, {}
    for v in range(11):
        changed = [(f"f{(v * k) % 7}", 100 * v + k) for k in range(3)]
        state = states[v] = state | dict(changed)
        table.write(spark.createDataFrame(sorted(dict(changed).items()), table.schema), v)
        assert dict(map(tuple, table.read().collect())) == state
    again = VersionedTable(spark, str(tmp_path / "t"), "path string, n long", every=3)
    assert again.version == 10 and dict(map(tuple, again.read(6).collect())) == states[6] and dict(map(tuple, again.read().collect())) == state
    assert again._versions("whole") == [5, 8] and again._versions("delta") == [6, 7, 8, 9, 10]
    assert VersionedTable(spark, str(tmp_path / "new"), "path string, n long").read().count() == 0


def test_union_of_true_and_false(spark):
    from pyspark.sql import functions as F

    from factweave.functions.types import atom, union

    sets = {"both": union(F.array(atom("true"), atom("int")), F.array(atom("false"))), "one": union(F.array(atom("true")), F.array(atom("int"))), "bool": union(F.array(atom("false"), atom("true")), F.array(atom("bool")))}
    row = spark.range(1).select(*[F.transform(c, lambda x: x["tag"]).alias(n) for n, c in sets.items()]).first()
    assert sorted(row.both) == ["bool", "int"] and row.one == ["true", "int"] and row.bool == ["bool"]
