"""Hand-made fixtures: small tables with expected rows, nulls, ties and empty inputs."""

import json

from pyspark.sql import functions as F

from factweave.functions import intervals as iv
from factweave.functions import keys
from factweave.functions import types as t
from factweave.operators import flow, hierarchy, incremental, index, issues, references
from factweave.plans import closure


def make(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_cycle_members_and_one_issue(spark):
    e = make(spark, "child string, parent string", ("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"))
    assert got(closure.cycles(e.toDF("src", "dst")), "node") == [("A",), ("B",), ("C",)]
    assert got(hierarchy.inheritance_cycles(e), "node") == [("C",)]


def test_closure_of_nothing_and_of_nulls(spark):
    e = make(spark, "src string, dst string")
    assert closure.transitive(e).count() == 0
    e = make(spark, "src string, dst string", (None, "B"), ("A", None), ("A", "B"), ("A", "B"))
    assert got(closure.transitive(e), "src", "dst") == [("A", "B")]


def test_subtypes_with_and_without_trait_users(spark):
    e = make(spark, "child string, parent string, relation string", ("C", "T", "trait"), ("D", "C", "super"), ("E", "U", "trait"))
    root = make(spark, "fqcn string", ("T",))
    assert got(hierarchy.subtypes(e, root), "fqcn") == []
    assert got(hierarchy.subtypes(e, root, include_trait_users=True), "fqcn") == [("C",), ("D",)]


def test_lookup_order_and_trait_rules(spark):
    e = make(spark, "child string, parent string, relation string, ord int", ("C", "P", "parent", 0), ("C", "T1", "trait", 0), ("C", "T2", "trait", 1), ("P", "G", "parent", 0))
    ranked = hierarchy.linearisation(e, make(spark, "fqcn string", ("C",)))
    assert [r[0] for r in ranked.orderBy("rank").select("ancestor").collect()] == ["C", "T1", "T2", "P", "G"]
    members = make(spark, "owner string, name string, payload string", ("T1", "run", "t1"), ("T2", "run", "t2"), ("P", "run", "p"), ("G", "far", "g"))
    wanted = make(spark, "class string, name string", ("C", "run"), ("C", "far"), ("C", "other"), ("C", "none"))
    assert got(hierarchy.chain_lookup(ranked, members, wanted), "name", "owner", "payload") == [("far", "G", "g"), ("run", "T1", "t1")]
    rules = make(spark, "class string, trait string, method string, alias string, excluded boolean", ("C", "T1", "run", None, True), ("C", "T1", "run", "other", False))
    assert got(hierarchy.with_trait_rules(ranked, members, rules, wanted), "name", "owner", "payload") == [("far", "G", "g"), ("other", "C", "t1"), ("run", "T2", "t2")]


def test_walk_ends_on_cycles(spark):
    e = make(spark, "src string, dst string, ord int", ("A", "B", 0), ("B", "A", 0), ("A", "C", 1))
    assert got(closure.linearised(e, make(spark, "start string", ("A",))), "node", "rank") == [("A", 0), ("B", 1), ("C", 2)]


def test_symbol_winner_tiers(spark):
    d = make(spark, "key string, tier int, ord int", ("k", 0, 1), ("k", 0, 2), ("k", 1, 3), ("k", 1, 4), ("n", 0, 1), ("n", 0, 2), (None, 1, 1))
    assert got(index.symbol_winner(d, "key", "tier", "ord"), "key", "ord") == [("k", 4), ("n", 1)]


def test_baseline_is_a_multiset(spark):
    i = make(spark, "file string, kind string, snippet string, emit_ord int", ("f", "X", None, 1), ("f", "X", None, 2), ("f", "X", "", 3))
    base = make(spark, "file string, kind string, snippet string", ("f", "X", ""), ("f", "X", ""))
    assert got(issues.baseline_new(i, base, ["emit_ord"]), "emit_ord") == [(3,)]
    assert got(issues.baseline_update(i.limit(1), base), "n") == [(1,)]
    assert issues.baseline_new(i, base.limit(0), ["emit_ord"]).count() == 3


def test_eviction_stops_at_bodies(spark):
    changes = make(spark, "path string, change string", ("a", "body"), ("b", "surface"), ("e", "same"))
    edges = make(spark, "src string, dst string", ("c", "b"), ("d", "c"), ("e", "a"))
    assert got(incremental.evict(changes, edges), "path") == [("c",), ("d",)]


def test_unused_suppression(spark):
    d = make(spark, "file string, line int, covered array<int>, kinds array<string>", ("f", 1, [1, 2], ["Named", "Used"]))
    i = make(spark, "file string, line int, kind string, code string", ("f", 2, "used", "X1"))
    assert got(issues.unused_suppressions(i, d), "name") == [("Named",)]


def test_directive_matches_kind_code_and_alias_in_any_case(spark):
    i = make(spark, "file string, line int, kind string, code string", ("f", 1, "UnusedX", "M1"), ("f", 2, "UnusedX", "M1"), ("g", 9, "Other", "M2"))
    d = make(spark, "file string, line int, scope string, kinds array<string>", ("f", 1, "line", ["m1"]), ("f", 1, "next", ["old"]), ("g", 1, "file", None))
    out = issues.suppress(i, d, {"Old": "unusedx"})
    assert got(out, "file", "line", "suppressed") == [("f", 1, True), ("f", 2, True), ("g", 9, True)]


def test_intersection_of_ranges_and_narrowing(spark):
    one = spark.range(1)
    a, b = F.array(t.atom("int", lo=0, hi=5)), F.array(t.atom("int", lo=3, hi=9))
    two, s = F.array(t.atom("int", lo=1, hi=1), t.atom("int", lo=2, hi=2)), F.array(t.atom("string"))
    span = lambda lo, hi: iv.interval(F.lit(lo).cast("long"), F.lit(hi).cast("long"))
    row = one.select(t.display(t.intersect(a, b)), t.display(t.intersect(F.array(t.atom("int")), two)), t.display(t.intersect(s, a)), iv.intersect(span(0, 5), span(3, 9)), iv.intersect(span(0, 1), span(3, 9)), iv.narrow(span(0, 5), ">", F.lit(3))).first()
    assert [row[0], row[1], row[2]] == ["never", "1|2", "never"]
    assert tuple(row[3]) == (3, 5) and row[4] is None and tuple(row[5]) == (4, 5)


def test_union_absorbs(spark):
    lit, base, top = t.atom("literal-string", "a"), t.atom("string"), t.atom("mixed")
    row = spark.range(1).select(t.display(t.union(F.array(lit), F.array(base))), t.display(t.union(F.array(lit), F.array(top))), t.display(t.union(F.array(t.atom("true")), F.array(t.atom("null")))), t.clone_validity(F.array(base, t.atom("object")))).first()
    assert list(row) == ["string", "mixed", "true|null", "possibly"]


def test_mentions_are_whole_identifiers(spark):
    row = spark.createDataFrame([("fooBar foo_ foo FOO",), ("foo_ xfoo",), (None,)], "x string").select(keys.mentions("x", "foo")).collect()
    assert [r[0] for r in row] == [True, False, None]


def test_overflow_is_unbounded(spark):
    big = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(2**63 - 1).cast("long").alias("hi"))
    row = spark.range(1).select(iv.add(big, big), iv.multiply(big, big)).first()
    assert tuple(row[0]) == (0, None) and tuple(row[1]) == (None, None)


def test_fingerprint_is_fnv1a(spark):
    row = spark.createDataFrame([("",), ("a",), ("foobar",)], "x string").select(keys.fnv1a("x")).collect()
    assert [r[0] for r in row] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


def test_autoload_prefers_psr4_then_project_then_length(spark):
    rules = make(spark, "scheme string, is_project boolean, prefix string, dir string", ("psr-4", True, "App\\", "src"), ("psr-4", True, "App\\Sub\\", "sub/"), ("psr-0", True, "", "old"))
    files = make(spark, "path string", ("src/Sub/X.php",), ("sub/X.php",), ("old/A/B/C.php",))
    names = make(spark, "fqcn string", ("App\\Sub\\X",), ("A\\B_C",), ("No\\Where",))
    found = references.autoload(names, rules, files, make(spark, "fqcn string, path string"))
    assert got(found, "fqcn", "path") == [("A\\B_C", "old/A/B/C.php"), ("App\\Sub\\X", "sub/X.php")]


def test_taint_and_sanitizers(spark):
    n = lambda *x: make(spark, "node string", *[(i,) for i in x])
    flows = make(spark, "src string, dst string", ("s", "a"), ("a", "b"), ("s", "c"), ("c", "d"))
    assert got(flow.tainted(n("s"), flows, n("b", "d"), n("c")), "node") == [("b",)]


def test_branches_merge(spark):
    env = lambda *rows: make(spark, f"var string, types array<{t.ATOM}>", *rows)
    a, b = env(("x", [("int", None, None, None, None)]), ("y", [("null", None, None, None, None)])), env(("x", [("string", None, None, None, None)]))
    out = flow.merge_branches(a, b, ["var"]).select("var", t.display(F.col("types")), "possibly_undefined")
    assert sorted(map(tuple, out.collect())) == [("x", "int|string", False), ("y", "null", True)]


def test_members_that_may_be_seen(spark):
    refs = make(spark, "caller string, declarer string, visibility int", ("A", "A", 2), ("B", "A", 1), ("C", "A", 1), ("B", "A", 2), (None, "A", 0))
    pairs = make(spark, "child string, ancestor string", ("B", "A"))
    assert got(hierarchy.visible(refs, pairs).na.fill("-"), "caller", "visibility") == [("-", 0), ("A", 2), ("B", 1)]
