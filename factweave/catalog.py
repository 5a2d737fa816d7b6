"""Every operator applied to the generated tables, by name, with the SQL that it equals.

The tables hold no program facts; each query maps an operator to columns of the same shape. What the mapping stands for is in the
query's docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import intervals as iv
from factweave.functions import keys
from factweave.operators import flow, hierarchy, incremental, index, issues, references
from factweave.plans import closure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- references and declarations


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
def unreferenced_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Customers (declarations) without a large order (reference); one segment is exempt."""
    refs = read(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    decls = read(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    return references.unreferenced(decls, refs, "c_custkey", F.col("c_mktsegment") == "MACHINERY").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def unresolved_references(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return references.unresolved(refs, read(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k")), "k").select("o_orderkey", F.col("k").alias("o_custkey"))


@query("""SELECT n_name, count(*) AS n_refs, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    found = references.resolve(refs, read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    return references.resolve(found, read(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").groupBy("n_name").agg(F.count("*").alias("n_refs"), F.sum("o_totalprice").alias("total"))


@query("""SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_size = 7)
    AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def find_references(spark: SparkSession, d: str) -> DataFrame:
    """References to a family of keys inside a scope of files."""
    refs = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber", F.col("l_partkey").alias("key"))
    family = read(spark, d, "part").filter("p_brand = 'Brand#11' or p_size = 7").select(F.col("p_partkey").alias("key"))
    scope = read(spark, d, "orders").filter("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("file"))
    return references.find_references(refs, family, "key", scope).select(F.col("file").alias("l_orderkey"), "l_linenumber", F.col("key").alias("l_partkey"))


@query("""SELECT DISTINCT x.l_suppkey AS src, y.p_size AS dst FROM lineitem x JOIN part y ON x.l_partkey = y.p_partkey WHERE x.l_suppkey <> y.p_size""")
def dependency_edges(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("key"))
    defined = read(spark, d, "part").select(F.col("p_size").cast("long").alias("file"), F.col("p_partkey").alias("key"))
    return references.dependencies(refs, defined, "key")


_EDGE = "(SELECT DISTINCT l_suppkey AS src, l_partkey % 50 AS dst FROM lineitem WHERE l_suppkey <> l_partkey % 50)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst")).filter("src <> dst").distinct()


@query(f"SELECT dst, list_sort(list(src)) AS dependents FROM {_EDGE} GROUP BY dst")
def reverse_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return references.reverse_dependencies(_edges(spark, d))


@query(f"""SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {_EDGE}
    UNION ALL SELECT dst, 0, 1 FROM {_EDGE}) GROUP BY node""")
def edge_degrees(spark: SparkSession, d: str) -> DataFrame:
    return references.degrees(_edges(spark, d))


# --- indexes


@query("""SELECT lang, doc_id, source FROM (SELECT *, CASE WHEN source < 'src12' THEN 0 WHEN source < 'src5' THEN 1 ELSE 2 END AS tier FROM documents)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY tier DESC, CASE WHEN tier = 0 THEN doc_id ELSE -doc_id END) = 1""")
def symbol_winner(spark: SparkSession, d: str) -> DataFrame:
    """One document of each language: tier from the source, the lowest tier keeps its first, others their last."""
    tier = F.when(F.col("source") < "src12", 0).when(F.col("source") < "src5", 1).otherwise(2)
    return index.symbol_winner(read(spark, d, "documents").select("lang", "doc_id", "source", tier.alias("tier")), "lang", "tier", "doc_id").select("lang", "doc_id", "source")


@query("""SELECT p_brand, list_sort(list(DISTINCT p_type)) AS found, count(*) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1""")
def collision_buckets(spark: SparkSession, d: str) -> DataFrame:
    return index.collisions(read(spark, d, "part"), "p_brand", "p_type")


_TOKENS = "(SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) AS token FROM documents)"


@query(f"SELECT token, count(*) AS n_docs FROM {_TOKENS} GROUP BY token")
def posting_list(spark: SparkSession, d: str) -> DataFrame:
    return index.token_counts(read(spark, d, "documents"), keys.identifier_tokens("text"))


@query(f"""SELECT DISTINCT doc AS doc_id FROM {_TOKENS} WHERE token IN (SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) FROM benchmark) AND length(token) >= 10""")
def mention_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents that mention a long word of any benchmark item."""
    needles = read(spark, d, "benchmark").select(F.explode(keys.identifier_tokens("text")).alias("needle")).filter("length(needle) >= 10")
    return references.mention_gate(read(spark, d, "documents"), "doc_id", keys.identifier_tokens("text"), needles, "needle")


@query("SELECT c_nationkey, count(*) AS n_docs, list_sort(list(DISTINCT c_mktsegment)) AS names FROM customer GROUP BY c_nationkey")
def defined_symbols(spark: SparkSession, d: str) -> DataFrame:
    made = read(spark, d, "customer")
    return index.defined_symbols(made, "c_nationkey", "c_mktsegment").join(made.groupBy("c_nationkey").agg(F.count("*").alias("n_docs")), "c_nationkey")


@query("SELECT split_part(p_name, ' ', -1) AS short, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY ALL")
def short_name_index(spark: SparkSession, d: str) -> DataFrame:
    return index.short_name_index(read(spark, d, "part"), F.substring_index("p_name", " ", -1), "p_name")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The type that a global variable has in the first file that sets it."""
    return index.first_wins(read(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')
    SELECT o_custkey, 'deleted' AS change FROM a WHERE o_custkey NOT IN (SELECT * FROM b) UNION ALL SELECT o_custkey, 'added' FROM b WHERE o_custkey NOT IN (SELECT * FROM a)""")
def symbol_delta(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return index.symbol_delta(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "o_custkey")


@query("""WITH n AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey), s AS (SELECT l_suppkey, n, sum(n) OVER (ORDER BY l_suppkey) AS past FROM n)
    SELECT l_suppkey, (past - n)::BIGINT AS first, past::BIGINT AS past FROM s""")
def contiguous_ranges(spark: SparkSession, d: str) -> DataFrame:
    return index.contiguous_ranges(read(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


# --- closures


_GRAPH = """(SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey % 3) % 997 AS dst FROM orders)"""


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % 997).alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS {_GRAPH}, r AS (SELECT src, dst FROM e WHERE src IN (SELECT min(src) FROM e UNION ALL SELECT max(src) FROM e)
    UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r""")
def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    """All nodes reachable from two seeds on a cyclic graph."""
    e = _graph(spark, d)
    seeds = e.agg(F.explode(F.array(F.min("src"), F.max("src"))).alias("src"))
    return closure.transitive(e, seeds).select("src", "dst")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_size AS src, p_size * 3 % 51 AS dst FROM part),
    p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)
    SELECT a.src AS node, max(a.dst) AS cycle FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def cycle_detection(spark: SparkSession, d: str) -> DataFrame:
    return closure.cycles(read(spark, d, "part").select(F.col("p_size").alias("src"), (F.col("p_size") * 3 % 51).alias("dst")))


_TREE = """(SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    def edge(name: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return read(spark, d, name).select(F.concat(F.lit(a), x).alias("child"), F.concat(F.lit(b), y).alias("parent"))

    return edge("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query(f"""WITH RECURSIVE e AS {_TREE}, r AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT r.child, e.parent, depth + 1 FROM r JOIN e ON r.ancestor = e.child)
    SELECT child, ancestor, depth FROM r""")
def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestors(_tree(spark, d))


@query(f"""WITH RECURSIVE e AS {_TREE}, r AS (SELECT child AS fqcn FROM e WHERE parent = 'r1' UNION SELECT e.child FROM r JOIN e ON e.parent = r.fqcn) SELECT fqcn FROM r""")
def subtype_closure(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.subtypes(_tree(spark, d).withColumn("relation", F.lit("super")), spark.createDataFrame([("r1",)], "fqcn string"))


@query("""WITH m AS (SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN 'own' END AS own, n_name, n_nationkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT 'c' || c_custkey AS class, 'limit' AS name, CASE WHEN own IS NOT NULL THEN 'c' || c_custkey WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE 'region' END AS owner,
    coalesce(own, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'default' END) AS payload FROM m""")
def member_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first declaration of a member along customer, nation, region."""
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    name, me = F.lit("limit").alias("name"), F.concat(F.lit("c"), "c_custkey")
    ranked = (
        c.select(me.alias("class"), me.alias("ancestor"), F.lit(0).alias("rank"))
        .unionByName(c.select(me.alias("class"), F.concat(F.lit("n"), "c_nationkey").alias("ancestor"), F.lit(1).alias("rank")))
        .unionByName(c.select(me.alias("class"), F.lit("region").alias("ancestor"), F.lit(2).alias("rank")))
    )
    members = (
        c.filter("c_acctbal > 8000").select(me.alias("owner"), name, F.lit("own").alias("payload"))
        .unionByName(n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("owner"), name, F.col("n_name").alias("payload")))
        .unionByName(spark.createDataFrame([("region", "limit", "default")], "owner string, name string, payload string"))
    )
    return hierarchy.chain_lookup(ranked, members, c.select(me.alias("class"), name))


@query(f"""WITH RECURSIVE e AS {_GRAPH}, clean AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal < 0),
    r AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node AND r.node NOT IN (SELECT node FROM clean))
    SELECT node FROM r WHERE node IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)""")
def taint_reachability(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one segment are sources, rich ones sinks, indebted ones sanitizers."""
    c = read(spark, d, "customer").withColumn("node", F.col("c_custkey"))
    return flow.tainted(c.filter("c_mktsegment = 'BUILDING'"), _graph(spark, d), c.filter("c_acctbal > 8000"), c.filter("c_acctbal < 0")).select("node")


# --- incremental


_SNAP = """(SELECT o_orderkey AS path, o_orderstatus AS status, sha256(o_orderstatus || o_orderpriority || CASE WHEN o_totalprice > 300000 THEN 'x' ELSE '' END) AS b, sha256(o_orderstatus || o_orderpriority) AS a,
    CASE WHEN o_totalprice > 400000 THEN o_orderstatus || 'y' ELSE o_orderstatus END AS sb, o_orderstatus AS sa, o_orderpriority <> '1-URGENT' AS in_a, o_orderpriority <> '5-LOW' AS in_b FROM orders)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the orders: each lacks one priority, and dear orders changed their content, very dear ones their surface."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("status"), "o_orderpriority", "o_totalprice")
    text = F.concat("status", "o_orderpriority")
    old = o.filter("o_orderpriority <> '1-URGENT'").select("path", "status", incremental.content_hash(text).alias("content_hash"), F.col("status").alias("surface_hash"))
    new = o.filter("o_orderpriority <> '5-LOW'").select(
        "path", "status", incremental.content_hash(F.concat(text, F.when(F.col("o_totalprice") > 300000, "x").otherwise(""))).alias("content_hash"),
        F.when(F.col("o_totalprice") > 400000, F.concat("status", F.lit("y"))).otherwise(F.col("status")).alias("surface_hash"),
    )
    return old, new


@query(f"""SELECT path, CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'removed' WHEN a = b THEN 'same' WHEN sa = sb THEN 'body' ELSE 'surface' END AS change FROM {_SNAP}""")
def content_change(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots compared by content and surface hash."""
    return incremental.compare(*_snapshots(spark, d))


@query(f"""WITH RECURSIVE c AS (SELECT path, CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'removed' WHEN a = b THEN 'same' WHEN sa = sb THEN 'body' ELSE 'surface' END AS change FROM {_SNAP}),
    e AS (SELECT o_orderkey AS src, o_orderkey // 3 AS dst FROM orders),
    r AS (SELECT path FROM c WHERE change IN ('surface', 'removed', 'added') UNION SELECT e.src FROM r JOIN e ON e.dst = r.path)
    SELECT path FROM r WHERE path NOT IN (SELECT path FROM c WHERE change <> 'same')""")
def evict_dependents(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return incremental.evict(incremental.compare(old, new), read(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.floor(F.col("o_orderkey") / 3).alias("dst")))


@query(f"""SELECT count(*) FILTER (in_a AND in_b AND a = b) AS reused, count(*) FILTER (in_b AND NOT (in_a AND a = b)) AS to_do,
    count(*) FILTER (in_a AND in_b AND a = b AND status = 'P') AS to_verify FROM {_SNAP}""")
def warm_start(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    reused, todo, verify = incremental.warm_start(old, new, new.filter("status = 'P'"))
    n = lambda x, name: x.agg(F.count("*").alias(name))
    return n(reused, "reused").crossJoin(n(todo, "to_do")).crossJoin(n(verify, "to_verify"))


@query(f"SELECT path FROM {_SNAP} WHERE in_a AND NOT in_b AND status <> 'F'")
def deleted_files(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return incremental.deleted_files(old, new, old.filter("status = 'F'"))


@query(f"SELECT path, CASE WHEN in_b THEN b ELSE a END AS content_hash FROM {_SNAP}")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return incremental.upsert(old, new)[0].select("path", "content_hash")


# --- issues


_ISSUES = """(SELECT event_id AS emit_ord, event_type AS kind, 'E' || (event_id % 7) AS code, CASE WHEN value > 100 THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END AS severity,
    'f' || user_id AS file, (event_id % 40)::INT AS line, (floor(value) % 11)::INT::VARCHAR AS snippet FROM events)"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    severity = F.when(F.col("value") > 100, "error").when(F.col("value") > 50, "warning").otherwise("info")
    return e.select(
        F.col("event_id").alias("emit_ord"), F.col("event_type").alias("kind"), F.concat(F.lit("E"), F.col("event_id") % 7).alias("code"), severity.alias("severity"),
        F.concat(F.lit("f"), "user_id").alias("file"), (F.col("event_id") % 40).cast("int").alias("line"), (F.floor("value") % 11).cast("int").cast("string").alias("snippet"),
    )


@query(f"SELECT severity, count(*) AS n FROM {_ISSUES} GROUP BY severity")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return issues.count_by_severity(_issues(spark, d))


@query(f"""SELECT count(*) AS n_issues, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning,
    count(*) FILTER (severity = 'info') AS n_info, count(DISTINCT file) AS n_files FROM {_ISSUES}""")
def issue_totals(spark: SparkSession, d: str) -> DataFrame:
    return issues.totals(_issues(spark, d))


@query(f"SELECT file, count(*) AS n_issues, count(*) FILTER (severity = 'error') AS n_errors FROM {_ISSUES} GROUP BY file")
def per_file_counts(spark: SparkSession, d: str) -> DataFrame:
    return issues.per_file(_issues(spark, d))


@query(f"SELECT kind, file, line, emit_ord, severity FROM {_ISSUES} QUALIFY row_number() OVER (PARTITION BY kind, file, line ORDER BY emit_ord) = 1")
def issue_dedup(spark: SparkSession, d: str) -> DataFrame:
    return issues.dedup(_issues(spark, d), ["kind", "file", "line"], "emit_ord").select("kind", "file", "line", "emit_ord", "severity")


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def duplicate_declarations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("key"))
    return issues.duplicates(rows, ["key"], ["doc_id"]).drop("key")


_BASE = f"(SELECT file, kind, snippet FROM {_ISSUES} WHERE severity <> 'warning')"


@query(f"""WITH b AS (SELECT file, kind, snippet, count(*) AS n FROM {_BASE} GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY file, kind, snippet ORDER BY emit_ord) AS k FROM {_ISSUES})
    SELECT emit_ord, i.file, i.kind, i.snippet FROM i LEFT JOIN b ON i.file = b.file AND i.kind = b.kind AND i.snippet = b.snippet WHERE k > coalesce(n, 0)""")
def baseline_consume(spark: SparkSession, d: str) -> DataFrame:
    found = _issues(spark, d)
    return issues.baseline_new(found, issues.baseline_create(found.filter("severity <> 'warning'")), ["emit_ord"]).select("emit_ord", "file", "kind", "snippet")


@query(f"""WITH b AS (SELECT file, kind, snippet, count(*) AS n FROM {_BASE} GROUP BY ALL), i AS (SELECT file, kind, snippet, count(*) AS m FROM {_ISSUES} WHERE severity <> 'info' GROUP BY ALL)
    SELECT file, kind, snippet, least(n, m) AS n FROM b JOIN i USING (file, kind, snippet)""")
def baseline_update(spark: SparkSession, d: str) -> DataFrame:
    found = _issues(spark, d)
    return issues.baseline_update(found.filter("severity <> 'info'"), issues.baseline_create(found.filter("severity <> 'warning'")))


_DIRECTIVES = """(SELECT 'f' || (doc_id % 50) AS file, (doc_id % 40)::INT AS line, CASE doc_id % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'next' ELSE 'file' END AS scope,
    CASE WHEN quality = 1 THEN ['CLICK', 'e' || (doc_id % 7)] END AS kinds FROM labels WHERE toxic = 1)"""


def _directives(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").filter("toxic = 1")
    scope = F.when(F.col("doc_id") % 3 == 0, "line").when(F.col("doc_id") % 3 == 1, "next").otherwise("file")
    kinds = F.when(F.col("quality") == 1, F.array(F.lit("CLICK"), F.concat(F.lit("e"), F.col("doc_id") % 7)))
    return rows.select(F.concat(F.lit("f"), F.col("doc_id") % 50).alias("file"), (F.col("doc_id") % 40).cast("int").alias("line"), scope.alias("scope"), kinds.alias("kinds"))


@query(f"""SELECT emit_ord, i.file, i.line, bool_or(coalesce(d.file IS NOT NULL AND (d.kinds IS NULL OR list_contains(list_transform(d.kinds, lambda k: lower(k)), lower(i.kind))
    OR list_contains(list_transform(d.kinds, lambda k: lower(k)), lower(i.code))), false)) AS suppressed FROM {_ISSUES} i LEFT JOIN {_DIRECTIVES} d ON i.file = d.file
    AND (d.scope = 'file' OR i.line = CASE d.scope WHEN 'line' THEN d.line ELSE d.line + 1 END) GROUP BY ALL""")
def inline_suppression(spark: SparkSession, d: str) -> DataFrame:
    return issues.suppress(_issues(spark, d), _directives(spark, d)).select("emit_ord", "file", "line", "suppressed")


@query(f"""SELECT DISTINCT d.file, d.line, name FROM (SELECT file, line, unnest(kinds) AS name FROM {_DIRECTIVES} WHERE scope <> 'file') d
    WHERE NOT EXISTS (SELECT 1 FROM {_ISSUES} i WHERE i.file = d.file AND i.line BETWEEN d.line AND d.line + 1 AND lower(d.name) IN (lower(i.kind), lower(i.code)))""")
def unused_suppression(spark: SparkSession, d: str) -> DataFrame:
    named = _directives(spark, d).filter("scope <> 'file' and kinds is not null").withColumn("covered", F.array(F.col("line"), F.col("line") + 1))
    return issues.unused_suppressions(_issues(spark, d), named)


@query(f"""SELECT emit_ord, severity FROM {_ISSUES} WHERE CASE kind WHEN 'click' THEN 'suppress' WHEN 'view' THEN 'error' ELSE severity END NOT IN ('suppress', 'info')""")
def severity_visibility(spark: SparkSession, d: str) -> DataFrame:
    levels = spark.createDataFrame([("click", "suppress"), ("view", "error")], "kind string, level string")
    return issues.visible(_issues(spark, d), levels).select("emit_ord", "severity")


@query(f"SELECT kind, count(*) AS n FROM {_ISSUES} WHERE kind NOT IN ('click', 'purchase') GROUP BY kind")
def kind_filter(spark: SparkSession, d: str) -> DataFrame:
    return issues.keep_kinds(_issues(spark, d), ["click", "purchase"]).groupBy("kind").agg(F.count("*").alias("n"))


# --- windows and ranges


@query("""SELECT user_id, event_id FROM (SELECT *, lead(event_type IN ('click', 'purchase')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    WHERE event_type IN ('click', 'purchase') AND coalesce(nxt, true)""")
def dead_writes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return flow.dead_writes(e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("click", "purchase")).select("user_id", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, bool_or(value > 150) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM events) WHERE gone""")
def unreachable_statements(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", "value", "ts")
    return flow.unreachable(e, ["user_id"], ["ts", "event_id"], F.col("value") > 150).select("user_id", "event_id")


@query("""SELECT p_partkey, count(*) AS n FROM lineitem JOIN (SELECT p_partkey, p_partkey * 3 AS a, p_partkey * 3 + p_size AS b FROM part) ON l_orderkey >= a AND l_orderkey < b GROUP BY p_partkey""")
def span_lookup(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "lineitem").select("l_orderkey")
    spans = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 3).alias("a"), (F.col("p_partkey") * 3 + F.col("p_size")).alias("b"))
    return references.range_lookup(points, F.col("l_orderkey"), spans, F.col("a"), F.col("b"), 64).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("""SELECT file, off AS offset, arg_min(name, struct_pack(f := fallback, w := e - s, s := s, n := name)) AS name FROM
    (SELECT p_size AS file, p_partkey % 500 AS s, p_partkey % 500 + p_partkey % 37 + 1 AS e, p_name AS name, p_partkey % 3 = 0 AS fallback FROM part) JOIN
    (SELECT DISTINCT p_size AS file, p_partkey % 490 AS off FROM part) USING (file) WHERE s <= off AND off < e GROUP BY file, off""")
def symbol_at_offset(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("file", F.col("p_size"))
    start = F.col("p_partkey") % 500
    spans = p.select("file", start.alias("start"), (start + F.col("p_partkey") % 37 + 1).alias("end"), F.col("p_name").alias("name"), (F.col("p_partkey") % 3 == 0).alias("fallback"))
    return references.symbol_at(spans, p.select("file", (F.col("p_partkey") % 490).alias("offset")).distinct(), 64)


@query("""WITH p(prefix) AS (VALUES ('http://'), ('https://'), ('https://blog.'), ('https://tionsh.example.net/'), ('http://tionsh.example.net/fr/'), ('https://tionsh.example.net/es/'))
    SELECT url, (SELECT arg_max(prefix, length(prefix)) FROM p WHERE starts_with(url, prefix)) AS prefix FROM pages""")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    rules = ["http://", "https://", "https://blog.", "https://tionsh.example.net/", "http://tionsh.example.net/fr/", "https://tionsh.example.net/es/"]
    return references.longest_prefix(read(spark, d, "pages").select("url"), "url", spark.createDataFrame([(r,) for r in rules], "prefix string"), "prefix")


# --- expressions


_SPANS = """(SELECT l_partkey, min(l_quantity)::BIGINT AS lo, max(l_quantity)::BIGINT AS hi, min(l_linenumber)::BIGINT AS lo2, (max(l_linenumber) * 9)::BIGINT AS hi2 FROM lineitem GROUP BY l_partkey)"""


@query(f"""SELECT l_partkey, CASE WHEN greatest(lo, lo2) <= least(hi, hi2) THEN greatest(lo, lo2) END AS meet_lo, CASE WHEN greatest(lo, lo2) <= least(hi, hi2) THEN least(hi, hi2) END AS meet_hi,
    least(lo, lo2) AS hull_lo, greatest(hi, hi2) AS hull_hi, hi < lo2 OR hi2 < lo AS apart, lo <= lo2 AND hi >= hi2 AS inside, lo - hi2 AS minus_lo, hi * hi2 AS times_hi,
    CASE WHEN lo <= 20 THEN least(hi, 20) END AS below_hi FROM {_SPANS}""")
def interval_algebra(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").groupBy("l_partkey").agg(
        iv.interval(F.min("l_quantity").cast("long"), F.max("l_quantity").cast("long")).alias("a"), iv.interval(F.min("l_linenumber").cast("long"), (F.max("l_linenumber") * 9).cast("long")).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return x.select(
        "l_partkey", iv.intersect(a, b)["lo"].alias("meet_lo"), iv.intersect(a, b)["hi"].alias("meet_hi"), iv.hull(a, b)["lo"].alias("hull_lo"), iv.hull(a, b)["hi"].alias("hull_hi"),
        iv.disjoint(a, b).alias("apart"), iv.contains(a, b).alias("inside"), iv.subtract(a, b)["lo"].alias("minus_lo"), iv.multiply(a, b)["hi"].alias("times_hi"), iv.narrow(a, "<=", F.lit(20).cast("long"))["hi"].alias("below_hi"),
    )


@query("""WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (value > 60)) AS a, list_sort(list(DISTINCT event_type) FILTER (value <= 60)) AS b FROM events GROUP BY user_id)
    SELECT user_id, list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS either, list_sort(list_intersect(coalesce(a, []), coalesce(b, []))) AS both_,
    list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS only_a, list_has_all(coalesce(b, []), coalesce(a, [])) AS a_in_b FROM s""")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") <= 60, F.col("event_type"))).alias("b"))
    return s.select(
        "user_id", F.array_sort(F.array_union("a", "b")).alias("either"), F.array_sort(F.array_intersect("a", "b")).alias("both_"), F.array_sort(F.array_except("a", "b")).alias("only_a"),
        F.forall("a", lambda x: F.array_contains("b", x)).alias("a_in_b"),
    )


@query("""SELECT p_partkey, (since IS NULL OR since // 100 NOT BETWEEN 4 AND 9 OR since <= v) AND (removed IS NULL OR removed // 100 NOT BETWEEN 4 AND 9 OR v < removed) AS included FROM
    (SELECT p_partkey, 700 + p_size % 5 AS v, CASE WHEN p_partkey % 3 > 0 THEN 500 + p_partkey % 1700 END AS since, CASE WHEN p_partkey % 4 > 0 THEN 600 + p_partkey % 700 END AS removed FROM part)""")
def version_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    v, since, removed = 700 + F.col("p_size") % 5, F.when(k % 3 > 0, 500 + k % 1700), F.when(k % 4 > 0, 600 + k % 700)
    return read(spark, d, "part").select("p_partkey", keys.version_in_range(v, since, removed).alias("included"))


@query("""SELECT doc_id, len(string_split(left(text, pos), chr(10))) AS line, length(string_split(left(text, pos), chr(10))[-1]) AS col FROM
    (SELECT doc_id, text, ((doc_id * 7919) % (length(text) + 1))::INT AS pos FROM documents)""")
def line_and_column(spark: SparkSession, d: str) -> DataFrame:
    """Places over the whole of every text."""
    at = ((F.col("doc_id") * 7919) % (F.length("text") + 1)).cast("int")
    return read(spark, d, "documents").select("doc_id", keys.line_of("text", at).alias("line"), keys.column_of("text", at).alias("col"))


@query("""SELECT o_orderkey, CASE WHEN regexp_full_match(v, '0|-?[1-9][0-9]*') THEN v END AS as_int, regexp_full_match(v, '[ \\t\\n\\r\\x0B\\f]*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?[ \\t\\n\\r\\x0B\\f]*') AS numeric FROM
    (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN '0' || o_custkey WHEN 2 THEN '-' || o_custkey WHEN 3 THEN o_custkey || '.5' WHEN 4 THEN ' ' || o_custkey || 'e3 ' WHEN 5 THEN o_orderstatus ELSE '' END AS v FROM orders)""")
def array_keys(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    c, r = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 7
    v = F.when(r == 0, c).when(r == 1, F.concat(F.lit("0"), c)).when(r == 2, F.concat(F.lit("-"), c)).when(r == 3, F.concat(c, F.lit(".5"))).when(r == 4, F.concat(F.lit(" "), c, F.lit("e3 "))).when(r == 5, F.col("o_orderstatus")).otherwise("")
    return o.select("o_orderkey", v.alias("v")).select("o_orderkey", keys.array_key("v").alias("as_int"), keys.is_numeric_string("v").alias("numeric"))


# --- names, arguments, members


_NAMES = r"""(SELECT p_partkey, p_brand AS file, CASE WHEN p_size > 40 THEN '\' ELSE '' END || replace(p_name, ' ', '\') AS name, CASE WHEN p_size % 2 = 0 THEN 'App' ELSE '' END AS namespace FROM part)"""
_IMPORTS = r"""(SELECT p_brand AS file, upper(left(p_name, 1)) || split_part(p_name, ' ', 1)[2:] AS alias, 'Lib\' || split_part(p_name, ' ', 1) AS fqcn FROM part WHERE p_size < 5)"""


@query(rf"""WITH n AS (SELECT *, ltrim(name, '\') AS bare, split_part(ltrim(name, '\'), '\', 1) AS top FROM {_NAMES}),
    x AS (SELECT file, alias AS top, min(fqcn) AS exact FROM {_IMPORTS} GROUP BY ALL), l AS (SELECT file, lower(alias) AS low, min(fqcn) AS loose FROM {_IMPORTS} GROUP BY ALL),
    k AS (SELECT DISTINCT lower(replace(p_name, ' ', '\')) AS key FROM part WHERE p_type LIKE 'STANDARD%')
    SELECT n.file, name, namespace, CASE WHEN starts_with(name, '\') THEN bare WHEN exact IS NOT NULL THEN exact || substr(bare, length(n.top) + 1) WHEN loose IS NOT NULL THEN loose || substr(bare, length(n.top) + 1)
    WHEN contains(bare, '\') AND key IS NOT NULL THEN bare WHEN namespace = '' THEN bare ELSE namespace || '\' || bare END AS resolved
    FROM n LEFT JOIN x ON n.file = x.file AND n.top = x.top LEFT JOIN l ON n.file = l.file AND lower(n.top) = l.low LEFT JOIN k ON lower(bare) = key""")
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Part names as qualified names, brands as files, small parts as imports."""
    p = read(spark, d, "part")
    qualified = F.replace("p_name", F.lit(" "), F.lit("\\"))
    names = p.select(F.col("p_brand").alias("file"), F.concat(F.when(F.col("p_size") > 40, "\\").otherwise(""), qualified).alias("name"), F.when(F.col("p_size") % 2 == 0, "App").otherwise("").alias("namespace"))
    first = F.substring_index("p_name", " ", 1)
    alias = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, F.lit(2), F.length(first)))
    imports = p.filter("p_size < 5").select(F.col("p_brand").alias("file"), alias.alias("alias"), F.concat(F.lit("Lib\\"), first).alias("fqcn"))
    return references.resolve_names(names, imports, p.filter("p_type like 'STANDARD%'").select(keys.fold(qualified).alias("key")))


@query("""WITH p AS (SELECT l_returnflag AS callee, l_linenumber AS pos, 'p' || l_linenumber AS name, l_linenumber = 4 AS rest FROM lineitem WHERE l_linenumber <= CASE l_returnflag WHEN 'A' THEN 4 ELSE 3 END GROUP BY ALL)
    SELECT a.l_orderkey AS call_id, a.l_returnflag AS callee, a.l_linenumber AS pos, a.name, coalesce(q.name, p.name, v.name) AS param FROM
    (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'p' || (1 + l_suppkey % 5) END AS name FROM lineitem) a LEFT JOIN p q ON q.callee = l_returnflag AND q.name = a.name
    LEFT JOIN p ON a.name IS NULL AND p.callee = l_returnflag AND p.pos = l_linenumber LEFT JOIN p v ON v.callee = l_returnflag AND v.rest AND q.name IS NULL AND (a.name IS NOT NULL OR l_linenumber >= 4)""")
def argument_binding(spark: SparkSession, d: str) -> DataFrame:
    """Line items as arguments: some by name, the fourth parameter of one callee takes the rest."""
    li = read(spark, d, "lineitem")
    params = li.filter("l_linenumber <= case l_returnflag when 'A' then 4 else 3 end").select(F.col("l_returnflag").alias("callee"), F.col("l_linenumber").alias("pos")).distinct()
    params = params.select("callee", "pos", F.concat(F.lit("p"), "pos").alias("name"), (F.col("pos") == 4).alias("is_variadic"))
    name = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("p"), 1 + F.col("l_suppkey") % 5))
    args = li.select(F.col("l_orderkey").alias("call_id"), F.col("l_returnflag").alias("callee"), F.col("l_linenumber").alias("pos"), name.alias("name"))
    return references.bind_arguments(args, params)


def _chain(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    me = F.concat(F.lit("c"), "c_custkey").alias("class")
    return c.select(me, me.alias("ancestor"), F.lit(0).alias("rank")).unionByName(c.select(me, F.concat(F.lit("n"), "c_nationkey").alias("ancestor"), F.lit(1).alias("rank")))


@query("""SELECT 'c' || c_custkey AS class, 'n' || c_nationkey AS owner, s AS name FROM customer, (SELECT DISTINCT s_nationkey, 'm' || s_suppkey % 4 AS s FROM supplier WHERE s_acctbal > 5000)
    WHERE s_nationkey = c_nationkey AND c_mktsegment <> 'BUILDING' AND NOT (c_acctbal > 5000 AND s = 'm' || c_custkey % 4)""")
def obligations(spark: SparkSession, d: str) -> DataFrame:
    """What rich suppliers of a nation demand of its customers, and customers do not provide."""
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    required = s.filter("s_acctbal > 5000").select(F.concat(F.lit("n"), "s_nationkey").alias("owner"), F.concat(F.lit("m"), F.col("s_suppkey") % 4).alias("name")).distinct()
    provided = c.filter("c_acctbal > 5000").select(F.concat(F.lit("c"), "c_custkey").alias("owner"), F.concat(F.lit("m"), F.col("c_custkey") % 4).alias("name"))
    return hierarchy.obligations(_chain(spark, d), required, provided, c.filter("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("class")))


@query("""WITH m AS (SELECT 'c' || c_custkey AS class, 'n' || c_nationkey AS owner, 'limit' AS name, c_custkey % 3 AS vis, c_custkey % 2 = 0 AS st, c_acctbal < 0 AS ab, n_nationkey % 2 AS up_vis, n_nationkey % 3 = 0 AS up_st, n_regionkey = 1 AS fin
    FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT class, name, owner, unnest(list_filter([CASE WHEN fin THEN 'final overridden' END, CASE WHEN vis > up_vis THEN 'visibility reduced' END,
    CASE WHEN st <> up_st THEN 'static mismatch' END, CASE WHEN ab THEN 'abstract over concrete' END], lambda x: x IS NOT NULL)) AS rule FROM m""")
def override_check(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    name = F.lit("limit").alias("name")
    own = c.select(F.concat(F.lit("c"), "c_custkey").alias("owner"), name, (F.col("c_custkey") % 3).alias("visibility"), (F.col("c_custkey") % 2 == 0).alias("is_static"), F.lit(False).alias("is_final"), (F.col("c_acctbal") < 0).alias("is_abstract"))
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("owner"), name, (F.col("n_nationkey") % 2).cast("long").alias("visibility"), (F.col("n_nationkey") % 3 == 0).alias("is_static"), (F.col("n_regionkey") == 1).alias("is_final"), F.lit(False).alias("is_abstract"))
    return hierarchy.overrides(_chain(spark, d), own.unionByName(up))


# --- types, value functions, reports


@query("""SELECT p_partkey, CASE WHEN nested THEN r ELSE 'never' END AS met, CASE WHEN nested THEN 'int<0,40>|string' ELSE r || '|int<0,40>|string' END AS joined, nested AS is_subset,
    CASE WHEN lo <= 0 THEN r || '|true' ELSE r || '|true' END AS yes, CASE WHEN lo <= 0 AND hi >= 0 THEN '0|false|null' ELSE 'false|null' END AS no, r AS ints FROM
    (SELECT *, 'int<' || lo || ',' || hi || '>' AS r, lo >= 0 AND hi <= 40 AS nested FROM (SELECT p_partkey, (p_size - 5)::BIGINT AS lo, (p_size + 5)::BIGINT AS hi FROM part))""")
def type_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Sets of atoms from part sizes: intersection, union, subset, truthy and falsy narrowing, family narrowing."""
    from factweave.functions import types as t

    none = F.lit(None).cast("string")
    size = F.col("p_size").cast("long")
    span = F.struct(F.lit("int").alias("tag"), none.alias("lit_str"), (size - 5).alias("lo"), (size + 5).alias("hi"), none.alias("ref_class"))
    a = read(spark, d, "part").select("p_partkey", F.array(span).alias("a"), F.array(span, t.atom("bool"), t.atom("null")).alias("c"), F.array(t.atom("int", lo=0, hi=40), t.atom("string")).alias("b"))
    A, B, C = F.col("a"), F.col("b"), F.col("c")  # noqa: N806
    return a.select(
        "p_partkey", t.display(t.intersect(A, B)).alias("met"), t.display(t.union(A, B)).alias("joined"), t.subset(A, B).alias("is_subset"), t.display(t.truthy(C)).alias("yes"),
        t.display(t.falsy(C)).alias("no"), t.display(t.narrow(C, "int")).alias("ints"),
    )


@query("""SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS f1, lower(p_brand) AS f2, array_to_string(list_reverse(string_split(p_name, ' ')), '-') AS f3,
    replace(replace('<' || p_name || '>', '<', '&lt;'), '>', '&gt;') AS f4, left(p_name, 2) || 'XX' || substr(p_name, 6) AS f5, CASE WHEN contains(p_name, 'a') THEN instr(p_name, 'a') - 1 ELSE -1 END AS f6,
    md5(p_name) AS f7, base64(encode(p_name)) AS f8, rpad(p_type, greatest(30, length(p_type))::INT, '.') AS f9, repeat(p_brand, 2) AS f10, regexp_matches(p_name, '^[a-m]')::INT AS f11, reverse(p_name) AS f12,
    regexp_replace(p_name, '[aeiou]', '*', 'g') AS f13, replace(p_name, ' ', '%20') AS f14, lower(hex(encode(p_brand))) AS f15, starts_with(p_type, 'PROMO') AS f16, octet_length(encode(p_name)) AS f17 FROM part""")
def builtins_text(spark: SparkSession, d: str) -> DataFrame:
    from factweave.functions.builtins import BUILTINS as B  # noqa: N817

    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    made = (
        B["ucfirst"](n), B["strtolower"](b), B["implode"]("-", B["array_reverse"](B["explode"](" ", n))), B["htmlspecialchars"](F.concat(F.lit("<"), n, F.lit(">"))), B["substr_replace"](n, "XX", 2, 3), F.coalesce(B["strpos"](n, "a"), F.lit(-1)),
        B["md5"](n), B["base64_encode"](n), B["str_pad"](t, 30, "."), B["str_repeat"](b, 2), B["preg_match"]("^[a-m]", n), B["strrev"](n), B["preg_replace"]("[aeiou]", "*", n), B["rawurlencode"](n), B["bin2hex"](b),
        B["str_starts_with"](t, "PROMO"), B["strlen"](n),
    )
    return read(spark, d, "part").select("p_partkey", *[c.alias(f"f{i}") for i, c in enumerate(made, 1)])


@query("""WITH s AS (SELECT user_id, list(event_id ORDER BY event_id) AS a, list(DISTINCT event_type ORDER BY event_type) AS t FROM events GROUP BY user_id)
    SELECT user_id, len(a) AS f1, list_sum(list_transform(a, lambda x: x * 2))::DOUBLE AS f2, list_filter(a, lambda x: x > 100) AS f3, a[2:4] AS f4, a[-1] AS f5, list_reverse(a)[1] AS f6, list_max(a) AS f7,
    list_position(a, a[1]) - 1 AS f8, len(a) // 3 + CASE WHEN len(a) % 3 > 0 THEN 1 ELSE 0 END AS f9, list_sort(list_distinct(list_concat(t, ['x']))) AS f10, a[len(a) - 1:] AS f11 FROM s""")
def builtins_arrays(spark: SparkSession, d: str) -> DataFrame:
    from factweave.functions.builtins import BUILTINS as B  # noqa: N817

    s = read(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("a"), F.sort_array(F.collect_set("event_type")).alias("t"))
    a, t = F.col("a"), F.col("t")
    made = (
        B["count"](a), B["array_sum"](B["array_map"](lambda x: x * 2, a)), B["array_filter"](a, lambda x: x > 100), B["array_slice"](a, 1, 3), B["end"](a), B["reset"](B["array_reverse"](a)), B["max"](a),
        B["array_search"](B["reset"](a), a), B["count"](B["array_chunk"](a, 3)), B["sort"](B["array_unique"](B["array_merge"](t, F.array(F.lit("x"))))), B["array_slice"](a, -2),
    )
    return s.select("user_id", *[c.alias(f"f{i}") for i, c in enumerate(made, 1)])


@query("""SELECT l_orderkey, l_linenumber, abs(l_tax - l_discount) AS f1, floor(l_extendedprice)::BIGINT AS f2, ceil(l_extendedprice)::BIGINT AS f3, l_partkey // l_linenumber AS f4, least(l_tax, l_discount) AS f5,
    greatest(l_tax, l_discount) AS f6, sqrt(l_quantity) AS f7, strftime(l_shipdate, '%Y-%m-%d %H') AS f8, fmod(l_extendedprice, 7) AS f9 FROM lineitem""")
def builtins_numbers(spark: SparkSession, d: str) -> DataFrame:
    from factweave.functions.builtins import BUILTINS as B  # noqa: N817

    t, x, p = F.col("l_tax"), F.col("l_discount"), F.col("l_extendedprice")
    made = (B["abs"](t - x), B["floor"](p), B["ceil"](p), B["intdiv"](F.col("l_partkey"), F.col("l_linenumber")), B["min"](t, x), B["max"](t, x), B["sqrt"](F.col("l_quantity")), B["date"]("Y-m-d H", F.col("l_shipdate")), B["fmod"](p, 7))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(f"f{i}") for i, c in enumerate(made, 1)])


@query(f"""SELECT emit_ord, format('{{:016x}}', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(kind || ':' || snippet, ''), lambda c: ord(c)::UHUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS fingerprint FROM {_ISSUES}""")
def issue_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    from factweave.sources.sinks import fingerprint

    found = _issues(spark, d)
    return found.select("emit_ord", fingerprint(found).alias("fingerprint"))


@query(f"""SELECT '::' || CASE severity WHEN 'info' THEN 'notice' ELSE severity END || ' file=' || file || ',line=' || line || ',col=1::' || kind || ': ' || code AS value FROM {_ISSUES}""")
def report_annotations(spark: SparkSession, d: str) -> DataFrame:
    from factweave.sources.sinks import ci_lines

    return ci_lines(_issues(spark, d).withColumn("col_start", F.lit(0)).withColumn("message", F.col("code")))


@query(f"""SELECT file, '<file src="' || file || '">' || string_agg('<' || kind || '>' || codes || '</' || kind || '>', '' ORDER BY kind) || '</file>' AS value FROM
    (SELECT file, kind, string_agg('<code>' || snippet || '</code>', '' ORDER BY '<code>' || snippet || '</code>') AS codes FROM {_ISSUES} GROUP BY ALL) GROUP BY file""")
def report_baseline(spark: SparkSession, d: str) -> DataFrame:
    from factweave.sources.sinks import baseline_xml

    return baseline_xml(_issues(spark, d))


#: Symbols that the generated program uses and does not declare.
_STUBS = """<?php
function is_array(mixed $value): bool {}
/** @since 7.3 */ function array_key_last(array $array): mixed {}
/** @removed 8.0 */ function each(array &$array): array {}
/** @since 9.1 */ function later(): void {}
class DOMDocument { public function load(string $path, int $options = 0): bool {} }
"""


def _program(spark: SparkSession, d: str) -> DataFrame:
    """A class a part, with a parent in every ten, and calls of what exists or not."""
    k = F.col("p_partkey")
    parent = k - k % 10
    head = F.when(k % 10 != 0, F.format_string("class C%d extends C%d", k, parent)).otherwise(F.concat(F.when(k % 20 == 0, "final ").otherwise(""), F.format_string("class C%d", k)))
    body = F.format_string(
        "private function idle(): void {} public function run(array $x): void { if (is_array($x)) { helper%d(); } new Gone%d(); each($x); $y = 1; (new DOMDocument())->load('a'); array_key_last(); self::go(); self::GO; }", k % 5, k
    )
    files = read(spark, d, "part").select(F.format_string("p%d.php", k).alias("path"), F.concat(F.lit("<?php\n"), head, F.lit(" {\n"), body, F.lit(" }\n"), F.replace(F.lit(_MORE), F.lit("#"), k.cast("string"))).alias("text"))
    return files.unionByName(spark.createDataFrame([("helpers.php", "<?php\nfunction helper0(): void {}\nfunction helper1(): void {}\nfunction helper2(): void {}\n")], "path string, text string"))


#: Lines 4 to 14 of a part's file; # is its key.
_MORE = """enum E#: int { case A = 'x'; }
class U# { use E#; public function __toString(): int { return 1; } }
class S# { public function m(): void {} public static function s(): void { self::m(); } }
function g#(): array { return ['a' => 1, 'a' => 2]; echo 1; }
echo (function () { return 1; })();
abstract class Q# { abstract public function r(): void; } new Q#();
interface F# { public function need(): void; } class G# implements F# {}
class V# { private int $b = 1; }
class W# { private const P = 1; } echo W#::P;
function d#(int $p): void {}
d#(1, 2);
"""
_RULES = ("BackedEnumCaseTypeMismatch", "InvalidTraitUse", "InvalidToString", "NonStaticSelfCall", "DuplicateArrayKey", "UnreachableCode", "MissingClosureReturnType", "AbstractInstantiation",
    "UnimplementedInterfaceMethod", "UnusedProperty", "InaccessibleClassConstant", "UnusedParam", "TooManyArguments", "UndefinedClass", "UndefinedFunction", "UndefinedMethod", "UndefinedConstant", "UnusedMethod", "UnusedVariable", "InvalidExtendClass", "TooFewArguments", "UnusedFunction")


@query("""WITH p AS (SELECT p_partkey AS k, 'p' || p_partkey || '.php' AS file, p_partkey - p_partkey % 10 AS parent FROM part),
    c AS (SELECT p.*, q.k IS NOT NULL OR p.k % 10 = 0 AS closed FROM p LEFT JOIN p AS q ON p.parent = q.k)
    SELECT 'UndefinedClass' AS kind, file, 3 AS line, 'Class Gone' || k || ' does not exist' AS message FROM c
    UNION ALL SELECT 'UndefinedClass', file, 2, 'Class C' || parent || ' does not exist' FROM c WHERE NOT closed
    UNION ALL SELECT 'UndefinedFunction', file, 3, 'Function each() is not defined' FROM c
    UNION ALL SELECT 'UndefinedFunction', file, 3, 'Function helper' || k % 5 || '() is not defined' FROM c WHERE k % 5 > 2
    UNION ALL SELECT 'UndefinedMethod', file, 3, 'Method C' || k || '::go() does not exist' FROM c WHERE closed
    UNION ALL SELECT 'UndefinedConstant', file, 3, 'Constant C' || k || '::GO is not defined' FROM c WHERE closed
    UNION ALL SELECT 'UnusedMethod', file, 3, 'Private method C' || k || '::idle() is never called' FROM c
    UNION ALL SELECT 'UnusedVariable', file, 3, 'Variable $y is never read' FROM c
    UNION ALL SELECT 'TooFewArguments', file, 3, 'Too few arguments for array_key_last(): expected 1, got 0' FROM c
    UNION ALL SELECT 'InvalidExtendClass', file, 2, 'Class C' || k || ' cannot extend final class C' || parent FROM c WHERE k % 10 > 0 AND closed AND parent % 20 = 0
    UNION ALL SELECT unnest(['BackedEnumCaseTypeMismatch', 'InvalidTraitUse', 'InvalidToString', 'NonStaticSelfCall', 'DuplicateArrayKey', 'UnreachableCode', 'UnusedFunction', 'MissingClosureReturnType', 'AbstractInstantiation',
        'UnimplementedInterfaceMethod', 'UnusedProperty', 'InaccessibleClassConstant', 'UnusedParam', 'TooManyArguments']), file, unnest([4, 5, 5, 6, 7, 7, 7, 8, 9, 10, 11, 12, 13, 14]), replace(unnest([
        'Backed enum case E#::A has value of type "x", but backing type is int', 'Trait E# used incorrectly: E# is an enum, not a trait', 'Method U#::__toString() must return a string',
        'Non-static method S#::m() cannot be called statically', 'Array key ''a'' is duplicated — the earlier entry is silently overwritten', 'Unreachable code detected', 'Function g#() is never called',
        'Closure has no return type annotation', 'Cannot instantiate abstract class Q#', 'Class G# must implement F#::need() from interface', 'Private property V#::$b is never read', 'Cannot access constant W#::P',
        'Parameter $p is never used', 'Too many arguments for d#(): expected 1, got 2']), '#', k::VARCHAR) FROM c""")
def rules_over_program(spark: SparkSession, d: str) -> DataFrame:
    """Extraction, stubs and rules over a program with a class a part."""
    from factweave.operators.rules import analyse

    stubs = spark.createDataFrame([("core.php", _STUBS)], "path string, text string")
    files = _program(spark, d).repartition(spark.sparkContext.defaultParallelism)  # one row group holds all parts
    return analyse(files, only=_RULES, stubs=stubs).select("kind", "file", "line", "message")


@query("""SELECT fqcn, file, line, row_number() OVER (PARTITION BY file ORDER BY line, fqcn) - 1 AS place FROM
    (SELECT p_brand AS fqcn, p_type AS file, min(coalesce(CASE WHEN p_size > 5 THEN p_size END, 0))::INT AS line FROM part GROUP BY ALL)""")
def subtype_ordering(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("p_size") > 5, F.col("p_size")).cast("int")
    return hierarchy.ordered_subtypes(read(spark, d, "part").select(F.col("p_brand").alias("fqcn"), F.col("p_type").alias("file"), line.alias("line")))


@query("""SELECT c_custkey, n_regionkey = 1 AND (c_custkey % 3 > 0 OR c_custkey % 2 = 0) OR c_custkey % 11 = 0 AS subset FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def subset_with_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Customers as classes, some nullable and some traits, against a region, nullable or not."""
    from factweave.functions import types

    k, named = F.col("c_custkey"), types.atom("named-object")
    own = named.withField("ref_class", F.concat(F.lit("C"), k))
    null = F.array(types.atom("null"))
    rows = read(spark, d, "customer").select("c_custkey", F.when((k % 3 == 0) & (k % 11 != 0), F.concat(F.array(own), null)).otherwise(F.array(own)).alias("sub"), F.when(k % 2 == 0, F.concat(null, F.array(types.atom("named-object", ref_class="R1")))).otherwise(F.array(types.atom("named-object", ref_class="R1"))).alias("sup"))
    traits = rows.filter(k % 11 == 0).select(F.concat(F.lit("c"), "c_custkey").alias("fqcn"))
    return hierarchy.subset_in_hierarchy(rows, "c_custkey", "sub", "sup", hierarchy.ancestors(_tree(spark, d)), traits)


@query("""SELECT 'c' || c_custkey AS class, ['n' || n_nationkey] AS parents, ['r' || n_regionkey] AS interfaces, CASE WHEN c_custkey % 4 = 0 THEN ['t' || c_custkey % 9] ELSE [] END AS traits FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 's' || s_suppkey, ['n' || n_nationkey], ['r' || n_regionkey], [] FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, [], ['r' || n_regionkey], [] FROM nation""")
def class_relations(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d).withColumn("relation", F.when(F.startswith("parent", F.lit("r")), "interface").otherwise("parent"))
    used = read(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("t"), F.col("c_custkey") % 9).alias("parent"), F.lit("trait").alias("relation"))
    return hierarchy.class_relations(tree.unionByName(used))


@query(f"SELECT count(DISTINCT token) AS names, count(DISTINCT doc) AS files, count(*)::BIGINT AS mentions FROM {_TOKENS}")
def mention_statistics(spark: SparkSession, d: str) -> DataFrame:
    return index.mention_statistics(index.posting_list(read(spark, d, "documents"), "doc_id", keys.identifier_tokens("text")))


@query("""SELECT l_partkey, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_shipdate) - 1 AS place FROM (SELECT DISTINCT l_partkey, l_suppkey, l_shipdate FROM lineitem)""")
def reference_ordering(spark: SparkSession, d: str) -> DataFrame:
    return index.ordered_references(read(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_shipdate")


@query("""SELECT flags, count(*) AS owners FROM (SELECT string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS flags FROM lineitem GROUP BY l_orderkey) GROUP BY flags""")
def parameter_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = index.interned_lists(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")[1]
    return lists.select(F.array_join(F.transform("params", lambda p: F.concat(p["l_returnflag"], p["l_linestatus"])), ",").alias("flags"), "owners")


@query("SELECT l_partkey, max(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey ORDER BY l_orderkey DESC, l_partkey LIMIT 256")
def cache_retention(spark: SparkSession, d: str) -> DataFrame:
    """What a cache of 256 entries holds after all uses."""
    return index.most_recent(read(spark, d, "lineitem"), "l_partkey", "l_orderkey", 256)


@query("""SELECT count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type NOT IN ('click', 'purchase') OR event_type IS NULL) AS others FROM events""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return index.run_counters(read(spark, d, "events"), "event_type", "click", "purchase")


_PLACED = f"(SELECT *, (emit_ord % 9)::INT AS col_start, kind || ' <' || code || '>' AS message FROM {_ISSUES})"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    found = _issues(spark, d).withColumn("col_start", (F.col("emit_ord") % 9).cast("int")).withColumn("message", F.format_string("%s <%s>", "kind", "code"))
    return found.withColumn("line_end", F.col("line") + 1).withColumn("col_end", F.col("col_start") + 4)


@query(f"SELECT file || ':' || line || ':' || col_start || ' ' || severity || '[' || code || '] ' || kind || ': ' || message AS value FROM {_PLACED}")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    from factweave.sources.sinks import text_lines

    return text_lines(_placed(spark, d))


@query(f"""WITH i AS (SELECT *, CASE severity WHEN 'error' THEN 'failure' WHEN 'warning' THEN 'warning' ELSE 'notice' END AS e, kind || ' &lt;' || code || '&gt;' AS m FROM {_PLACED}),
    c AS (SELECT *, '    <testcase name="' || kind || '" classname="' || file || '">' || chr(10) || '      <' || e || ' message="' || m || '" type="' || kind || '">' || file || ':' || line || ':' || col_start || ' ' || severity
        || ' ' || kind || ': ' || m || '</' || e || '>' || chr(10) || '    </testcase>' || chr(10) AS x FROM i)
    SELECT file, '  <testsuite name="' || file || '" tests="' || count(*) || '" failures="' || (count(*) FILTER (WHERE severity = 'error')) || '">' || chr(10)
        || string_agg(x, '' ORDER BY line, col_start, kind, x) || '  </testsuite>' || chr(10) AS value FROM c GROUP BY file""")
def report_junit(spark: SparkSession, d: str) -> DataFrame:
    from factweave.sources.sinks import junit_suites

    return junit_suites(_placed(spark, d))


@query(f"""SELECT emit_ord, kind AS rule, CASE severity WHEN 'info' THEN 'note' ELSE severity END AS level, CASE severity WHEN 'error' THEN 90.0 WHEN 'warning' THEN 95.0 ELSE 99.0 END::DOUBLE AS rank,
    message AS text, file AS uri, '%SRCROOT%' AS base, line AS start_line, line + 1 AS end_line, col_start + 1 AS start_column, col_start + 5 AS end_column FROM {_PLACED}""")
def report_sarif(spark: SparkSession, d: str) -> DataFrame:
    """SARIF results taken apart again."""
    from factweave.sources.sinks import sarif_results

    rows = _placed(spark, d).withColumn("file", F.concat_ws("#", "file", "emit_ord"))
    at = "$.locations[0].physicalLocation"
    paths = {"rule": "$.ruleId", "level": "$.level", "rank": "$.rank", "text": "$.message.text", "uri": f"{at}.artifactLocation.uri", "base": f"{at}.artifactLocation.uriBaseId", "start_line": f"{at}.region.startLine", "end_line": f"{at}.region.endLine", "start_column": f"{at}.region.startColumn", "end_column": f"{at}.region.endColumn"}
    kinds = {"rank": "double", "start_line": "int", "end_line": "int", "start_column": "int", "end_column": "int"}
    out = sarif_results(rows).select(*[F.get_json_object("value", p).cast(kinds.get(name, "string")).alias(name) for name, p in paths.items()])
    return out.withColumn("emit_ord", F.split_part("uri", F.lit("#"), F.lit(2)).cast("long")).withColumn("uri", F.split_part("uri", F.lit("#"), F.lit(1)))


@query("SELECT user_id::VARCHAR AS path, sha256(arg_max(event_type || event_id, event_id)) AS content_hash FROM events GROUP BY user_id")
def edit_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of edits to users; what the table holds when the stream is used up."""
    import uuid

    from factweave.plans.closure import cut
    from factweave.streaming.edits import VersionedTable, maintain

    schema = read(spark, d, "events").schema
    cut(spark.range(1))  # names a checkpoint folder where none is set
    home = f"{spark.sparkContext.getCheckpointDir()}/edits-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    edits = rows.select(F.col("user_id").cast("string").alias("path"), F.sha2(F.concat("event_type", "event_id"), 256).alias("content_hash"), F.col("event_id").alias("ord"))
    table = VersionedTable(spark, f"{home}/table", "path string, content_hash string")
    maintain(edits, table, f"{home}/log").awaitTermination()
    return table.read()


# --- single symbols and the flow kernel


@query("""SELECT o_orderkey, o_custkey AS key, CASE WHEN c_acctbal >= 0 THEN c_name END AS place,
    CASE WHEN c_custkey IS NULL THEN 'not found' WHEN c_acctbal >= 0 THEN 'found' ELSE 'no source location' END AS status
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') ON o_custkey = c_custkey""")
def definition_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Where each ordering customer is defined; indebted customers have no place, one segment is unknown."""
    from factweave.operators import lookup

    index_ = read(spark, d, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("place"))
    return lookup.definition(read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), index_, "key", "place")


@query(f"""WITH RECURSIVE e AS {_TREE}, r AS (SELECT child, parent AS ancestor FROM e UNION ALL SELECT r.child, e.parent FROM r JOIN e ON r.ancestor = e.child), c AS (SELECT 'n' || n_nationkey AS class FROM nation)
    SELECT class, class AS member_of FROM c UNION SELECT class, ancestor FROM c JOIN r ON child = class UNION SELECT class, child FROM c JOIN r ON ancestor = class""")
def member_family(spark: SparkSession, d: str) -> DataFrame:
    from factweave.operators import lookup

    return lookup.member_family(read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("class")), hierarchy.ancestors(_tree(spark, d)))


@query("SELECT l_suppkey, string_agg(DISTINCT '''' || l_returnflag || l_linestatus || '''', '|' ORDER BY '''' || l_returnflag || l_linestatus || '''') AS returned FROM lineitem GROUP BY l_suppkey")
def inferred_return_types(spark: SparkSession, d: str) -> DataFrame:
    from factweave.functions import types as t
    from factweave.operators import lookup

    none = F.lit(None)
    atom = F.struct(F.lit("literal-string").alias("tag"), F.concat("l_returnflag", "l_linestatus").alias("lit_str"), none.cast("bigint").alias("lo"), none.cast("bigint").alias("hi"), none.cast("string").alias("ref_class"))
    found = lookup.inferred_types(read(spark, d, "lineitem").select("l_suppkey", F.array(atom).alias("types")), "l_suppkey")
    return found.select("l_suppkey", t.display(F.col("types")).alias("returned"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'click' AS w, coalesce(bool_or(event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known,
    lead(event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events)
    SELECT 'u' || user_id AS scope, event_id AS pos, CASE WHEN w THEN 'UnusedVariable' ELSE 'UndefinedVariable' END AS kind FROM e WHERE (w AND coalesce(nxt, true)) OR (NOT w AND NOT known)""")
def flow_kernel(spark: SparkSession, d: str) -> DataFrame:
    """Users as scopes of straight-line code: clicks write a variable, other events read it."""
    from factweave.operators.kernel import analyse_scopes

    e = read(spark, d, "events")
    op = F.when(F.col("event_type") == "click", "assign").otherwise("read")
    rows = e.select(F.lit("f").alias("file"), F.concat(F.lit("u"), "user_id").alias("scope"), F.col("event_id").alias("pos"), op.alias("op"), F.lit("x").alias("var"), F.array(F.lit("int")).alias("types"))
    return analyse_scopes(rows).filter("kind <> 'env'").select("scope", "pos", "kind")


@query("""SELECT p_partkey, replace(p_brand, '#', '') || '|null' AS put, CASE WHEN p_size <= 10 THEN 'true' WHEN p_size > 40 THEN 'false' ELSE 'true|false' END AS chosen, p_size > 25 AS broken FROM part""")
def template_types(spark: SparkSession, d: str) -> DataFrame:
    """A template bound to a class from the part's brand, a conditional type decided by its size, and a bound on the size."""
    from factweave.functions import types as t

    none = F.lit(None)
    text, number = none.cast("string"), none.cast("bigint")
    size = F.col("p_size").cast("bigint")
    span = lambda lo, hi: F.array(F.struct(F.lit("int").alias("tag"), text.alias("lit_str"), lo.alias("lo"), hi.alias("hi"), text.alias("ref_class")))
    brand = F.array(F.struct(F.lit("named-object").alias("tag"), text.alias("lit_str"), number.alias("lo"), number.alias("hi"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("ref_class")))
    template = t.atom("template", ref_class="T")
    bound = t.infer(F.array(F.array(template)), F.array(brand))
    subject = F.when(size <= 10, span(size, size)).when(size > 40, F.array(t.atom("string"))).otherwise(span(size - 20, size))
    rows = read(spark, d, "part").select("p_partkey", bound.alias("bound"), subject.alias("subject"), span(size, size).alias("own"))
    small, large = F.array(t.atom("int", lo=0, hi=10)), F.array(t.atom("int", lo=0, hi=25))
    chosen = t.conditional(F.col("subject"), small, F.array(t.atom("true")), F.array(t.atom("false")))
    wide = F.when(F.col("subject")[0]["lo"] < F.col("subject")[0]["hi"], F.array(t.atom("true"), t.atom("false"))).otherwise(chosen)
    return rows.select(
        "p_partkey", t.display(t.substitute(F.array(template, t.atom("null")), F.col("bound"))).alias("put"), t.display(wide).alias("chosen"),
        (F.size(t.broken_bounds(F.map_from_arrays(F.array(F.lit("T")), F.array("own")), F.map_from_arrays(F.array(F.lit("T")), F.array(large)))) > 0).alias("broken"),
    )
