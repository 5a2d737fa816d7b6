"""Report formats. Each is a DataFrame of text lines or documents, so that writing stays distributed; small documents can be
gathered on request.

Issue columns: kind, code, severity, file, line, line_end, col_start, col_end, message, snippet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.keys import fnv1a, xml_escape
from factweave.operators.catalogue import RULES

#: Levels of the continuous-integration format and of SARIF, and SARIF's ranks (fixed values).
CI_LEVEL = {"error": "error", "warning": "warning", "info": "notice"}
SARIF_LEVEL = {"error": "error", "warning": "warning", "info": "note"}
SARIF_RANK = {"error": 90.0, "warning": 95.0, "info": 99.0}
#: Element names of the JUnit format (fixed values).
JUNIT_ELEMENT = {"error": "failure", "warning": "warning", "info": "notice"}
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def _map(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def text_lines(issues: DataFrame) -> DataFrame:
    """``file:line:col severity[code] kind: message`` per issue."""
    return issues.select(F.format_string("%s:%d:%d %s[%s] %s: %s", "file", "line", "col_start", "severity", "code", "kind", "message").alias("value"))


def ci_lines(issues: DataFrame) -> DataFrame:
    """``::level file=,line=,col=::message``; line breaks and percent signs are escaped."""
    text = F.replace(F.replace(F.replace("message", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return issues.select(F.format_string("::%s file=%s,line=%d,col=%d::%s: %s", _map(CI_LEVEL, F.col("severity")), "file", "line", F.col("col_start") + 1, "kind", text).alias("value"))


def json_lines(issues: DataFrame) -> DataFrame:
    """One JSON object per issue."""
    return issues.select(F.to_json(F.struct(*issues.columns)).alias("value"))


def junit_suites(issues: DataFrame) -> DataFrame:
    """(file, value): one XML test suite per file; errors alone count as failures. Cases are in order of line, column and kind."""
    element = _map(JUNIT_ELEMENT, F.col("severity"))
    place = xml_escape(F.format_string("%s:%d:%d %s %s: %s", "file", "line", "col_start", "severity", "kind", "message"))
    head = F.format_string('    <testcase name="%s" classname="%s">\n', xml_escape("kind"), xml_escape("file"))
    case = F.concat(head, F.format_string('      <%s message="%s" type="%s">%s</%s>\n    </testcase>\n', element, xml_escape("message"), xml_escape("kind"), place, element))
    made = issues.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("line", "col_start", "kind", case.alias("x")))).alias("cases"), F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("failures")
    )
    body = F.array_join(F.transform("cases", lambda c: c["x"]), "")
    return made.select("file", F.format_string('  <testsuite name="%s" tests="%d" failures="%d">\n%s  </testsuite>\n', xml_escape("file"), "n", "failures", body).alias("value"))


def _framed(head: DataFrame, rows: DataFrame, tail: str, path: str) -> None:
    """Text files of ``head`` (value), ``rows`` (key, value) in order of key, and ``tail``."""
    last = rows.sparkSession.createDataFrame([(tail,)], "value string")
    whole = head.select(F.lit(0).alias("part"), F.lit("").alias("key"), "value").unionByName(rows.select(F.lit(1).alias("part"), "key", "value")).unionByName(last.select(F.lit(2).alias("part"), F.lit("").alias("key"), "value"))
    line = F.regexp_replace("value", "\n$", "").alias("value")
    whole.repartitionByRange("part", "key").sortWithinPartitions("part", "key", "value").select(line).write.mode("overwrite").text(path)


def write_junit(issues: DataFrame, path: str, name: str) -> None:
    """The whole report as text files whose contents follow one another."""
    counts = issues.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("f"))
    head = counts.select(F.format_string('<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="%s" tests="%d" failures="%d">\n', xml_escape(F.lit(name)), "n", "f").alias("value"))
    _framed(head, junit_suites(issues).withColumnRenamed("file", "key"), "</testsuites>\n", path)


def fingerprint(issues: DataFrame) -> Column:
    """Location-free identity: FNV-1a of ``kind:snippet``."""
    return fnv1a(F.concat(F.col("kind"), F.lit(":"), F.coalesce("snippet", F.lit(""))))


def sarif_results(issues: DataFrame) -> DataFrame:
    """One SARIF result per issue, as JSON. Columns count from 1."""
    region = F.struct(F.col("line").alias("startLine"), F.col("line_end").alias("endLine"), (F.col("col_start") + 1).alias("startColumn"), (F.col("col_end") + 1).alias("endColumn"))
    where = F.struct(F.col("file").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
    result = F.struct(
        F.col("kind").alias("ruleId"),
        _map(SARIF_LEVEL, F.col("severity")).alias("level"),
        _map(SARIF_RANK, F.col("severity")).alias("rank"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.struct(fingerprint(issues).alias("primaryLocationLineHash")).alias("partialFingerprints"),
        F.array(F.struct(F.struct(where.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    return issues.select(F.to_json(result).alias("value"))


def sarif_rules(issues: DataFrame, uri: str = "") -> DataFrame:
    """(id, value): the rules that occur, as JSON, with the severity that the catalogue gives them, else the first one seen."""
    usual = F.create_map(*[F.lit(x) for k, (_, level) in RULES.items() for x in (k, level)])
    rows = issues.groupBy(F.col("kind").alias("id")).agg(F.min("severity").alias("seen"))
    level = _map(SARIF_LEVEL, F.coalesce(usual[F.col("id")], F.col("seen")))
    tag = F.when(F.startswith("id", F.lit("Tainted")), "security").otherwise("maintainability")
    about = F.struct(
        "id", F.col("id").alias("name"), F.struct(F.col("id").alias("text")).alias("shortDescription"), F.lit(uri).alias("helpUri"), F.struct(level.alias("level")).alias("defaultConfiguration"), F.struct(F.array(tag).alias("tags")).alias("properties")
    )
    return rows.select("id", F.to_json(about).alias("value"))


def write_sarif(issues: DataFrame, path: str, tool: str, uri: str = "") -> None:
    """The whole log as text files whose contents follow one another. Rules are gathered (one row a kind), results are not."""
    import json

    rules = [json.loads(r["value"]) for r in sarif_rules(issues, uri).orderBy("id").collect()]
    start = json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "informationUri": uri, "rules": rules}}, "results": []}]})
    at = start.rindex("[]") + 1
    results = sarif_results(issues).distinct()
    least = results.agg(F.min("value")).first()[0]  # the first result has no comma before it
    rows = results.select(F.col("value").alias("key"), F.concat(F.when(F.col("value") == F.lit(least), "").otherwise(",\n"), "value").alias("value"))
    _framed(issues.sparkSession.createDataFrame([(start[:at],)], "value string"), rows, start[at:] + "\n", path)


def sarif(issues: DataFrame, tool: str, uri: str = "") -> str:
    """A whole SARIF log as text on the driver; use :func:`write_sarif` for large reports."""
    import json

    rules = [json.loads(r["value"]) for r in sarif_rules(issues, uri).orderBy("id").toLocalIterator()]
    results = [json.loads(r["value"]) for r in sarif_results(issues).toLocalIterator()]
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "informationUri": uri, "rules": rules}}, "results": results}]}, indent=2)


def baseline_xml(issues: DataFrame) -> DataFrame:
    """(file, value): one XML element per file, kinds in order, a code element per issue."""
    code = F.concat(F.lit("<code>"), xml_escape(F.coalesce("snippet", F.lit(""))), F.lit("</code>"))
    kinds = issues.groupBy("file", "kind").agg(F.concat_ws("", F.sort_array(F.collect_list(code))).alias("codes"))
    files = kinds.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("kind", "codes"))).alias("kinds"))
    body = F.array_join(F.transform("kinds", lambda k: F.concat(F.lit("<"), k["kind"], F.lit(">"), k["codes"], F.lit("</"), k["kind"], F.lit(">"))), "")
    return files.select("file", F.concat(F.lit('<file src="'), xml_escape("file"), F.lit('">'), body, F.lit("</file>")).alias("value"))


def write_baseline(issues: DataFrame, path: str) -> None:
    """The baseline as text files in file order, head and tail lines in files of their own."""
    spark = issues.sparkSession
    head, tail = (spark.createDataFrame([(k, "", v)], "part int, file string, value string") for k, v in ((0, '<?xml version="1.0" encoding="UTF-8"?>\n<files>'), (2, "</files>")))
    rows = head.unionByName(baseline_xml(issues).withColumn("part", F.lit(1))).unionByName(tail)
    rows.repartitionByRange("part", "file").sortWithinPartitions("part", "file").select("value").write.mode("overwrite").text(path)
