"""File, autoload, configuration and baseline sources."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directories that a scan never enters (fixed values).
SKIPPED = ("vendor", ".git", "node_modules", ".cache", ".pnpm-store")


def scan(spark: SparkSession, root: str, suffix: str = ".php", skip: Iterable[str] = SKIPPED) -> DataFrame:
    """(path, text, content_hash) of the source files under ``root``; unreadable files are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    path = F.regexp_replace("path", "^file:(?://)?(?=/)", "")
    out = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"))
    for name in skip:
        out = out.filter(~F.contains("path", F.lit(f"/{name}/")))
    return out.withColumn("content_hash", F.sha2("text", 256))


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """The same table from texts in memory."""
    rows = spark.createDataFrame(list(texts.items()), "path string, text string")
    return rows.withColumn("content_hash", F.sha2("text", 256))


class TextSource(DataSource):
    """A pluggable source: ``spark.read.format("factweave_texts").option("json", '{"path": "text"}')``."""

    @classmethod
    def name(cls) -> str:
        return "factweave_texts"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema) -> DataSourceReader:
        return TextReader(self.options)


class TextReader(DataSourceReader):
    def __init__(self, options):
        self.texts = json.loads(options["json"])

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.texts))]

    def read(self, partition):
        yield list(self.texts.items())[partition.value]


def autoload_rules(spark: SparkSession, manifest: str, is_project: bool = True) -> DataFrame:
    """(scheme, is_project, prefix, dir) of a package manifest (JSON): autoload, and autoload-dev for projects."""
    data = json.loads(manifest)
    rows = []
    for section in ("autoload", "autoload-dev") if is_project else ("autoload",):
        for scheme in ("psr-4", "psr-0"):
            for prefix, dirs in (data.get(section, {}).get(scheme) or {}).items():
                rows += [(scheme, is_project, prefix, d) for d in ([dirs] if isinstance(dirs, str) else dirs)]
    return spark.createDataFrame(rows, "scheme string, is_project boolean, prefix string, dir string")


def eager_files(manifest: str) -> list[str]:
    """Files that a package loads always."""
    return list(json.loads(manifest).get("autoload", {}).get("files", []))


def vendor_files(*lists: DataFrame) -> DataFrame:
    """(path) of all lists, each once."""
    out = lists[0].select("path")
    for x in lists[1:]:
        out = out.unionByName(x.select("path"))
    return out.distinct()


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, snippet) of a baseline file: ``<files><file src><Kind><code>snippet</code></Kind></file></files>``."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = [
                (file.get("src"), kind.tag, code.text or "")
                for content in batch.column(0).to_pylist()
                for file in ElementTree.fromstring(content).iter("file")
                for kind in file
                for code in kind.iter("code")
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["file", "kind", "snippet"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "file string, kind string, snippet string")


@dataclass
class Config:
    """A configuration file: roots, ignored paths, language version, error level, severities by kind, stubs, plugins."""

    roots: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    version: str | None = None
    error_level: int = 1
    handlers: dict[str, str] = field(default_factory=dict)
    stubs: list[str] = field(default_factory=list)
    plugins: list[str] = field(default_factory=list)
    baseline: str | None = None

    @property
    def show_info(self) -> bool:
        """Info is shown from level 7 on."""
        return self.error_level >= 7


def parse_config(text: str) -> Config:
    """Raises ValueError for text that is not XML."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise ValueError(str(e)) from e
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]
    out = Config(version=root.get("phpVersion"), error_level=int(root.get("errorLevel") or 1), baseline=root.get("errorBaseline"))
    for files in root.iter("projectFiles"):
        for node in files:
            if node.tag in ("directory", "file"):
                out.roots.append(node.get("name"))
            elif node.tag == "ignoreFiles":
                out.ignored += [x.get("name") for x in node]
    for handlers in root.iter("issueHandlers"):
        out.handlers |= {node.tag: node.get("errorLevel") for node in handlers if node.get("errorLevel")}
    out.stubs = [x.get("name") for s in root.iter("stubs") for x in s]
    out.plugins = [x.get("class") or x.get("filename") for p in root.iter("plugins") for x in p]
    return out
