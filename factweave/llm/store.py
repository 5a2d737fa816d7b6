"""Input tables and the shared scratch folder of the corpus operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer bytes than Spark gives each core of a scan is dealt to all cores, since row groups are not split."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    few = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes")) * cores
    return rows.repartition(cores) if rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < few else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; in local mode without one, a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Rows that go to a Python worker at once; texts are long, so Spark's default would hold tens of MB on both sides.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Caps the session's Arrow batches at BATCH_ROWS rows; a smaller setting stays."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    small_batches(spark)
    path = f"{shared_dir(spark)}/factweave-{name}-{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _file_system(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_scopes = threading.local()


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`keep` writes inside are deleted at the end; what must outlive it is written by :func:`outlive`."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            _file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def outlive(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: lineage ends, a lost executor loses nothing."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """:func:`outlive` until the end of the :func:`tidy` block around it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if _scopes.__dict__.get("stack"):
        _scopes.stack[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def named(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names`` for helper columns, with a prefix that no column of ``df`` has."""
    prefix, taken = "_", [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + n for n in names]


def rewritten(docs: DataFrame, found: DataFrame, run: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The columns of ``docs`` as ``run`` makes them of ``found``, which has helper columns after them. ``run`` gets batches and
    the place of ``text``; names do not reach it. ``n_chars``, where there is one, follows the text."""
    at = docs.columns.index("text")
    plain = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    out = plain.mapInArrow(lambda batches: run(batches, at), schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_each(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Of the rows of each key the one whose columns hash least, so that reruns agree. Rows of a key come together map side."""
    helpers = spare(df, *(f"k{i}" for i in range(len(keys))), "row")
    hashed = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(named(df), df.schema, strict=True)]
    whole = df.select(*[(F.col(k) if isinstance(k, str) else k).alias(h) for k, h in zip(keys, helpers, strict=False)], F.struct(*named(df)).alias(helpers[-1]), F.xxhash64(*hashed).alias(helpers[-1] + "h"))
    best = whole.groupBy(*helpers[:-1]).agg(F.min_by(helpers[-1], helpers[-1] + "h").alias(helpers[-1]))
    return best.select(f"`{helpers[-1]}`.*")


def redealt(key: str) -> Column:
    """A long key under its own name as an expression of its own: a join then deals this aggregated side anew instead of
    using the aggregate's exchange, both sides stand alone, and adaptive execution can split a hot key."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key)


def local_path(uri: str) -> str | None:
    """The file-system path of a path without scheme or with file:, else None."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def open_fs(uri: str):
    """(file system, path) for Python code on executors that writes or reads files at ``uri``."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), os.path.abspath(path)) if path else fs.FileSystem.from_uri(uri)
