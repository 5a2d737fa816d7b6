"""Edits as a stream: each micro-batch of changed files updates versioned fact tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.operators.incremental import upsert


class VersionedTable:
    """A table kept as Parquet deltas, one a version, and a snapshot of the whole after every ``every`` versions.

    A version is the last snapshot with the deltas after it, the latest row of each ``key``. A batch that is replayed writes the
    same delta again. A snapshot drops the deltas and snapshots before the one before it, so that versions since that one can
    still be read. A table opened again goes on from the last version written.
    """

    def __init__(self, spark, path: str, schema: str, key: str = "path", every: int = 16):
        self.spark, self.path, self.schema, self.key, self.every = spark, path, schema, key, every
        self.version = max(self._versions("delta"), default=-1)

    def _folder(self, kind: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self, kind: str) -> list[int]:
        """Versions that were written whole."""
        fs, path = self._folder(kind)
        if not fs.exists(path):
            return []
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(f.getPath().getName()[2:]) for f in fs.listStatus(path) if fs.exists(done(f.getPath(), "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version if version is None else version
        if v < 0:
            return self.spark.createDataFrame([], self.schema)
        start = max((w for w in self._versions("whole") if w <= v), default=-1)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/delta/v={w}").withColumn("__v", F.lit(w)) for w in self._versions("delta") if start < w <= v]
        if start >= 0:
            parts.append(self.spark.read.schema(self.schema).parquet(f"{self.path}/whole/v={start}").withColumn("__v", F.lit(start)))
        rows = reduce(DataFrame.unionByName, parts)
        if len(parts) == 1:
            return rows.drop("__v")
        columns = [c for c in rows.columns if c != "__v"]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "__v").alias("row")).select("row.*")

    def write(self, changed: DataFrame, version: int) -> None:
        """Adds a version in which the rows ``changed`` hold."""
        changed.write.mode("overwrite").parquet(f"{self.path}/delta/v={version}")
        self.version = version
        if version % self.every == self.every - 1:
            self.read(version).write.mode("overwrite").parquet(f"{self.path}/whole/v={version}")
            kept = [w for w in self._versions("whole") if w < version][-1:]
            for kind in ("delta", "whole"):
                fs, path = self._folder(kind)
                for w in self._versions(kind):
                    if kept and w < kept[0] + (kind == "delta"):
                        fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"v={w}"), True)


def last_edits(batch: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """The last edit of each file in a batch, combined map side."""
    return batch.groupBy(path).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")


def maintain(edits: DataFrame, table: VersionedTable, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Starts a query that applies edits (path, content_hash, ord and the table's columns) to ``table``, batch by batch.

    ``on_change`` gets the edits that changed something; they alone are written. Exactly once: a batch builds its version from
    the one before it.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        edited = last_edits(batch).drop("ord")
        known = table.read(epoch - 1).join(edited.select(table.key), table.key, "left_semi")
        fresh = upsert(known, edited)[1].persist()
        try:
            table.write(fresh, epoch)
            if on_change:
                on_change(fresh, epoch)
        finally:
            fresh.unpersist()

    return edits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
