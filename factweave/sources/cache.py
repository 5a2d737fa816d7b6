"""Results kept between runs, by path and content: Parquet snapshots, written whole and then named current."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class ResultCache:
    """``folder``/<version>/<table>; the newest version with a ``_current`` marker counts, so a write cut short changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], format_version: int = 1):
        self.spark, self.folder, self.tables, self.format_version = spark, folder.rstrip("/"), tables, format_version

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> str | None:
        fs, root = self._fs(self.folder)
        if not fs.exists(root):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(root))
        prefix = f"f{self.format_version}-"
        done = [n.removesuffix(".current") for n in names if n.startswith(prefix) and n.endswith(".current")]
        return done[-1] if done else None

    def read(self, table: str) -> DataFrame:
        v = self.version()
        schema = self.tables[table]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{v}/{table}") if v else self.spark.createDataFrame([], schema)

    def write(self, **tables: DataFrame) -> str:
        """A new snapshot of all tables; older ones are deleted once it is current."""
        old = self.version()
        n = int(old.split("-")[1]) + 1 if old else 0
        name = f"f{self.format_version}-{n:012d}-{uuid.uuid4().hex[:8]}"
        for table in self.tables:
            tables[table].write.parquet(f"{self.folder}/{name}/{table}")
        fs, mark = self._fs(f"{self.folder}/{name}.current")
        fs.create(mark).close()
        if old:
            for path in (f"{self.folder}/{old}.current", f"{self.folder}/{old}"):
                fs, p = self._fs(path)
                fs.delete(p, True)
        return name
