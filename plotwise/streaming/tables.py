"""Tables that micro-batches add to: rows by batch number in a folder of the shared store.

A batch that is run again after a failure replaces its own rows, and what was written before a restart is found by listing the folder, so nothing is
kept in the driver's memory between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchTable:
    """Rows with the ``schema`` of a DDL string; ``read`` gives them with the number of their ``batch``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _children(self, name: str) -> list[int]:
        """Numbers of the finished folders ``name``=number."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        top = hadoop.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith(f"{name}=")]
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(hadoop.Path(p, "_SUCCESS")))

    def _folder(self, name: str, n: int) -> str:
        return f"{self.path}/{name}={n}"

    def _load(self, name: str, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], f"{self.schema}, batch int")
        rows = self.spark.read.schema(f"{self.schema}, {name} int").option("basePath", self.path).parquet(*[self._folder(name, n) for n in numbers])
        return rows.withColumnRenamed(name, "batch")

    def batches(self) -> list[int]:
        return self._children("batch")

    def write(self, rows: DataFrame, n: int) -> None:
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*names).write.mode("overwrite").parquet(self._folder("batch", n))

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before a batch."""
        return self._load("batch", [n for n in self.batches() if before is None or n < before])


class KeyedTable(BatchTable):
    """The last row of each key counts (SNK5). Every ``every`` batches the rows that count are written as a whole, so a read takes one whole and the
    batches since. With ``gone`` in the schema, keys whose last row has it true are left out."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], every: int = 20):
        super().__init__(spark, path, schema)
        self.keys, self.every = keys, every

    def state(self, before: int | None = None) -> DataFrame:
        """The last row of each key before a batch, or of all."""
        whole = [n for n in self._children("upto") if before is None or n < before][-1:]
        rest = [n for n in self.batches() if (before is None or n < before) and (not whole or n > whole[0])]
        rows = self._load("upto", whole).unionByName(self._load("batch", rest))
        other = [c for c in rows.columns if c not in (*self.keys, "batch")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*other), F.col("batch")).alias("r")).select(*self.keys, "r.*")
        return last.where("not coalesce(gone, false)") if "gone" in other else last

    def write(self, rows: DataFrame, n: int) -> None:
        super().write(rows, n)
        if n % self.every == self.every - 1:
            self.state(n + 1).write.mode("overwrite").parquet(self._folder("upto", n))
