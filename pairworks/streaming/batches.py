"""Rows by key that a stream rewrites: a Parquet partition per micro-batch."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType


class BatchTable:
    """Micro-batch b writes the partition batch=b: all rows that the keys it touched have from then on.

    A key's rows are those of its last partition; a row `_gone` stands for a key that has none left.
    A micro-batch that runs again overwrites its own partition and reads those before it, so that
    it finds its input as it was.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.schema = spark.createDataFrame([], schema).schema
        self._stored = StructType([*self.schema.fields]).add("_gone", BooleanType()).add("batch", IntegerType())

    def put(self, batch: int, rows: DataFrame, touched: DataFrame | None = None) -> None:
        """Writes the rows of the keys that `batch` changed; `touched` names keys that may have none left."""
        whole = rows.select(*self.schema.names, F.lit(False).alias("_gone"))
        if touched is not None:
            # A row for every touched key; it counts only if the key has no other.
            blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(self.key) for f in self.schema.fields]
            whole = whole.unionByName(touched.select(*blank, F.lit(True).alias("_gone")))
        whole.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def before(self, batch: int, touched: DataFrame | None = None) -> DataFrame:
        """The table as micro-batch `batch` finds it, or of it the rows whose key is among the touched ones."""
        return self._newest(F.col("batch") < batch, touched)

    def latest(self) -> DataFrame:
        """The table after all micro-batches; empty before the first."""
        return self._newest(F.lit(True))

    def touching(self, rows: DataFrame, touched: DataFrame) -> DataFrame:
        """The rows whose key is among the touched ones."""
        return rows.join(touched.select(F.col(self.key).alias("_key")).distinct(), self._same(), "left_semi")

    def _same(self, *also: Column) -> Column:
        return reduce(Column.__and__, also, F.col(self.key).eqNullSafe(F.col("_key")))

    def _newest(self, which: Column, touched: DataFrame | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(self._stored).parquet(self.path).filter(which)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        newest = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max("batch").alias("_newest"))
        if touched is not None:
            # Keys and batches alone are matched first, and whole rows are joined once.
            keys = touched.select(F.col(self.key).alias("_touched"))
            newest = newest.join(keys, F.col("_key").eqNullSafe(F.col("_touched")), "left_semi")
        last = rows.join(newest, self._same(F.col("batch") == F.col("_newest")), "left_semi")
        return last.filter(~F.col("_gone")).select(*self.schema.names)
