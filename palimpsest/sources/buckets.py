"""Stored tables in buckets of their key: a write reads and rewrites the buckets that its keys fall into, and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from palimpsest.sources import storage as st

BUCKETS = 64


class BucketTable:
    """Parquet files in a folder a bucket, by hash of ``key``. Every row bears the number of the batch that wrote it.

    A write names its batch. One that runs again after a failure puts what it wrote before out of the way first, so it changes nothing
    more. Writers must not overlap. Null keys are a key of their own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> BucketTable:
        out = cls(rows.sparkSession, path, rows.schema, key, buckets)
        out._write(rows.withColumn("__batch", F.lit(-1).cast("bigint")), "error")
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.withColumn("__bucket", self._bucket()).repartition("__bucket")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("__batch", LongType()), StructField("__bucket", IntegerType())])).parquet(self.path)

    def read(self, keys: list[tuple] | None = None) -> DataFrame:
        """All rows, or those of keys, for which only their buckets are listed and read."""
        rows = self._stored()
        if keys is not None:
            asked = self.spark.createDataFrame(keys, StructType([self.schema[k] for k in self.key]))
            rows = rows.where(F.col("__bucket").isin([r[0] for r in asked.select(self._bucket()).distinct().collect()]))
            rows = rows.join(asked.distinct(), [rows[k].eqNullSafe(asked[k]) for k in self.key], "left_semi")
        return rows.select(*self.schema.names)

    def _touched(self, new: DataFrame) -> DataFrame:
        """Stored rows of the buckets of ``new``; at most as many numbers as there are buckets reach the driver."""
        return self._stored().where(F.col("__bucket").isin([r[0] for r in new.select(self._bucket()).distinct().collect()]))

    def insert(self, new: DataFrame, batch: int) -> None:
        """Append rows. Files that are there stay as they are, unless the batch was here before."""
        new = new.select(*self.schema.names)
        before = self._touched(new)
        rows = new.withColumn("__batch", F.lit(batch).cast("bigint"))
        if before.where(F.col("__batch") == batch).isEmpty():
            self._write(rows, "append")
        else:
            self._write(before.where(F.col("__batch") != batch).drop("__bucket").unionByName(rows), "overwrite")

    def _merge(self, new: DataFrame, batch: int, merged) -> None:  # noqa: ANN001
        """Rewrite the touched buckets as ``merged(stored, new)`` says."""
        new = new.select(*[c for c in self.schema.names if c in new.columns])
        before = self._touched(new)
        out = merged(before.drop("__bucket"), new.withColumn("__batch", F.lit(batch).cast("bigint")))
        self._write(out.select(*self.schema.names, "__batch"), "overwrite")

    def upsert_missing(self, new: DataFrame, batch: int) -> None:
        """Insert what is not there by key, leave what is; of new rows with one key the least stays."""
        self._merge(new, batch, lambda old, rows: st.upsert_missing(old, rows, self.key))

    def replace_sets(self, new: DataFrame, batch: int, key: list[str] | None = None) -> None:
        """Rows of the keys that ``new`` has become its rows as a set."""
        self._merge(new, batch, lambda old, rows: st.replace_sets(old, rows, key or self.key))

    def replace_rows(self, new: DataFrame, batch: int, keep: list[str]) -> None:
        """Replace whole rows by their key, but never the columns in ``keep``."""
        self._merge(new, batch, lambda old, rows: st.replace_rows(old, rows, self.key[0], keep))
