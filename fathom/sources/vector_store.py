"""Vectors by content: a table from the digest of a text and the model's version to its vector, asked before the model is.

One folder a version. A write adds files; digests that two writers add at once are there twice, with the same vector, and count once.
Files are sorted by digest, and lie in folders by its first letters, so that a look-up reads the folders its digests are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.sources import workspace

SCHEMA = "digest string, vector array<double>, shard string"
#: Up to so many folders a look-up names those that it needs; there are 256.
NAMED = 128


class VectorStore:
    def __init__(self, spark: SparkSession, root: str, version: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/vectors-{version}"

    def _there(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def read(self, only: list[str] | None = None) -> DataFrame:
        if not self._there():
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows if only is None else rows.where(F.col("shard").isin(only))

    def embedded(self, rows: DataFrame, text: str, embed, name: str = "embedding") -> DataFrame:
        """``rows`` with the vectors of ``text`` in a column ``name``; ``embed`` (text column to vector column) sees each text once, and none that is known."""
        digest: Column = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
        rows = workspace.written(rows.withColumn("_digest", digest), "texts")
        asked = rows.groupBy(F.col("_digest").alias("digest")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("body")).withColumn("shard", F.substring("digest", 1, 2))
        shards = [r.shard for r in asked.select("shard").distinct().collect()]  # 256 at most
        known = self.read(shards if len(shards) <= NAMED else None)
        new = workspace.written(asked.join(known.select("digest").distinct(), "digest", "left_anti"), "new")
        if not new.isEmpty():
            made = new.select("digest", embed(F.col("body")).alias("vector"), "shard")
            made.hint("rebalance", F.col("shard")).sortWithinPartitions("shard", "digest").write.mode("append").partitionBy("shard").parquet(self.path)
        vectors = self.read(shards if len(shards) <= NAMED else None).groupBy(F.col("digest").alias("_digest")).agg(F.first("vector").alias(name))
        return rows.join(vectors, "_digest", "left").drop("_digest")
