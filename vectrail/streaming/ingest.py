"""Streaming ingest: records pass the quality gate and are appended to the index table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring


def gated(records: DataFrame, quality_min: float) -> DataFrame:
    return records.withColumn("trust", scoring.trust(F.col("quality"), quality_min)).where("trust <> 'reject'")


#: Known keys are kept by bucket, so a batch reads the buckets of its own keys only.
BUCKETS = 256


def ingest_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, *, quality_min: float, key: str = "item_id"):
    """Start a query that appends gated records of new files to ``target``; keys seen before are skipped.

    Of the rows of one key in a batch, the one of largest quality stays (then the first in the order
    of all columns). A batch is written under its number, so a batch that is tried again overwrites
    itself; its keys go to ``target``.keys, by bucket.
    """
    stream = gated(spark.readStream.schema(schema).parquet(source), quality_min)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    keys = f"{target}.keys"

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        picked = batch.groupBy(key).agg(F.min(F.struct((-F.col("quality")).alias("_worst"), *rest)).alias("x"))
        fresh = picked.select(key, *[F.col(f"x.{c}").alias(c) for c in rest]).select(*batch.columns)
        touched = sorted(r.b for r in fresh.select(bucket.alias("b")).distinct().collect())
        if number and _exists(session, keys):
            known = session.read.option("basePath", keys).parquet(keys).where((F.col("batch") < number) & F.col("bucket").isin(touched)).select(key)
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")
        done = session.read.schema(fresh.schema).parquet(f"{target}/batch={number}")
        done.select(key, bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{keys}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
