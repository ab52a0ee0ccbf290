"""The metadata table beside the vectors: upsert, lookups, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by the order columns: one aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("x")
    return rows.groupBy(key).agg(best).select(key, "x.*").select(*rows.columns)


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "vector_id") -> DataFrame:
    """Stored rows, replaced by incoming ones of equal key (the later ingest_time, then the incoming side)."""
    both = stored.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1)))
    return latest(both, key, "ingest_time", "side").drop("side")


def get_many(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys with their position; missing keys are omitted. wanted: key, pos."""
    return table.join(wanted, key)


def duplicates(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once in the batch (n_batch) or are stored already."""
    batch = incoming.groupBy(key).agg(F.count("*").alias("n_batch"))
    marked = batch.join(stored.select(key).distinct().withColumn("stored", F.lit(True)), key, "left")
    return marked.select(key, "n_batch", F.coalesce("stored", F.lit(False)).alias("stored")).where("n_batch > 1 OR stored")


def allocate_ids(rows: DataFrame, order: str, start: int) -> DataFrame:
    """rows with vector_id = start, start + 1, ... in the order of a unique column.

    A range partition is numbered in itself and shifted by the counts of those before it, so no
    task sees all rows.
    """
    from .ordering import numbered

    return numbered(rows, order).withColumn("vector_id", F.col("place") + F.lit(start)).drop("place")


def max_id(table: DataFrame, key: str) -> DataFrame:
    return table.agg(F.max(key).alias("max_id"))


def point_lookup(table: DataFrame, key: str, value: int) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def trust_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("trust").agg(F.count("*").alias("n"))


