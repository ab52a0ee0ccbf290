"""A persisted approximate index: vectors in the cells of a coarse partition, with append, load and search.

Cells grow with the square root of the table. Every vector is indexed; a search scores exactly all
vectors of the cells it probes. The number of probes comes from a recall target, measured on a
sample of the stored vectors when the index is made.
"""

from __future__ import annotations

import dataclasses
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions import scoring
from . import blocks, sidecar

KIND, FORMAT_VERSION = "cells", 1


def point_id(vector_id: int, prefix: str = "vector:") -> str:
    """The id string of a vector in a point export: a name-based UUID."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{prefix}{vector_id}"))


def check_vectors(vectors: DataFrame, dim: int | None = None) -> int:
    """item_id, emb: whole unique ids, finite vectors that are not zero, of one dimension; the dimension."""
    size = F.size("emb")
    r = vectors.agg(
        F.count("*").alias("n"), F.count_distinct("item_id").alias("ids"), F.count_if(~scoring.valid_vector(F.col("emb"))).alias("bad"), F.min(size).alias("low"), F.max(size).alias("high")
    ).first()
    if r.ids != r.n:
        raise ValueError(f"{r.n - r.ids} ids are missing or not unique")
    if r.bad:
        raise ValueError(f"{r.bad} vectors are empty, zero or not finite")
    if r.n and (r.low != r.high or (dim is not None and r.low != dim)):
        raise ValueError(f"vectors have {r.low} to {r.high} components" + (f" and not {dim}" if dim else ""))
    return int(r.low) if r.n else dim or 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit(vectors: DataFrame, config: SearchConfig) -> tuple[np.ndarray, int]:
    """(centres, probes). Both come from a sample of at most about config.sample vectors, chosen by the hash of their id."""
    n = vectors.count()
    share = min(1.0, config.sample / max(1, n))
    few = vectors.where(F.pmod(F.xxhash64("item_id", F.lit(3)), F.lit(1_000_003)) <= int(share * 1_000_003))
    x = np.array([r.emb for r in few.orderBy(F.xxhash64("item_id", F.lit(4)), "item_id").select("emb").collect()], float)
    if not len(x):
        return np.zeros((0, 0)), 1
    x = _unit(x)
    rng = np.random.default_rng(config.seed)
    cells = min(len(x), config.cells or max(1, min(config.most_cells, math.ceil(math.sqrt(n)))))
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(12):
        own = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        seen = np.bincount(own, minlength=cells) > 0
        centres[seen] = _unit(total[seen])
    if config.probes:
        return centres, min(config.probes, cells)
    # how many cells hold the ten nearest (in the sample) of some stored vectors
    own = (x @ centres.T).argmax(axis=1)
    ask = x[:: max(1, len(x) // 256)]
    sim = ask @ x.T
    nearest = np.argsort(-sim, axis=1)[:, 1:11]
    order = np.argsort(-(ask @ centres.T), axis=1)
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(cells)[None, :], axis=1)
    needed = np.take_along_axis(turn, own[nearest], axis=1)
    found = [(needed < p).mean() if needed.size else 1.0 for p in range(1, cells + 1)]
    return centres, 1 + next((i for i, r in enumerate(found) if r >= config.recall), cells - 1)


def assigned(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """item_id, emb, cell: a row for each of the ``probes`` nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            cell = np.argsort(-(_unit(x) @ centres.T), axis=1, kind="stable")[:, :probes]
            each = pa.array(np.repeat(np.arange(n), cell.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), pa.array(cell.ravel().astype(np.int32))], ["item_id", "emb", "cell"])

    source = vectors.select(F.col("item_id").cast("long").alias("item_id"), F.col("emb").cast("array<double>").alias("emb"))
    return source.mapInArrow(run, "item_id long, emb array<double>, cell int")


@dataclasses.dataclass
class CellIndex:
    """An index at ``path``: the tables vectors (item_id, emb, cell; ordered by cell) and centres, and a stamp."""

    spark: SparkSession
    path: str
    dim: int
    centres: np.ndarray
    probes: int

    @classmethod
    def create(cls, vectors: DataFrame, path: str, config: SearchConfig = SearchConfig()) -> "CellIndex":
        """Fit and write an index; refuses a folder that holds one."""
        spark = vectors.sparkSession
        if _exists(spark, f"{path}/stamp"):
            raise ValueError(f"{path} holds an index already")
        dim = check_vectors(vectors)
        centres, probes = fit(vectors, config)
        out = cls(spark, path, dim, centres, probes)
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        out._write(vectors)
        out._stamp(vectors.count())
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str, dim: int | None = None) -> "CellIndex":
        """The index at a path; raises if its stamp, dimension or size doesn't fit."""
        if not _exists(spark, f"{path}/stamp"):
            raise ValueError(f"{path} holds no index")
        # a stamp is written for each change of size, the last one counts
        stamp = max((json.loads(r.value) for r in spark.read.text(f"{path}/stamp").collect()), key=lambda s: s["size"])
        if (stamp["kind"], stamp["format_version"]) != (KIND, FORMAT_VERSION):
            raise ValueError(f"{path} is of kind {stamp['kind']}, version {stamp['format_version']}")
        if dim is not None and stamp["dim"] != dim:
            raise ValueError(f"{path} holds vectors of {stamp['dim']} components, not {dim}")
        rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r.cell)
        out = cls(spark, path, stamp["dim"], np.array([r.centre for r in rows]).reshape(len(rows), -1), stamp["probes"])
        if out.size() != stamp["size"]:
            raise ValueError(f"{path} is incomplete: {out.size()} of {stamp['size']} vectors")
        return out

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("item_id long, emb array<double>, cell int").parquet(f"{self.path}/vectors")

    def size(self) -> int:
        return self.vectors().count()

    def append(self, vectors: DataFrame) -> None:
        """Add vectors with new ids; cells stay as fitted."""
        check_vectors(vectors, self.dim)
        known = sidecar.duplicates(vectors, self.vectors(), "item_id")
        if not known.isEmpty():
            raise ValueError(f"ids are stored already: {[r.item_id for r in known.limit(5).collect()]}")
        size = self.size() + vectors.count()
        self._write(vectors)
        self._stamp(size)

    def _write(self, vectors: DataFrame) -> None:
        placed = assigned(vectors, self.centres, 1)
        placed.repartitionByRange("cell", "item_id").sortWithinPartitions("cell", "item_id").write.mode("append").parquet(f"{self.path}/vectors")

    def _stamp(self, size: int) -> None:
        stamp = {"kind": KIND, "format_version": FORMAT_VERSION, "dim": self.dim, "size": size, "cells": len(self.centres), "probes": self.probes}
        self.spark.createDataFrame([(json.dumps(stamp),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/stamp")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """q_id, item_id, score, rank, as search.exact_topk gives them, over the probed cells. k <= 0 gives no rows."""
        q = queries.where(scoring.valid_vector(F.col("emb"))).select("item_id", "emb")
        asked = assigned(q, self.centres, min(probes or self.probes, len(self.centres)))
        pairs = self.vectors().join(asked.select(F.col("item_id").alias("q_id"), F.col("emb").alias("q_emb"), "cell"), "cell")
        score = F.round(scoring.dot(F.col("emb"), F.col("q_emb")) / (scoring.norm(F.col("emb")) * scoring.norm(F.col("q_emb"))), blocks.DIGITS)
        rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), "item_id"))
        return pairs.select("q_id", "item_id", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= max(k, 0))

    def scanned(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """share: mean part of the vectors that a query is compared with."""
        sizes = self.vectors().groupBy("cell").agg(F.count("*").alias("n"))
        asked = assigned(queries.select("item_id", "emb"), self.centres, min(probes or self.probes, len(self.centres)))
        per = asked.join(sizes, "cell").groupBy("item_id").agg(F.sum("n").alias("n"))
        return per.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("total")))).agg(F.avg(F.col("n") / F.col("total")).alias("share"))

    def points(self) -> DataFrame:
        """id, vector_id, vector: the vectors as points for other stores (write it as JSON)."""
        ids = F.udf(point_id, "string")
        return self.vectors().select(ids("item_id").alias("id"), F.col("item_id").alias("vector_id"), F.col("emb").alias("vector"))


def read_points(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """item_id, emb of exported points; raises if a vector is of another dimension or an id occurs twice."""
    rows = spark.read.schema("id string, vector_id long, vector array<double>").json(path).select(F.col("vector_id").alias("item_id"), F.col("vector").alias("emb"))
    check_vectors(rows, dim)
    return rows


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
