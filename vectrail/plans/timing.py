"""Timing harness: timed calls and the sweep over dimension, size and k."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def time_calls(fn: Callable[[], object], n: int, warmup: int = 0, timer: Callable[[], float] = time.perf_counter) -> list[float]:
    if n < 1 or warmup < 0:
        raise ValueError("n must be at least 1 and warmup not negative")
    for _ in range(warmup):
        fn()
    out = []
    for _ in range(n):
        start = timer()
        fn()
        out.append(timer() - start)
    return out


def percentiles(values: list[float]) -> dict[str, float]:
    x = np.asarray(values, float)
    if not len(x) or not np.isfinite(x).all():
        raise ValueError("values must be finite and at least one")
    return {"n": len(x), "mean": float(x.mean())} | {f"p{q}": float(np.percentile(x, q)) for q in (50, 90, 95, 99)}


def unit_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """item_id, emb: seeded random unit vectors (a function of id and seed, whatever the partitions)."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(1 << 31)) + 0.5) / float(1 << 31)
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.sqrt(-2 * F.log(u(k * 2))) * F.cos(2 * np.pi * u(k * 2 + 1)))
    return spark.range(n).select(F.col("id").alias("item_id"), raw.alias("emb"))


def size_sweep(build: Callable[[int, int], Callable[[int], object]], dims: list[int], sizes: list[int], ks: list[int], repeats: int, warmup: int = 1, timer=time.perf_counter) -> list[dict]:
    """One row a (dim, size, k); each (dim, size) is built once. build returns a search function of k."""
    rows = []
    for dim in dims:
        for size in sizes:
            start = timer()
            search = build(dim, size)
            built = timer() - start
            for k in ks:
                rows.append({"dim": dim, "size": size, "k": k, "build": built} | percentiles(time_calls(lambda k=k: search(k), repeats, warmup, timer)))
    return rows
