"""Exact nearest neighbours by cosine, and the fused search on top of them (the approximate index is in index)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from . import blocks


def exact_topk(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """q_id, item_id, score, rank: the k items of largest cosine, ties by id. k <= 0 gives no rows.

    Each pair of blocks keeps its own k best; the window sees at most k rows a query and item block.
    """
    q = queries.where(scoring.valid_vector(F.col("emb")))
    c = items.where(scoring.valid_vector(F.col("emb")))

    def kernel(scores, q, c, _):
        ids = c["item_id"]
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, : max(k, 0)]
        row = np.repeat(np.arange(len(scores)), order.shape[1])
        return blocks.batch(q_id=q["item_id"][row], item_id=ids[order.ravel()], score=scores[row, order.ravel()])

    found = blocks.cosine_blocks(q, c, kernel, "q_id long, item_id long, score double", query_columns=["item_id", "emb"], item_columns=["item_id", "emb"])
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= max(k, 0))


def single_topk(query: list[float], items: DataFrame, k: int) -> DataFrame:
    """item_id, score of one query vector: a scan and a distributed top k."""
    length = float(np.sqrt(np.square(query).sum()))
    if not length:
        raise ValueError("the query is a zero vector")
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.round(scoring.dot(F.col("emb"), q) / (scoring.norm(F.col("emb")) * length), blocks.DIGITS)
    return items.where(scoring.valid_vector(F.col("emb"))).select("item_id", score.alias("score")).orderBy(F.col("score").desc(), "item_id").limit(max(k, 0))


def fused_search(hits: DataFrame, queries: DataFrame, sidecar: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Hits with their context score and fused score, ranked anew by it within each query.

    Hits whose metadata is missing come last (their fused score is null); ties keep the similarity's order.
    """
    context = ["ts", "geo", "entities"]
    q = queries.select(F.col("item_id").alias("q_id"), *[F.col(c).alias(f"q_{c}") for c in context])
    c = sidecar.select("item_id", *[F.col(x).alias(f"c_{x}") for x in context], F.lit(True).alias("known"))
    joined = hits.join(q, "q_id").join(c, "item_id", "left")
    score = scoring.context_score({x: F.col(f"q_{x}") for x in context}, {x: F.col(f"c_{x}") for x in context})
    joined = joined.withColumn("context_score", F.when(F.col("known"), score))
    joined = joined.withColumn("fused_score", scoring.fuse(F.col("score"), F.col("context_score"), alpha, beta))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.round("fused_score", 9).desc_nulls_last(), "rank"))
    return joined.select("q_id", "item_id", F.col("score").alias("face_score"), "context_score", "fused_score", rank.alias("rank"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """n_queries, recall: mean share of the true neighbours that were found."""
    hit = truth.select("q_id", "item_id").join(found.select("q_id", "item_id", F.lit(1).alias("hit")), ["q_id", "item_id"], "left")
    per = hit.groupBy("q_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return per.agg(F.count("*").alias("n_queries"), F.avg("r").alias("recall"))
