"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, langid, merkle, neighbours, packing, quality, suffixes, toxicity, windows
from .common import fold, read_table

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PACKING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


#: All pairs of a label, then the closure of the links. All audited links must have been found.
OP3_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), comp AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.u = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept,
  CASE WHEN EXISTS (FROM links) THEN 1::DOUBLE END AS link_recall FROM comp c
"""


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out), key="doc_id", text_col="text", label_col="lang")
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(read_table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, BPE_RANKS, public_tokenizers.PATTERN))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98).rows


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(merkle.edited_fingerprints(read_table(spark, sf_dir, "documents")))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digests(jaccard.join(read_table(spark, sf_dir, "documents"), words=3, threshold=(90, 100)))


def op6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.digests(windows.remove_repeats(read_table(spark, sf_dir, "documents"), width=50))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.train(docs, labels.where(~held_out))
    scored = quality.score(docs.select("doc_id", "text"), model, score_col="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(read_table(spark, sf_dir, "documents"), width=100))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model, score_col="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(read_table(spark, sf_dir, "documents"), PACKING_TOKENIZER))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_langid, op2_bpe, op3_neighbours, op4_fingerprints, op5_jaccard, op6_windows, op7_quality, op8_suffixes, op9_toxicity, op10_packing)}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op3_neighbours": OP3_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
