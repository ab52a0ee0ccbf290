"""Corpus pipeline: quality, toxicity, near duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, works on all rows
that its predecessor kept, and returns a DataFrame; run() writes each result as Parquet in the
shared scratch folder and reads it back for the next stage. Rows with a null text pass as empty
texts. Extra columns of docs pass through all stages but the last. Ids are expected to be unique;
where they are not, a row is told apart by its id and text, and a repeat of both is one document.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import jaccard, packing, quality, suffixes, toxicity
from vectrail.llm.common import drop_table, fold, read_table, write_table

#: A document is rejected below this quality, or from this toxicity on.
LEAST_QUALITY, LEAST_TOXICITY = 0.3, 0.5
#: Labels of these documents teach nothing (crc32 of the id as text, modulo 5, is 0).
FOLDS, HELD_OUT = 5, 0
#: Near duplicates share at least this part of their five-word shingles.
WORDS, SIMILARITY = 5, (80, 100)
REPEAT_BYTES = 100
SEQUENCE_TOKENS = 2048


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose conditional-random-field quality is at least LEAST_QUALITY."""
    scored = quality.score(docs, quality.train(docs, _labels(spark, sf_dir)))
    return scored.where(F.col(scored.columns[-1]) >= LEAST_QUALITY).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose string-kernel toxicity is below LEAST_TOXICITY."""
    scored = toxicity.score(docs, toxicity.train(docs, _labels(spark, sf_dir)))
    return scored.where(F.col(scored.columns[-1]) < LEAST_TOXICITY).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near duplicates; texts without words are in no group."""
    joined = jaccard.join(docs, words=WORDS, threshold=SIMILARITY)
    kept = joined.where("doc = component").select("doc_id", "text_hash").distinct()
    ids = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    match = F.col("kept_id").eqNullSafe(docs["doc_id"].cast("long")) & (F.col("kept_hash") == own)
    stay = docs.join(ids, match, "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return stay.dropDuplicates(["doc_id", "text"]) if repeated else stay


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every repeat of a REPEAT_BYTES string out of the texts, and bring n_chars up to date.

    Parts of characters that a cut leaves are dropped. A text that is cut down to nothing stays as
    an empty text; null stays null where nothing was cut.
    """
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def rewrite(columns: list[pa.Array], cut: list[bool], kept: list[bytes]) -> list[pa.Array]:
        new = [k.decode("utf-8", "ignore") if c else t for t, k, c in zip(columns[at].to_pylist(), kept, cut, strict=True)]
        columns[at] = pa.array(new, pa.string())
        if count >= 0:
            chars = [len(t or "") if c else n for t, n, c in zip(new, columns[count].to_pylist(), cut, strict=True)]
            columns[count] = pa.array(chars, columns[count].type)
        return columns

    return suffixes.remove_repeats(docs, width=REPEAT_BYTES, rewrite=rewrite)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into sequences along the space-filling curve."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=SEQUENCE_TOKENS)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("suffix_array", suffix_stage),
    ("packing", packing_stage),
]

#: Classifiers are trained and suffixes sorted; SQL can't express these stages (tests/llm/test_pipeline.py compares them).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = write_table(result, f"stage-{name}")
            drop_table(docs)
            docs = written
    return packing.digests(result)
