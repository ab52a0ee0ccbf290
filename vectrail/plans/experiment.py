"""Degraded-input experiments on images: degrade, embed, drop what can't be embedded, score, gate.

The caller supplies the models, as functions of a stack of images [n, height, width, 3] (BGR bytes of
one size): embed gives a vector or None for each, quality a number for each. Both see every image of
a condition once: equal pixels are embedded once, whatever the number of their rows.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels, scoring
from ..operators import validation, verification

Embed = Callable[[np.ndarray], Sequence]
Quality = Callable[[np.ndarray], Sequence[float]]


def embedder(detect: Callable, extract: Callable) -> Embed:
    """An embed function from a detector (image -> observations with detection_score) and an extractor (image, observation -> vector).

    The best detection counts; an image without one has no embedding.
    """

    def embed(stack: np.ndarray) -> list:
        out = []
        for image in stack:
            found = detect(image)
            best = max(found, key=lambda o: o["detection_score"], default=None)
            out.append(None if best is None else extract(image, best))
        return out

    return embed


def detected_quality(detect: Callable) -> Quality:
    """A quality function from a detector: that of the best detection's box, 0 where there is none."""

    def quality(stack: np.ndarray) -> np.ndarray:
        out = np.zeros(len(stack))
        for i, image in enumerate(stack):
            best = max(detect(image), key=lambda o: o["detection_score"], default=None)
            if best is not None:
                given = best.get("quality")
                out[i] = given if given is not None else pixels.qualities(image[None], np.array([best["bbox"]]))[0]
        return out

    return quality


def whole_quality(stack: np.ndarray) -> np.ndarray:
    """Quality of the whole images."""
    return pixels.qualities(stack, np.tile([0, 0, stack.shape[2], stack.shape[1]], (len(stack), 1)))


def embedded(images: DataFrame, conditions: list[tuple[str, float]], embed: Embed, quality: Quality | None = None) -> DataFrame:
    """ordinal, condition, severity, item_id, persona_id, emb (null: can't be embedded), quality of every image under every condition, and clean, its vector under the clean condition, if that is among them.

    As embedded_once(), a row a condition.
    """
    return _by_condition(embedded_once(images, conditions, embed, quality), conditions)


def _by_condition(once: DataFrame, conditions: list[tuple[str, float]]) -> DataFrame:
    each = [F.struct(F.lit(k).alias("ordinal"), F.lit(name).alias("condition"), F.lit(float(severity)).alias("severity"), F.col("seen")[k].alias("emb"), F.col("qualities")[k].alias("quality")) for k, (name, severity) in enumerate(conditions)]
    return once.select("item_id", "persona_id", F.inline(F.array(*each)), "clean").select("item_id", "persona_id", "ordinal", "condition", "severity", "emb", "quality", "clean")


def _clean_at(conditions: list[tuple[str, float]]) -> int | None:
    return next((k for k, (name, _) in enumerate(conditions) if name == pixels.CLEAN), None)


def embedded_once(images: DataFrame, conditions: list[tuple[str, float]], embed: Embed, quality: Quality | None = None) -> DataFrame:
    """item_id, persona_id, seen (a vector a condition, null: can't be embedded), qualities, clean (that of the clean condition, if it is among them) of every image.

    images: item_id, label, height, width, data. Vectors must be finite, not zero and of one
    dimension, and qualities finite; anything else raises. An image is exchanged once for all
    conditions, and so is the row of all its vectors.
    """
    spark = images.sparkSession
    distinct = images.select(F.sha1("data").alias("sha"), "height", "width", "data").groupBy("sha", "height", "width").agg(F.first("data").alias("data"))
    # a given number of partitions: the time goes by images and conditions, not by the bytes that are exchanged
    work = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sha")
    first_clean = _clean_at(conditions)
    kind = pa.list_(pa.list_(pa.float64()))

    def vectors_of(seen: np.ndarray) -> list:
        found = list(embed(seen))
        if len(found) != len(seen):
            raise ValueError("embed must give a vector or None for each image")
        out: list = [None if v is None else np.asarray(v, np.float64) for v in found]
        if any(v is not None and (v.ndim != 1 or not v.size or not np.isfinite(v).all() or not v.any()) for v in out):
            raise ValueError("an embedding must be a finite vector that is not zero")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                height, width, data = (batch.column(i).to_pylist() for i in (1, 2, 3))
                vectors: list[list] = [[None] * batch.num_rows for _ in conditions]
                score = np.zeros((len(conditions), batch.num_rows))
                for rows, stack, _ in pixels.stacks(height, width, data):
                    for k, (name, severity) in enumerate(conditions):
                        seen = pixels.degraded(pixels.stack_of(stack), name, float(severity))
                        for i, v in zip(rows.tolist(), vectors_of(seen), strict=True):
                            vectors[k][i] = v
                        if quality is not None:
                            score[k, rows] = np.asarray(quality(seen), float)
                            if not np.isfinite(score[k, rows]).all():
                                raise ValueError("qualities must be finite")
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(zip(*vectors, strict=True)), kind), pa.array(score.T.tolist(), pa.list_(pa.float64()))], ["sha", "height", "width", "seen", "qualities"])

    made = work.mapInArrow(run, "sha string, height int, width int, seen array<array<double>>, qualities array<double>")
    ids = images.select("item_id", F.col("label").alias("persona_id"), F.sha1("data").alias("sha"), "height", "width")
    clean = F.lit(None).cast("array<double>") if first_clean is None else F.col("seen")[first_clean]
    return ids.join(made, ["sha", "height", "width"]).select("item_id", "persona_id", "seen", "qualities", clean.alias("clean"))


def aligned(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(probe, gallery, counts): probes of every condition that can be embedded and whose clean image can; the clean vectors beside them; drops.

    vectors: as embedded() gives them, the clean condition among them. counts: ordinal, n_images, n_gallery, n_scored.
    """
    both = vectors.where("emb IS NOT NULL AND clean IS NOT NULL")
    probe = both.select("ordinal", "item_id", "persona_id", "quality", "emb")
    gallery = both.select("ordinal", "item_id", "persona_id", "quality", F.col("clean").alias("emb"))
    clean = vectors.where((F.col("condition") == pixels.CLEAN) & F.col("emb").isNotNull())
    counts = vectors.groupBy("ordinal", "condition", "severity").agg(F.count("*").alias("n_images"))
    scored = probe.groupBy("ordinal").agg(F.count("*").alias("n_scored"), F.count_distinct("persona_id").alias("personas"))
    counts = counts.join(scored, "ordinal", "left").crossJoin(F.broadcast(clean.agg(F.count("*").alias("n_gallery"))))
    return probe, gallery, counts.withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))


def _vectors(images: DataFrame, conditions: Iterable[tuple[str, float]], include_clean: bool, embed: Embed, quality: Quality | None = None) -> tuple[DataFrame, bool, DataFrame, int]:
    """(vectors of all conditions and the clean one, whether the clean one was asked for, the persisted rows of embedded_once() that they are made of, dimension)."""
    validation.check_images(images)
    planned = validation.planned_conditions(conditions, include_clean)
    asked = any(n == pixels.CLEAN for n, _ in planned)
    every = planned if asked else [*planned, (pixels.CLEAN, 0.0)]
    once = embedded_once(images, every, embed, quality).persist()
    vectors = _by_condition(once, every)
    sizes = F.size("clean")
    r = once.where("clean IS NOT NULL").agg(F.count("*").alias("n"), F.count_distinct("persona_id").alias("p"), F.min(sizes).alias("least"), F.max(sizes).alias("dim")).first()
    if r.n < 2 or r.p < 2:
        raise ValueError(f"the gallery has {r.n} images of {r.p} identities that can be embedded; at least 2 of 2 are needed")
    if r.least != r.dim:
        raise ValueError("embeddings must be of one dimension")
    return vectors, asked, once, r.dim


def degraded_pairs(images: DataFrame, condition: tuple[str, float], embed: Embed) -> DataFrame:
    """i, j, score, is_genuine of the probes of one condition against the clean gallery; raises below 2 items of 2 identities."""
    vectors, *_ = _vectors(images, [condition], False, embed)
    probe, gallery, counts = aligned(vectors.where((F.col("condition") == pixels.CLEAN) | (F.col("ordinal") == 0)))
    r = counts.where("ordinal = 0").first()
    if r.n_scored < 2 or r.personas < 2:
        raise ValueError(f"only {r.n_scored} images of {r.personas or 0} identities can be scored")
    return verification.probe_gallery_scores(probe.where("ordinal = 0").drop("ordinal"), gallery.where("ordinal = 0").drop("ordinal"))


def sweep(images: DataFrame, conditions: Iterable[tuple[str, float]], embed: Embed, *, include_clean: bool = True, target: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(results, curve) of every condition, in one plan.

    results: ordinal, condition, severity, eer, fmr_at_fnmr, n_pairs, n_genuine, n_impostor (null below 2
    items of 2 identities), n_images, n_gallery, n_gallery_dropped, n_scored, n_query_dropped (images of the condition without an embedding, or whose clean image has none).
    curve: ordinal, threshold, fmr, fnmr.
    """
    vectors, asked, once, dim = _vectors(images, conditions, include_clean, embed)
    counts = aligned(vectors)[2].persist()
    usable = sorted(r.ordinal for r in counts.where("n_scored >= 2 AND personas >= 2").collect())  # one row a condition
    scored = verification.seen_and_clean(once, usable, dim)
    metrics = scored.operating_points([target]).withColumnRenamed("fmr_at_fnmr_0", "fmr_at_fnmr")
    out = counts.drop("personas").join(scored.totals().drop("n_scored"), "ordinal", "left").join(metrics, "ordinal", "left")
    out = out.withColumn("n_gallery_dropped", F.col("n_images") - F.col("n_gallery")).withColumn("n_query_dropped", F.col("n_images") - F.col("n_scored"))
    curve = scored.points()
    if not asked:
        out, curve = out.where(F.col("condition") != pixels.CLEAN), curve.join(counts.where(F.col("condition") != pixels.CLEAN).select("ordinal"), "ordinal", "left_semi")
    return out, curve


def gated(images: DataFrame, conditions: Iterable[tuple[str, float]], embed: Embed, quality: Quality, least_quality: float, *, threshold: float = 0.5, include_clean: bool = True, target: float = 0.01) -> DataFrame:
    """ordinal, condition, severity, subset (full, gated), n, pass_rate, n_dropped, n_pairs, n_genuine, n_impostor, fmr, fnmr, eer, fmr_at_fnmr.

    Probes of at least least_quality (of the degraded image) pass the gate, and the gallery is cut to
    the same items. Subsets below 2 items of 2 identities have null metrics.
    """
    if not math.isfinite(least_quality) or not math.isfinite(threshold):
        raise ValueError("thresholds must be finite")
    vectors, asked, *_ = _vectors(images, conditions, include_clean, embed, quality)
    probe, gallery, counts = aligned(vectors)
    subset = F.explode(F.when(F.col("quality") >= least_quality, F.array(F.lit("full"), F.lit("gated"))).otherwise(F.array(F.lit("full"))))
    keys = ["ordinal", "subset"]
    sizes = probe.withColumn("subset", subset).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("persona_id").alias("personas"))
    full_ok = sizes.where("subset = 'full' AND n >= 2 AND personas >= 2").select("ordinal", F.lit(True).alias("full_ok"))
    usable = sizes.where("n >= 2 AND personas >= 2").join(full_ok, "ordinal").select(*keys)
    asked_for = F.broadcast(usable.where("subset = 'full'").select("ordinal"))  # one row a condition; the gated set is part of the full one
    scored = verification.probes_and_gallery(*[t.join(asked_for, "ordinal", "left_semi") for t in (probe, gallery)], ["ordinal"], least_quality)
    scored = dataclasses.replace(scored, cuts=(threshold,))
    metrics = scored.operating_points([target]).withColumnRenamed("fmr_at_fnmr_0", "fmr_at_fnmr").join(scored.rates([threshold]).drop("threshold"), keys).join(scored.totals().drop("n_scored"), keys).join(usable, keys, "left_semi")
    every = counts.select("ordinal", "condition", "severity", "n_images", "n_scored").crossJoin(images.sparkSession.createDataFrame([("full",), ("gated",)], "subset string"))
    out = every.join(sizes.drop("personas"), keys, "left").join(full_ok, "ordinal", "left").join(metrics, keys, "left")
    full = F.col("subset") == "full"
    n = F.when(full | F.coalesce("full_ok", F.lit(False)), F.coalesce("n", F.lit(0))).otherwise(0)
    rate = F.when(full, 1.0).when(F.coalesce("full_ok", F.lit(False)), n / F.col("n_scored")).otherwise(0.0)
    out = out.select("ordinal", "condition", "severity", "subset", n.alias("n"), rate.alias("pass_rate"), (F.col("n_images") - F.col("n_scored")).alias("n_dropped"), "n_pairs", "n_genuine", "n_impostor", "fmr", "fnmr", "eer", "fmr_at_fnmr")
    return out if asked else out.where(F.col("condition") != pixels.CLEAN)


def read_images(rows: DataFrame) -> DataFrame:
    """item_id, label, height, width, data from rows of sources.tables.read_images (label, origin, image)."""
    return rows.select(F.col("origin").alias("item_id"), "label", F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.data").alias("data"))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.where(scoring.valid_vector(F.col("emb")))
