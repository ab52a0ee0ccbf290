"""Persona centroids, the adaptive band, and near-tie sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from . import validation, verification
from .ordering import quantiles


def centroids(items: DataFrame, asset: str | None = None) -> DataFrame:
    """persona_id, n_items, emb: the mean of each persona's vectors (of distinct assets); zero means are dropped."""
    rows = items.dropDuplicates(["persona_id", asset]) if asset else items
    flat = rows.select("persona_id", F.posexplode("emb").alias("pos", "x"))
    means = flat.groupBy("persona_id", "pos").agg(F.round(F.avg("x"), 12).alias("x"), F.count("*").alias("n_items"))
    whole = means.groupBy("persona_id").agg(F.max("n_items").alias("n_items"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    out = whole.select("persona_id", "n_items", F.transform("v", lambda p: p["x"]).alias("emb"))
    return out.where(scoring.valid_vector(F.col("emb")))


def persona_pairs(centers: DataFrame) -> DataFrame:
    """i, j, score of all pairs of personas i < j."""
    rows = centers.select(F.col("persona_id").cast("long").alias("item_id"), F.col("persona_id").cast("long").alias("persona_id"), "emb")
    return verification.pair_scores(rows).select("i", "j", "score")


def adaptive_band(pairs: DataFrame, quantile: float) -> DataFrame:
    """low, high: the quantile of the cross-persona cosines, below 1, and 1."""
    low = quantiles(pairs, [], "score", {"low": quantile})
    return low.select(F.least("low", F.lit(1 - 1e-9)).alias("low"), F.lit(1.0).alias("high"))


def resolved_band(pairs: DataFrame, band: tuple[float, float] | None, quantile: float | None, default: tuple[float, float]) -> tuple[float, float]:
    """The band that is given, else the one of the quantile, else the default; checked."""
    if band is None and quantile is not None:
        r = adaptive_band(pairs, quantile).first()
        band = (r.low, r.high)
    return validation.checked_band(band or default)


def in_band_pairs(pairs: DataFrame, low: float, high: float) -> DataFrame:
    return pairs.where(scoring.in_band(F.col("score"), low, high))


#: Pairs that the greedy choice takes in one go; beyond, it goes in rounds in Spark until so few are left.
GREEDY_PAIRS = 200_000


def near_tie_sets(pairs: DataFrame, max_sets: int | None = None) -> DataFrame:
    """set_no, persona_ids, cosines: disjoint sets of two or three personas, greedily by cosine.

    Pairs (i, j, score) go by cosine (largest first), then ids; a pair of free personas makes a set,
    which takes the free third persona with the largest sum of its two cosines to the pair, if both are
    in the band. At most GREEDY_PAIRS pairs come to the driver: while there are more, all pairs that no
    earlier pair can touch are settled in Spark.
    """
    spark = pairs.sparkSession
    settled: list[tuple] = []
    left = pairs.select("i", "j", "score").persist()
    while left.count() > GREEDY_PAIRS:
        chosen = _settled(left)
        settled += [(r.score, list(r.members), list(r.cosines)) for r in chosen.collect()]
        gone = spark.createDataFrame([(p,) for _, members, _ in settled for p in members], "p long")
        before, left = left, left.join(gone, F.col("i") == F.col("p"), "left_anti").join(gone, F.col("j") == F.col("p"), "left_anti").persist()
        left.count()
        before.unpersist()
    settled += _greedy([(r.score, r.i, r.j) for r in left.collect()])
    left.unpersist()
    settled.sort(key=lambda s: (-s[0], _seed_pair(s)))
    rows = [(n, members, cosines) for n, (_, members, cosines) in enumerate(settled[:max_sets])]
    return spark.createDataFrame(rows, "set_no int, persona_ids array<bigint>, cosines array<double>")


def _seed_pair(found: tuple) -> tuple:
    """The pair that a set started from: its first pair of the set's largest cosine."""
    score, members, cosines = found
    every = [(a, b) for n, a in enumerate(members) for b in members[n + 1 :]]
    return next(p for p, c in zip(every, cosines, strict=True) if c == score)


def _greedy(rows: list[tuple]) -> list[tuple]:
    rows.sort(key=lambda r: (-r[0], r[1], r[2]))
    cosine = {(i, j): s for s, i, j in rows}
    partners: dict[int, list[int]] = {}
    for i, j in cosine:
        partners.setdefault(i, []).append(j)
        partners.setdefault(j, []).append(i)
    between = lambda a, b: cosine[min(a, b), max(a, b)]
    used: set[int] = set()
    out = []
    for score, i, j in rows:
        if i in used or j in used:
            continue
        thirds = [k for k in partners[i] if k not in used and k != j and (min(j, k), max(j, k)) in cosine]
        third = min(thirds, key=lambda k: (-(between(i, k) + between(j, k)), k), default=None)
        members = sorted([i, j] + ([third] if third is not None else []))
        used.update(members)
        out.append((score, members, [cosine[a, b] for n, a in enumerate(members) for b in members[n + 1 :]]))
    return out


def _settled(pairs: DataFrame) -> DataFrame:
    """score, members, cosines of the sets that the greedy choice makes whatever else it does.

    A pair is settled if it is the first of all pairs within three steps of its ends: no earlier pair
    can take one of its ends or its third.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("i").alias("i"), F.col("j").alias("j"))
    edges = pairs.select(F.col("i").alias("p"), F.col("j").alias("o"), order.alias("first")).union(pairs.select("j", "i", order)).persist()
    first = edges.groupBy("p").agg(F.min("first").alias("first"))
    for _ in range(2):  # the first pair of any neighbour, and of their neighbours
        near = edges.select("p", "o").join(first.select(F.col("p").alias("o"), "first"), "o").select("p", "first")
        first = near.union(first).groupBy("p").agg(F.min("first").alias("first"))
    both = first.select(F.col("p").alias("i"), F.col("first").alias("a")).join(pairs, "i").join(first.select(F.col("p").alias("j"), F.col("first").alias("b")), "j")
    top = both.where((F.col("a.i") == F.col("i")) & (F.col("a.j") == F.col("j")) & (F.col("b.i") == F.col("i")) & (F.col("b.j") == F.col("j"))).select("i", "j", "score")
    link = edges.select("p", F.col("o").alias("k"), (-F.col("first.s")).alias("c"))
    thirds = top.join(link.select(F.col("p").alias("i"), "k", F.col("c").alias("ci")), "i").join(link.select(F.col("p").alias("j"), "k", F.col("c").alias("cj")), ["j", "k"])
    third = thirds.groupBy("i", "j").agg(F.min(F.struct((-(F.col("ci") + F.col("cj"))).alias("s"), "k", "ci", "cj")).alias("t"))
    told = top.join(third, ["i", "j"], "left")
    members = F.array_sort(F.filter(F.array("i", "j", "t.k"), lambda x: x.isNotNull()))
    # the cosines in the order of the members: (first, second), (first, third), (second, third)
    k, ij, ik, jk = F.col("t.k"), F.col("score"), F.col("t.ci"), F.col("t.cj")
    cosines = F.when(k.isNull(), F.array(ij)).when(k > F.col("j"), F.array(ij, ik, jk)).when(k > F.col("i"), F.array(ik, ij, jk)).otherwise(F.array(ik, jk, ij))
    return told.select("score", members.alias("members"), cosines.alias("cosines"))


def shared_assets(media: DataFrame, asset: str, persona: str) -> DataFrame:
    """Assets that more than one persona owns."""
    return media.groupBy(asset).agg(F.count_distinct(persona).alias("n_personas")).where("n_personas > 1")


