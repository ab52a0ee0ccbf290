"""Persona ranking: evidence, the four ranking methods, and their metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scorers import Scorer, rounded_context
from . import blocks
from .ordering import numbered, quantiles

CONTEXT = ["ts", "geo", "entities"]
METHODS = ["face", "fused", "selective", "tiebreak"]


def evidence(items: DataFrame, queries: DataFrame | None = None, query_vector: str = "emb") -> DataFrame:
    """q_id, q_persona, persona_id, face, and both sides' context (q_*, c_*).

    A persona's similarity to a query is the largest cosine of its items other than the query itself
    (ties: smallest item id), and its context is that item's. Queries whose own persona has no other
    item are left out. Each pair of blocks keeps one item a query and persona. Ids are whole numbers.
    """
    queries = items if queries is None else queries
    q = queries.select("item_id", "persona_id", F.col(query_vector).alias("emb"))

    def kernel(scores, q, c, _):
        scores = np.where(q["item_id"][:, None] == c["item_id"][None, :], -np.inf, scores)
        order = np.lexsort((c["item_id"], c["persona_id"]))
        ids, persona, s = c["item_id"][order], c["persona_id"][order], scores[:, order]
        start = np.flatnonzero(np.append(True, persona[1:] != persona[:-1])) if len(persona) else np.zeros(0, int)
        out = []
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(persona)], strict=True):
            best = s[:, a:b].argmax(axis=1)  # ids ascend, so the first is the smallest
            value = s[np.arange(len(s)), a + best]
            ok = np.flatnonzero(value > -np.inf)
            out.append((q["item_id"][ok], np.full(len(ok), persona[a]), value[ok], ids[a + best[ok]]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        return blocks.batch(q_id=cols[0], persona_id=cols[1].astype(np.int64), face=cols[2], item_id=cols[3])

    found = blocks.cosine_blocks(
        q.select("item_id", "emb"), items.select("item_id", F.col("persona_id").cast("long").alias("persona_id"), "emb"), kernel,
        "q_id long, persona_id long, face double, item_id long", query_columns=["item_id", "emb"], item_columns=["item_id", "persona_id", "emb"],
    )
    best = found.groupBy("q_id", "persona_id").agg(F.max(F.struct("face", (-F.col("item_id")).alias("neg"))).alias("x"))
    best = best.select("q_id", "persona_id", F.col("x.face").alias("face"), (-F.col("x.neg")).alias("item_id"))
    left = queries.select(F.col("item_id").alias("q_id"), F.col("persona_id").cast("long").alias("q_persona"), *[F.col(c).alias(f"q_{c}") for c in CONTEXT])
    right = items.select("item_id", *[F.col(c).alias(f"c_{c}") for c in CONTEXT])
    joined = best.join(left, "q_id").join(right, "item_id")
    own = F.max((F.col("persona_id") == F.col("q_persona")).cast("int")).over(Window.partitionBy("q_id"))
    return joined.withColumn("own", own).where("own = 1").drop("own")


def q_context(prefix: str = "q_") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in CONTEXT}


def ranked(ev: DataFrame, scorer: Scorer, gate: float, extra: list[str] | None = None) -> DataFrame:
    """Evidence with context, fused, gap and a rank for each method.

    face: by similarity; fused: by fused score; selective: fused where the gap between the two most
    similar personas is at most ``gate``, else face; tiebreak: face, but the first two change places
    where the gap is within the gate, the query has context, and the second's fused score is larger.
    Ties go to the smaller persona id.
    """
    keys = ["q_id", *(extra or [])]
    ev = ev.withColumn("context", rounded_context(scorer, q_context("q_"), q_context("c_")))
    ev = ev.withColumn("fused", F.round(scorer.fuse(F.col("face"), F.col("context")) + 3e-12, blocks.DIGITS))
    by = Window.partitionBy(*keys)
    ev = ev.withColumn("face_rank", F.row_number().over(by.orderBy(F.col("face").desc(), "persona_id")))
    ev = ev.withColumn("fused_rank", F.row_number().over(by.orderBy(F.col("fused").desc(), "persona_id")))

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("face_rank") == rank, F.col(column))).over(by)

    ev = ev.withColumn("gap", F.round(at(1, "face") - at(2, "face"), blocks.DIGITS))
    open_gate = F.coalesce(F.col("gap") <= gate, F.lit(False))
    swap = open_gate & scoring.has_context(q_context("q_")) & F.coalesce(at(2, "fused") > at(1, "fused"), F.lit(False))
    return ev.withColumn("selective_rank", F.when(open_gate, F.col("fused_rank")).otherwise(F.col("face_rank"))).withColumn(
        "tiebreak_rank", F.when(swap & (F.col("face_rank") <= 2), 3 - F.col("face_rank")).otherwise(F.col("face_rank"))
    )


def ranked_by(rows: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """rows with their rank by a score, ties to the smaller persona id."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), "persona_id")))


def true_ranks(ranks: DataFrame, methods: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """q_id, q_persona, gap, method, rank: the rank of the query's own persona."""
    methods = methods or METHODS
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_rank").alias("rank")) for m in methods]))
    return ranks.where("persona_id = q_persona").select("q_id", *(extra or []), "q_persona", "gap", each)


def metrics(ranks: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """keys, n, hit_at_1, hit_at_k, mrr."""
    share = lambda c: F.avg(c.cast("double"))
    return ranks.groupBy(*keys).agg(
        F.count("*").alias("n"), share(F.col("rank") <= 1).alias("hit_at_1"), share(F.col("rank") <= k).alias("hit_at_k"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr")
    )


def members_of(spark, sets: DataFrame | list[list]) -> DataFrame:
    """set_no, persona_id: near-tie sets given as lists of personas, or as a table with set_no and persona_ids."""
    if isinstance(sets, DataFrame):
        return sets.select("set_no", F.explode(F.array_distinct("persona_ids")).alias("persona_id"))
    kind = "string" if any(isinstance(p, str) for s in sets for p in s) else "bigint"
    return spark.createDataFrame([(n, p) for n, s in enumerate(sets) for p in dict.fromkeys(s)], f"set_no int, persona_id {kind}")


def set_of(members: DataFrame) -> DataFrame:
    """q_persona, set_no, set_key, candidates: the first set of each persona, its key 'a|b|...' and its personas."""
    first = members.groupBy("persona_id").agg(F.min("set_no").alias("set_no"))
    whole = members.groupBy("set_no").agg(F.array_sort(F.collect_set("persona_id")).alias("candidates"))
    key = F.array_join(F.col("candidates").cast("array<string>"), "|")
    return first.join(whole, "set_no").select(F.col("persona_id").alias("q_persona"), "set_no", key.alias("set_key"), "candidates")


def scoped(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows with set_no and set_key: the first near-tie set of the query's persona, or null."""
    return rows.join(set_of(members).drop("candidates"), "q_persona", "left")


def restricted(ev: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence with set_key, whose candidates are the personas of the query's near-tie set, where it has one."""
    told = ev.join(set_of(members), "q_persona", "left")
    return told.where(F.col("candidates").isNull() | F.array_contains("candidates", F.col("persona_id"))).drop("candidates")


def gap_slices(ranks: DataFrame, thresholds: list[float], k: int = 5, methods: list[str] | None = None) -> DataFrame:
    """gap_le, method, n and metrics of the queries whose gap is at most gap_le; empty slices stay, with nulls."""
    spark = ranks.sparkSession
    every = spark.createDataFrame([(float(t), m) for t in thresholds for m in methods or METHODS], "gap_le double, method string")
    inside = F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]).cast("array<double>"), lambda t: F.col("gap") <= t))
    got = metrics(ranks.where("gap IS NOT NULL").withColumn("gap_le", inside), ["gap_le", "method"], k)
    return every.join(got, ["gap_le", "method"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def gap_summary(ranks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n, mean_gap, median_gap. The median interpolates between the two middle gaps."""
    rows = ranks.where("method = 'face' AND gap IS NOT NULL")
    sums = rows.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"))
    middle = quantiles(rows, keys or [], "gap", {"median_gap": 0.5})
    return sums.join(middle, keys) if keys else sums.crossJoin(F.broadcast(middle))


def deltas(table: DataFrame, keys: list[str]) -> DataFrame:
    """Each method's metrics minus the face method's."""
    base = table.where("method = 'face'").select(*keys, *[F.col(m).alias(f"f_{m}") for m in ("hit_at_1", "hit_at_k", "mrr")])
    joined = table.where("method <> 'face'").join(base, keys) if keys else table.where("method <> 'face'").crossJoin(F.broadcast(base))
    return joined.select(*keys, "method", *[(F.col(m) - F.col(f"f_{m}")).alias(f"delta_{m}") for m in ("hit_at_1", "hit_at_k", "mrr")])


#: A prime below 2**20, and a power that permutes the numbers below it (it shares no factor with the prime less 1).
DRAWS = 1_000_003


def draw(item: Column, seed: int, stream: Column | int) -> Column:
    """A whole number below DRAWS from an item's number: the fifth power of a linear step, in integers that any engine has."""
    base = F.pmod(F.pmod(item, F.lit(DRAWS)) * F.lit(7919) + F.lit(seed % DRAWS) * F.lit(104_729) + F.lit(stream) * F.lit(15_485), F.lit(DRAWS))
    square = lambda x: (x * x) % F.lit(DRAWS)
    return (square(square(base)) * base) % F.lit(DRAWS)


def _number(ids: DataFrame) -> Column:
    """An item's number: itself, or a hash of it where ids are not whole numbers."""
    kind = ids.schema["q_id"].dataType.typeName()
    return F.col("q_id").cast("long") if kind in ("long", "integer", "short", "byte") else F.xxhash64("q_id")


def corrupted(ev: DataFrame, items: DataFrame, rates: list[float], kinds: list[str], seed: int = 0) -> DataFrame:
    """Evidence once a rate, with ``hit``, and the query's context corrupted where it is set: for that share of queries.

    The kind is drawn among ``kinds``. replace: the context of a donor, drawn among all items of other
    personas (of the first DRAWS, where there are more); drop: the entities go. Candidates' contexts stay.
    """
    number = _number(ev)
    rate = F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("rate")
    stream = F.round(F.col("rate") * 1000).cast("long")
    spread = ev.select("*", rate).withColumn("hit", draw(number, seed, stream) < F.col("rate") * DRAWS)
    which = F.element_at(F.array(*[F.lit(k) for k in kinds]), (draw(number, seed + 1, stream) % len(kinds) + 1).cast("int"))
    spread = spread.withColumn("kind", F.when(F.col("hit"), which))
    told = spread.join(donors(ev, items, rates, seed), ["q_id", "rate"], "left")
    swap = (F.col("kind") == "replace") & F.col("donor_id").isNotNull()
    for c in CONTEXT:
        told = told.withColumn(f"q_{c}", F.when(swap, F.col(f"d_{c}")).otherwise(F.col(f"q_{c}")))
    told = told.withColumn("q_entities", F.when(F.col("kind") == "drop", F.array().cast("array<string>")).otherwise(F.col("q_entities")))
    return told.drop("donor_id", "kind", *[f"d_{c}" for c in CONTEXT])


def donors(ev: DataFrame, items: DataFrame, rates: list[float], seed: int) -> DataFrame:
    """q_id, rate, donor_id and the donor's context.

    Items are numbered persona by persona, so those of other personas are all numbers but one
    stretch; a draw over them is one number, and the donor an equi-join away.
    """
    ordered = numbered(items.select("item_id", "persona_id", F.struct(F.col("persona_id").cast("string").alias("p"), "item_id").alias("by"), *CONTEXT), "by").drop("by")
    stretch = ordered.groupBy("persona_id").agg(F.min("place").alias("start"), F.count("*").alias("own"))
    total = ordered.agg(F.count("*").alias("total"))
    q = ev.select("q_id", F.col("q_persona").alias("persona_id")).distinct().select("*", F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("rate"))
    q = q.withColumn("persona_id", F.col("persona_id").cast(items.schema["persona_id"].dataType)).join(stretch, "persona_id").crossJoin(F.broadcast(total))
    others = F.col("total") - F.col("own")
    at = F.floor(draw(_number(q), seed + 2, F.round(F.col("rate") * 1000).cast("long")) * others / DRAWS).cast("long")
    q = q.where(others > 0).select("q_id", "rate", F.when(at < F.col("start"), at).otherwise(at + F.col("own")).alias("place"))
    return q.join(ordered.select("place", F.col("item_id").alias("donor_id"), *[F.col(c).alias(f"d_{c}") for c in CONTEXT]), "place").drop("place")
