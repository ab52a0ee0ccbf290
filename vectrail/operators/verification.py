"""Verification metrics over scored pairs: error rates, ROC, equal error rate, fixed operating points.

Blocks of vectors are scored and counted in one kernel. Curves are computed from counts by distinct
score; running totals go in two steps (within score bins, then over the bins' totals), so no task
sees all scores. Error rates at fixed points need no curve: a histogram and the scores of few bins do.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import scoring
from . import blocks

#: Bins of the running totals; of scores of nine digits a bin holds 2**17 at most.
BINS = 1 << 14


@dataclasses.dataclass
class Scored:
    """Scored pairs that are counted where they are scored: only counters leave the kernels.

    apply(kernel, fields) calls kernel(score, is_genuine, i, j) with flat arrays of the pairs of two
    blocks, and gives its columns (``fields``, as DDL) with the columns ``keys``.

    tally(counter) counts in the tasks: each makes counter() = (add, finish), calls add(keys, q, c, below,
    own) with two blocks whose pairs count for each of the keys (below: only those of q's item below
    c's; own() counts the items that meet themselves), and finish() gives (key, place, gen, imp) once a key. What
    is counted at the thresholds ``cuts`` needs no pass of its own.
    """

    apply: Callable[[Callable[..., dict[str, np.ndarray]], str], DataFrame]
    keys: list[str]
    tally: Callable[[Callable], DataFrame]
    cuts: tuple[float, ...] = ()
    #: Without the histogram: all pairs of a key count at place 0, which is enough for totals() and for rates() at the cuts.
    histogram: bool = True
    _bins: DataFrame | None = None
    #: ranged(tasks, work, schema): work(k, pairs) in tasks that each score all pairs; pairs() gives (q, c, below) of two blocks at a time.
    ranged: Callable[[int, Callable, str], DataFrame] | None = None
    #: tasks(counter, fields): tally, with these columns (DDL) in place of place, gen, imp; add() may give them too, before finish().
    tasks: Callable[[Callable, str], DataFrame] | None = None
    #: A pair's smaller id is i, of whichever side.
    unordered: bool = False

    def bins(self) -> DataFrame:
        """keys, place, gen, imp: a histogram of at most 2**14 bins; below 0 what reaches each of the cuts, and at OWN the items that meet themselves. Counted once."""
        if self._bins is None:
            cuts = self.cuts
            reached = [_at_least(t) for t in cuts]
            coarse = COARSE if self.histogram else 1
            histogram = self.histogram

            def counter():
                held: dict[tuple, np.ndarray] = {}

                def count(keys, n):
                    for key in keys:
                        if key in held:
                            held[key] += n
                        else:
                            held[key] = n.copy()

                def add(keys, q, c, below, own):
                    if not len(q["unit"]) or not len(c["unit"]):
                        return
                    n = np.zeros((2, len(cuts) + 1 + coarse), np.int64)
                    n[0, len(cuts)] = own()
                    if not histogram:
                        found = _reaching(q, c, below, reached)
                        found[1] -= found[0]
                        n[:, : len(cuts)], n[:, -1] = found[:, :-1], found[:, -1]
                        count(keys, n)
                        return
                    every, gen = n[1, len(cuts) + 1 :], []
                    equal = None if below else _equal(q, c)
                    held_bins = np.empty(CHUNK + len(c["unit"]), np.intp)
                    for s, x, genuine in _slabs(q, c, below):
                        for k, least in enumerate(reached):
                            at = np.flatnonzero(x >= least)
                            n[1, k] += len(at)
                            n[0, k] += np.count_nonzero(genuine(at))
                        x += MIDDLE
                        bins = held_bins[: len(x)]
                        np.copyto(bins, x, casting="unsafe")
                        every += np.bincount(bins, minlength=COARSE)
                        if below:
                            gen.append(bins[genuine(np.arange(len(x)))])
                        else:
                            first = s * len(c["unit"])
                            low, high = np.searchsorted(equal, [first, first + len(x)])
                            gen.append(bins[equal[low:high] - first])
                    n[0, len(cuts) + 1 :] = np.bincount(np.concatenate(gen), minlength=COARSE)
                    n[1, : len(cuts)] -= n[0, : len(cuts)]
                    every -= n[0, len(cuts) + 1 :]
                    count(keys, n)

                def finish():
                    place = np.concatenate([-1 - np.arange(len(cuts)), [OWN], np.arange(coarse)])
                    for key, n in held.items():
                        some = np.flatnonzero((n != 0).any(axis=0) | (place < 0))
                        yield key, place[some], n[0, some], n[1, some]

                return add, finish

            found = self.tally(counter).groupBy(*self.keys, "place").agg(F.sum("gen").alias("gen"), F.sum("imp").alias("imp"))
            # a bounded number of counters a key of the configuration
            self._bins = found.sparkSession.createDataFrame(found.toArrow(), found.schema)
        return self._bins

    def rows(self) -> DataFrame:
        """keys, i, j, score, is_genuine: every pair. They leave a task in runs in the order of their scores, of which columnar files store each but once or so."""
        return self.tasks(partial(_runs, self.unordered), ROWS)

    def in_band(self, low: float, high: float) -> DataFrame:
        """keys, i, j, score, is_genuine of the pairs with low <= score <= high."""

        def kernel(score, genuine, i, j):
            own = (score >= low) & (score <= high)
            return {"i": i[own], "j": j[own], "score": score[own], "is_genuine": genuine[own]}

        return self.apply(kernel, "i long, j long, score double, is_genuine boolean")

    def counts(self) -> DataFrame:
        """keys, score, gen, imp: genuine and impostor pairs of each distinct score."""

        def kernel(score, genuine, i, j):
            place, n = np.unique(_place(score * SCALE) * 2 + genuine, return_counts=True)
            return {"place": place >> 1, "gen": n * (place & 1), "imp": n * (1 - (place & 1))}

        found = self.apply(kernel, "place long, gen long, imp long").groupBy(*self.keys, "place").agg(F.sum("gen").alias("gen"), F.sum("imp").alias("imp"))
        return found.select(*self.keys, ((F.col("place") - PLACES) / F.lit(float(PLACES))).alias("score"), "gen", "imp")

    def totals(self) -> DataFrame:
        """keys, n_pairs, n_genuine, n_impostor, n_scored (items that meet themselves)."""

        n = F.col("gen") + F.col("imp")
        sums = {"n_pairs": F.when(F.col("place") >= 0, n), "n_genuine": F.when(F.col("place") >= 0, F.col("gen")), "n_scored": F.when(F.col("place") == OWN, F.col("gen"))}
        found = self.bins().groupBy(*self.keys).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(c) for c, x in sums.items()])
        return found.where("n_pairs > 0").select(*self.keys, "n_pairs", "n_genuine", (F.col("n_pairs") - F.col("n_genuine")).alias("n_impostor"), "n_scored")

    def rates(self, thresholds: list[float]) -> DataFrame:
        """keys, threshold, fmr, fnmr, as fmr_fnmr gives them: one counter for each stretch between thresholds."""
        if set(thresholds) <= set(self.cuts):
            whole = F.col("place") >= 0
            n_gen, n_imp = (F.sum(F.when(whole, F.col(c))) for c in ("gen", "imp"))
            found = []
            for t in thresholds:
                gen, imp = (F.coalesce(F.sum(F.when(F.col("place") == -1 - self.cuts.index(t), F.col(c))), F.lit(0)) for c in ("gen", "imp"))
                found.append(F.struct(F.lit(float(t)).alias("threshold"), (imp / F.nullif(n_imp, F.lit(0))).alias("fmr"), ((n_gen - gen) / F.nullif(n_gen, F.lit(0))).alias("fnmr")))
            return self.bins().groupBy(*self.keys).agg(F.array(*found).alias("at")).select(*self.keys, F.inline("at"))
        cuts = np.sort(np.asarray(thresholds, float))

        def kernel(score, genuine, i, j):
            n = np.bincount(np.searchsorted(cuts, score, side="right") * 2 + genuine, minlength=2 * len(cuts) + 2)
            return {"reached": np.arange(len(cuts) + 1), "gen": n[1::2], "imp": n[::2]}

        found = self.apply(kernel, "reached long, gen long, imp long").groupBy(*self.keys, "reached").agg(F.sum("gen").alias("gen"), F.sum("imp").alias("imp"))
        at = [F.struct(F.lit(float(t)).alias("threshold"), F.lit(int(np.searchsorted(cuts, t, side="left"))).alias("below")) for t in thresholds]
        each = found.select(*self.keys, "reached", "gen", "imp", F.inline(F.array(*at)))
        accepted = F.col("reached") > F.col("below")
        return each.groupBy(*self.keys, "threshold").agg(
            (F.sum(F.when(accepted, F.col("imp")).otherwise(0)) / F.nullif(F.sum("imp"), F.lit(0))).alias("fmr"),
            (F.sum(F.when(accepted, 0).otherwise(F.col("gen"))) / F.nullif(F.sum("gen"), F.lit(0))).alias("fnmr"),
        )

    def points(self) -> DataFrame:
        """keys, threshold, fmr, fnmr at every distinct score, and just above the largest.

        Where ranged is given, each task scores all pairs again and counts a range of scores, so that
        the scores, which are nearly as many as the pairs, are not exchanged; rows come by threshold.
        """
        return _curve(self.counts(), self.keys) if self.ranged is None else self._ranged_points()

    def _ranged_points(self) -> DataFrame:
        schema = "threshold double, fmr double, fnmr double"
        bins = sorted((r.place, r.gen, r.imp) for r in self.bins().where("place >= 0").collect())
        n_gen, n_imp = sum(b[1] for b in bins), sum(b[2] for b in bins)
        if not bins:
            return _curve(self.counts(), [])
        kind = np.uint32 if max(g + i for _, g, i in bins) < 1 << 32 else np.uint64
        most = RANGE_BYTES // (2 * np.dtype(kind).itemsize) >> FINE_BITS
        ranges, gen_before, imp_before = [], 0, 0  # first bin, bins, what lies below
        for b, gen, imp in bins:
            if not ranges or b >= ranges[-1][0] + most:
                ranges.append([b, 0, gen_before, imp_before])
            ranges[-1][1] = b + 1 - ranges[-1][0]
            gen_before, imp_before = gen_before + gen, imp_before + imp

        def work(k: int, pairs: Callable):
            first, width, gen_below, imp_below = ranges[k]
            base, places = first << FINE_BITS, width << FINE_BITS
            counts = _counted(pairs, base, places, kind)
            rate = lambda n, whole: pa.array(n / whole) if whole else pa.nulls(len(n), pa.float64())
            for s in range(0, places, 1 << 16):
                part = counts[:, s : s + (1 << 16)]
                some = np.flatnonzero(part.any(axis=0))
                if not len(some):
                    continue
                gen, imp = part[:, some].astype(np.int64)
                gen_upto, imp_upto = gen_below + np.cumsum(gen), imp_below + np.cumsum(imp)
                threshold = (base + s + some - PLACES) / float(PLACES)
                yield pa.RecordBatch.from_arrays([pa.array(threshold), rate(n_imp - imp_upto + imp, n_imp), rate(gen_upto - gen, n_gen)], ["threshold", "fmr", "fnmr"])
                gen_below, imp_below = int(gen_upto[-1]), int(imp_upto[-1])
            if k == len(ranges) - 1:
                yield blocks.batch(threshold=np.array([np.nextafter(threshold[-1], np.inf)]), fmr=np.array([0.0]), fnmr=np.array([1.0]))

        return self.ranged(len(ranges), work, schema)

    def plot_points(self, floor: float) -> DataFrame | None:
        """threshold, fmr, fnmr of points(), rates raised to the floor, by (fmr, fnmr) in the order of the partitions; None where that needs a sort.

        Each task scores all pairs again and counts a window of scores (see _windows), so that no
        point of the curve is exchanged.
        """
        bins = sorted((r.place, r.gen, r.imp) for r in self.bins().where("place >= 0").collect())
        n_gen, n_imp = sum(b[1] for b in bins), sum(b[2] for b in bins)
        if self.ranged is None or not n_gen or not n_imp or not 0 <= floor < 1:
            return None
        kind = np.uint32 if max(g + i for _, g, i in bins) < 1 << 32 else np.uint64
        windows = _windows(bins, floor, RANGE_BYTES // (2 * np.dtype(kind).itemsize) >> FINE_BITS)
        below = [(sum(g for b, g, _ in bins if b < w[0]), sum(i for b, _, i in bins if b < w[0])) for w in windows]

        def work(k: int, pairs: Callable):
            first, last, low, high, top = windows[k]
            base, places, one = first << FINE_BITS, (last + 1 - first) << FINE_BITS, 1 << FINE_BITS
            counts = _counted(pairs, base, places, kind)
            sums = [np.concatenate([[n], n + np.cumsum(c.reshape(-1, one).sum(axis=1, dtype=np.int64))]) for n, c in zip(below[k], counts, strict=True)]
            before = lambda side, at: int(sums[side][at // one] + counts[side, at // one * one : at].sum(dtype=np.int64))

            def edge(name: str, own: int) -> int:
                """Just after an impostor's place in the bin own."""
                c = counts[1, own * one : (own + 1) * one].astype(np.int64)
                some = np.flatnonzero(c)
                if name == "floor":  # the last whose rate is above the floor
                    some = some[(n_imp - before(1, own * one) - np.cumsum(c[some]) + c[some]) / n_imp > floor]
                return own * one + int(some[0 if name == "first" else -1]) + 1

            start = edge(low, 0) if low else 0
            end = places if not high else edge(high, 0 if high == "last" else last - first)
            rising = not low and high in ("", "first") or low in ("floor", "last")  # one rate of false matches throughout
            at = start if rising else end
            while start < end and (at < end if rising else at > start):
                if rising:
                    s, e = at, min(end, at + one)
                else:
                    s, e = max(start, at - one), at
                    while s > start and not counts[1, s - 1]:  # points of one rate stay together
                        found = np.flatnonzero(counts[1, max(start, s - one) : s])
                        s = max(start, s - one) + (int(found[-1]) + 1 if len(found) else 0)
                at = e if rising else s
                some = np.flatnonzero(counts[:, s:e].any(axis=0))
                gen, imp = counts[:, s:e][:, some].astype(np.int64)
                fmr = np.maximum((n_imp - before(1, s) - np.cumsum(imp) + imp) / n_imp, floor)
                fnmr = np.maximum((before(0, s) + np.cumsum(gen) - gen) / n_gen, floor)
                order = np.lexsort((fnmr, fmr))
                yield blocks.batch(threshold=((base + s + some - PLACES) / float(PLACES))[order], fmr=fmr[order], fnmr=fnmr[order])
            if top:
                largest = base + int(np.flatnonzero(counts.any(axis=0))[-1]) - PLACES
                yield blocks.batch(threshold=np.array([np.nextafter(largest / float(PLACES), np.inf)]), fmr=np.array([max(0.0, floor)]), fnmr=np.array([1.0]))

        return self.ranged(len(windows), work, "threshold double, fmr double, fnmr double")

    def operating_points(self, targets: list[float]) -> DataFrame:
        """keys, eer, fmr_at_fnmr_0, ...: as operating_points(points, targets), without the curve.

        A histogram of at most 2**14 bins tells between which scores each curve crosses; a second
        pass counts the scores of those bins alone, at most 2**17 each. Both are exact.
        """

        if not self.histogram:
            raise ValueError("operating points need the histogram")
        keys = self.keys
        bins = self.bins().where("place >= 0").withColumnRenamed("place", "bin")
        whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.select(
            *keys, "bin", F.coalesce(F.sum("gen").over(before), F.lit(0)).alias("gen_before"), F.coalesce(F.sum("imp").over(before), F.lit(0)).alias("imp_before"),
            F.sum("gen").over(whole).alias("n_gen"), F.sum("imp").over(whole).alias("n_imp"),
        )
        bins = bins.withColumn("fmr", (F.col("n_imp") - F.col("imp_before")) / F.nullif("n_imp", F.lit(0))).withColumn("fnmr", F.col("gen_before") / F.nullif("n_gen", F.lit(0)))
        reached = [F.col("fmr") <= F.col("fnmr"), *[F.col("fnmr") > F.lit(float(t)) for t in targets]]
        aggregates = []
        for n, r in enumerate(reached):  # the bin in which a curve crosses, and the first point after it
            aggregates.append(F.max(F.when(~r, F.struct("bin", "gen_before", "imp_before"))).alias(f"open_{n}"))
            aggregates.append(F.min(F.when(r, F.struct("bin", "fmr", "fnmr"))).alias(f"next_{n}"))
        # one row a key of the configuration
        states = [r.asDict(recursive=True) for r in bins.groupBy(*keys).agg(F.max("n_gen").alias("n_gen"), F.max("n_imp").alias("n_imp"), *aggregates).collect()]
        opened = {tuple(s[k] for k in keys): sorted({s[f"open_{n}"]["bin"] for n in range(len(reached)) if s[f"open_{n}"]}) for s in states}

        def fine():
            held: dict[tuple, np.ndarray] = {}

            def add(keys, q, c, below, own):
                wanted = {b: [k for k in keys if b in opened.get(k, [])] for b in {b for k in keys for b in opened.get(k, [])}}
                if not len(q["unit"]) or not len(c["unit"]) or not wanted:
                    return
                for _, x, genuine in _slabs(q, c, below):
                    for b, of in wanted.items():
                        low, high = _bounds(b << FINE_BITS, b + 1 << FINE_BITS)
                        at = np.flatnonzero((x >= low) & (x < high))
                        if len(at):
                            rows, place = 1 - genuine(at).astype(np.int64), _place(x[at]) - (b << FINE_BITS)
                            for key in of:
                                np.add.at(held.setdefault((key, b), np.zeros((2, 1 << FINE_BITS), np.int64)), (rows, place), 1)

            def finish():
                for (key, b), n in held.items():
                    some = np.flatnonzero((n != 0).any(axis=0))
                    yield key, some + (b << FINE_BITS), n[0, some], n[1, some]

            return add, finish

        found = self.tally(fine).groupBy(*keys, "place").agg(F.sum("gen").alias("gen"), F.sum("imp").alias("imp"))
        spark = found.sparkSession
        fields = ", ".join(f"{k} {found.schema[k].dataType.simpleString()}" for k in keys)
        rows = [
            (*[s[k] for k in keys], n, s["n_gen"], s["n_imp"], *((o["bin"], o["gen_before"], o["imp_before"]) if (o := s[f"open_{n}"]) else (None, None, None)), *((x["fmr"], x["fnmr"]) if (x := s[f"next_{n}"]) else (0.0, 1.0)))
            for s in states for n in range(len(reached))
        ]
        state = spark.createDataFrame(rows, (fields + ", " if fields else "") + "curve int, n_gen long, n_imp long, open long, gen_before long, imp_before long, next_fmr double, next_fnmr double")
        own = found.withColumn("open", F.shiftright("place", FINE_BITS))
        points = state.join(own, [*keys, "open"], "left")
        below = Window.partitionBy(*keys, "curve").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        points = points.withColumn("fmr", (F.col("n_imp") - F.col("imp_before") - F.coalesce(F.sum("imp").over(below), F.lit(0))) / F.nullif("n_imp", F.lit(0)))
        points = points.withColumn("fnmr", (F.col("gen_before") + F.coalesce(F.sum("gen").over(below), F.lit(0))) / F.nullif("n_gen", F.lit(0)))
        target = F.element_at(F.array(*[F.lit(float(t)) for t in (0.0, *targets)]), F.col("curve") + 1)
        crossed = F.when(F.col("curve") == 0, F.col("fmr") <= F.col("fnmr")).otherwise(F.col("fnmr") > target)
        point, after = F.struct(F.col("place").alias("threshold"), "fmr", "fnmr"), F.struct(F.lit(None).cast("long").alias("threshold"), F.col("next_fmr").alias("fmr"), F.col("next_fnmr").alias("fnmr"))
        ends = points.groupBy(*keys, "curve").agg(F.coalesce(F.min(F.when(crossed, point)), F.first(after)).alias("at"), F.max(F.when(~crossed, point)).alias("p"), F.max("n_gen").alias("n_gen"), F.max("n_imp").alias("n_imp"))
        usable = (F.col("n_gen") > 0) & (F.col("n_imp") > 0)
        values = ends.withColumn("value", F.when(usable, F.when(F.col("curve") == 0, _eer(F.col("at"), F.col("p"))).otherwise(_fixed(F.col("at"), F.col("p"), target))))
        named = ["eer", *[f"fmr_at_fnmr_{n}" for n in range(len(targets))]]
        return values.groupBy(*keys).agg(*[F.max(F.when(F.col("curve") == n, F.col("value"))).alias(name) for n, name in enumerate(named)])


#: Scores of nine digits have a place of 31 bits; the coarse histogram keeps the upper 14.
PLACES, FINE_BITS = 10**blocks.DIGITS, 17
COARSE = (2 * PLACES >> FINE_BITS) + 1
#: What the counters of a task's range of scores may take.
RANGE_BYTES = 192 << 20
#: Scores that are counted at once; the place of the items that meet themselves.
CHUNK, OWN = blocks.CHUNK, -1_000_000
#: Counters take scores as bins of the histogram, before they are rounded to a place; MIDDLE is the score 0, and half a place for rounding.
SCALE, MIDDLE = PLACES / (1 << FINE_BITS), (PLACES + 0.5) / (1 << FINE_BITS)


def _vectors(side: dict) -> np.ndarray:
    """The vectors as they came, where they are there."""
    return side.get("emb", side["unit"])


def _slabs(q: dict, c: dict, below: bool):
    """(first row, scores times SCALE, genuine) of a few rows of q against c at a time, flat; genuine(at) tells which of the pairs at these places are.

    The scores are overwritten by the next ones. Scores that are no number have place 0. Those halfway between places are set to their own.
    """
    a, b, p, r = q["unit"] * SCALE, c["unit"], q["persona_id"], c["persona_id"]
    odd = not (np.isfinite(a).all() and np.isfinite(b).all())
    left, right = _vectors(q), _vectors(c)
    rows = max(1, CHUNK // len(b))
    held, *spare = np.empty((3, min(rows, len(a)), len(b)))  # memory that is given back and taken again costs more than the product
    for s in range(0, len(a), rows):
        x = np.matmul(a[s : s + rows], b.T, out=held[: len(a[s : s + rows])])
        if odd:
            x[np.isnan(x)] = -SCALE
        blocks.settle(x, 1 << FINE_BITS, left[s : s + rows], right, spare)
        if below:
            i, j = np.nonzero(q["item_id"][s : s + rows, None] < c["item_id"][None, :])
            yield s, x[i, j], lambda at, i=i, j=j: p[s + i[at]] == r[j[at]]  # noqa: B023
        else:
            yield s, x.ravel(), lambda at: p[s + at // len(b)] == r[at % len(b)]  # noqa: B023


def _reaching(q: dict, c: dict, below: bool, reached: list[float]) -> np.ndarray:
    """Genuine pairs, and all pairs, of two blocks that reach each of the cuts (see _at_least), and at last of any score.

    A product in single precision decides all pairs but those within its error of a cut; these are scored as ever.
    """
    a, b, p, r = q["unit"], c["unit"], q["persona_id"], c["persona_id"]
    n = np.zeros((2, len(reached) + 1), np.int64)
    if below or not (np.isfinite(a).all() and np.isfinite(b).all()):
        for _, x, genuine in _slabs(q, c, below):
            for k, least in enumerate([*reached, -np.inf]):
                at = np.flatnonzero(x >= least)
                n[:, k] += np.count_nonzero(genuine(at)), len(at)
        return n
    n[:, -1] = len(_equal(q, c)), len(a) * len(b)
    spare = (a.shape[1] + 8) * 2.0**-23  # sums of products of vectors of length 1
    left, right = a.astype(np.float32), b.astype(np.float32).T
    rows = max(1, 2 * CHUNK // len(b))
    held = np.empty((min(rows, len(a)), len(b)), np.float32)
    for s in range(0, len(a), rows):
        x = np.matmul(left[s : s + rows], right, out=held[: len(left[s : s + rows])]).ravel()
        for k, least in enumerate(reached):
            at = np.flatnonzero(x >= np.float32(least / SCALE - spare))
            unsure = x[at] < np.float32(least / SCALE + spare)
            if unsure.any():
                i, j = np.divmod(at[unsure], len(b))
                few = len(i) < len(x) // 16
                exact = np.einsum("ij,ij->i", a[s + i] * SCALE, b[j]) if few else ((a[s : s + rows] * SCALE) @ b.T)[i, j]
                own = blocks.halfway(exact * (1 << FINE_BITS), a.shape[1])
                exact[own] = blocks.digits(_vectors(q)[s + i[own]], _vectors(c)[j[own]]) / (1 << FINE_BITS)
                passed = np.ones(len(at), bool)
                passed[unsure] = exact >= least
                at = at[passed]
            n[:, k] += np.count_nonzero(p[s + at // len(b)] == r[at % len(b)]), len(at)
    return n


def _equal(q: dict, c: dict) -> np.ndarray:
    """Places of the genuine pairs among all of two blocks, in order."""
    p, r = q["persona_id"], c["persona_id"]
    if p.dtype.kind not in "iu" or r.dtype.kind not in "iu":
        return np.flatnonzero(p[:, None] == r[None, :])
    order = np.argsort(r, kind="stable")
    low, high = (np.searchsorted(r[order], p, side) for side in ("left", "right"))
    n = high - low
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
    return np.repeat(np.arange(len(p)) * len(r), n) + order[nth]


def _place(x: np.ndarray) -> np.ndarray:
    """Places of scores times SCALE."""
    return np.clip(np.rint(x * (1 << FINE_BITS)).astype(np.int64) + PLACES, 0, 2 * PLACES)


def _counted(pairs: Callable, base: int, places: int, kind: type) -> np.ndarray:
    """Genuine and impostor pairs of each of so many places from base."""
    counts = np.zeros((2, places), kind)
    low, high = _bounds(base, base + places)
    for block in pairs():
        for _, x, genuine in _slabs(*block):
            at = np.flatnonzero((x >= low) & (x < high))
            place, g = _place(x[at]) - base, genuine(at)
            np.add.at(counts[0], place[g], 1)
            np.add.at(counts[1], place[~g], 1)
    return counts


def _windows(bins: list[tuple[int, int, int]], floor: float, most: int) -> list[tuple[int, int, str, str, bool]]:
    """(first bin, last bin, low, high, whether the point above the largest score follows) of the windows of scores, by rates.

    bins: (bin, genuine, impostors) of a histogram. A window begins after an impostor's place of its
    first bin (low: the first or the last one, or the last above the floor; none: with the bin), and ends
    with one of its last bin (high; 'last': of its first bin; none: with the bin), so that the points of
    one rate of false matches are in one window, or in several that rise with the threshold.
    """
    rest, impostors, split = sum(i for _, _, i in bins), [b for b, _, i in bins if i], 0
    n_imp = rest
    for b, _, imp in bins:  # the bin in which the rate of false matches reaches the floor
        if imp and rest / n_imp > floor:
            split = b
        rest -= imp

    def rising(some: list[int]) -> list[tuple[int, int, str, str]]:
        out: list[list] = []
        for b in some:
            if not out or b >= out[-1][0] + most:
                out.append([b, b])
            out[-1][1] = b
        return [(a, z, "", "") for a, z in out]

    out = [(split, split, "floor", ""), *rising([b for b, _, _ in bins if b > split])]
    tops = len(out) - 1
    last, high = split, "floor"
    while True:
        first = next(b for b in impostors if b > last - most)
        if first < last or high == "floor":
            out.append((first, last, "first", high))
        elif last > impostors[0]:  # no impostor for longer than a window
            first = max(b for b in impostors if b < last)
            out += [(first, first, "last", ""), *rising([b for b, _, _ in bins if first < b < last]), (last, last, "", "first"), (first, first, "first", "last")]
        else:
            break
        last, high = first, "first"
    out += [*rising([b for b, _, _ in bins if b < last]), (last, last, "", "first")]
    return [(*w, k == tops) for k, w in enumerate(out)]


def _bounds(first: int, end: int) -> tuple[float, float]:
    """Between which scores times SCALE the places from first up to end lie. Half a place to spare decides no score of nine digits."""
    at = lambda place: (place - PLACES - 0.5) / (1 << FINE_BITS)
    return -np.inf if first <= 0 else at(first), np.inf if end > 2 * PLACES else at(end)


def _at_least(threshold: float) -> float:
    """From where scores times SCALE reach a threshold, as nine digits."""
    place = math.floor(threshold * PLACES) - 1
    while place / PLACES < threshold:
        place += 1
    return (place - 0.5) / (1 << FINE_BITS)


def _counting(counter: Callable, kinds: list[pa.DataType], pairs_of: Callable, fields: str) -> Callable:
    """A counter of blocks.cosine_blocks from one of Scored.tasks; pairs_of(key, q, c, same) gives the (keys, q, c, below, own) of each part of two blocks' pairs."""
    names, types = zip(*[f.split() for f in fields.split(", ")], strict=True)
    types = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[t] for t in types]

    def make():
        add, finish = counter()

        def batches(found):
            for key, *columns in found:
                n = len(columns[0])
                keys = [pa.repeat(pa.scalar(k, t), n) for k, t in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(columns, types, strict=True)], *keys], [*names, *[f"k{k}" for k in range(len(key))]])

        def added(*block):
            for found in pairs_of(*block):
                yield from batches(add(*found) or ())

        return added, lambda: batches(finish())

    return make


COUNTS = "place long, gen long, imp long"
ROWS = "i long, j long, score double, is_genuine boolean"
#: Pairs that a task sorts at once, 8 bytes each, and that leave it at once; bits of a pair's place in its block of items, and of its query among those of a run.
RUN, SLICE, ITEM_BITS, QUERY_BITS = 1 << 24, 1 << 20, 12, 15
#: In place of a score's nine digits: no number, and the infinities (of vectors whose length is no number that a double can hold).
NAN, INF, LESS = (1 << 36) - 1, (1 << 36) - 2, -(1 << 36)


def _runs(unordered: bool):
    """A counter for Scored.tasks that gives every pair (ROWS) in runs of at most RUN, in the order of their scores.

    A pair is one whole number, its score's digits before its place, so that only these are held and sorted.
    """
    held: dict[tuple, list[tuple]] = {}
    taken = {"pairs": 0, "queries": 0}

    def flush():
        for keys in list(held):
            parts = held.pop(keys)
            q, c = ({k: np.concatenate([p[side][k] for p in parts]) for k in ("item_id", "persona_id")} for side in (1, 2))
            lengths = [len(p[2]["item_id"]) for p in parts]
            first = np.repeat(np.cumsum(lengths) - lengths, [len(p[1]["item_id"]) for p in parts])
            every, base, at = np.empty(sum(len(p[0]) for p in parts), np.int64), 0, 0
            parts.reverse()
            while parts:  # each is given back when it is copied
                found, queries, _ = parts.pop()
                np.add(found, base << ITEM_BITS, out=every[at : at + len(found)])
                at, base = at + len(found), base + len(queries["item_id"])
            del found
            every.sort()
            for s in range(0, len(every), SLICE):
                own = every[s : s + SLICE]
                x = (own >> ITEM_BITS) & ((1 << QUERY_BITS) - 1)
                y = first[x] + (own & ((1 << ITEM_BITS) - 1))
                own = own >> (ITEM_BITS + QUERY_BITS)
                score = own / PLACES
                for code, value in ((NAN, np.nan), (INF, np.inf), (LESS, -np.inf)):
                    if own[0] <= code <= own[-1]:
                        score[own == code] = value
                i, j = q["item_id"][x], c["item_id"][y]
                if unordered:
                    i, j = np.minimum(i, j), np.maximum(i, j)
                genuine = q["persona_id"][x] == c["persona_id"][y]
                for key in keys:
                    yield key, i, j, score, genuine
        taken.update(pairs=0, queries=0)

    def add(keys, q, c, below, own):
        scores = q["unit"] @ c["unit"].T
        scores *= PLACES
        blocks.settle(scores, 1, _vectors(q), _vectors(c))
        np.rint(scores, out=scores)
        if scores.size and not LESS < scores.min() <= scores.max() < INF:
            odd = [(test(scores), code) for test, code in ((np.isnan, NAN), (np.isposinf, INF), (np.isneginf, LESS))]
            np.clip(scores, LESS + 1, INF - 1, out=scores)
            for at, code in odd:
                scores[at] = code
        for s in range(0, len(q["unit"]), 1 << ITEM_BITS):
            for t in range(0, len(c["unit"]), 1 << ITEM_BITS):
                left, right = ({k: side[k][at : at + (1 << ITEM_BITS)] for k in ("item_id", "persona_id")} for side, at in ((q, s), (c, t)))
                n, m = len(left["item_id"]), len(right["item_id"])
                if held and (taken["pairs"] + n * m > RUN or taken["queries"] + n > 1 << QUERY_BITS):
                    yield from flush()
                found = scores[s : s + n, t : t + m].astype(np.int64)
                found <<= ITEM_BITS + QUERY_BITS
                found += (np.arange(n)[:, None] << ITEM_BITS) + np.arange(m)
                found = found[left["item_id"][:, None] < right["item_id"]] if below else found.ravel()
                if len(found):
                    held.setdefault(tuple(keys), []).append((found, left, right))
                    taken["pairs"] += len(found)
                    taken["queries"] += n

    return add, flush


def _met(q: dict, c: dict) -> int:
    """Items that meet themselves."""
    ids, n = np.unique(q["item_id"], return_counts=True)
    other, m = np.unique(c["item_id"], return_counts=True)
    _, x, y = np.intersect1d(ids, other, assume_unique=True, return_indices=True)
    return int((n[x] * m[y]).sum())


def _gated(key: tuple, q: dict, c: dict, left: np.ndarray, right: np.ndarray):
    """The parts of two blocks' pairs that count for (key, 'full') and, where both sides pass, also for (key, 'gated'): no pair is scored twice."""
    part = lambda side, rows: {k: v[rows] for k, v in side.items()}
    full, gated = (*key, "full"), (*key, "gated")
    if left.all() and right.all():
        yield [full, gated], q, c, False, partial(_met, q, c)
    elif not left.any() or not right.any():
        yield [full], q, c, False, partial(_met, q, c)
    else:
        passed, other = part(q, left), part(c, right)
        for keys, x, y in (([full, gated], passed, other), ([full], passed, part(c, ~right)), ([full], part(q, ~left), c)):
            yield keys, x, y, False, partial(_met, x, y)


def _subsets(kernel: Callable, scores: np.ndarray, q: dict, c: dict, left: np.ndarray | None, right: np.ndarray | None, **keys: float) -> pa.RecordBatch:
    """What the kernel gives of all pairs of two blocks, with the keys; and, if it is known who passes the gate, of the gated ones, with the column subset."""
    parts = []
    for name, rows, columns in [("full", np.arange(len(scores)), np.arange(scores.shape[1]))] + ([("gated", np.flatnonzero(left), np.flatnonzero(right))] if left is not None else []):
        sub = scores[np.ix_(rows, columns)]
        x, y = np.indices(sub.shape).reshape(2, -1)
        out = kernel(sub.ravel(), q["persona_id"][rows[x]] == c["persona_id"][columns[y]], q["item_id"][rows[x]], c["item_id"][columns[y]])
        n = len(next(iter(out.values())))
        out |= {k: np.full(n, v) for k, v in keys.items()}
        if left is not None:
            out["subset"] = np.full(n, name, "U5")
        parts.append(out)
    return blocks.batch(**{k: np.concatenate([p[k] for p in parts]) for k in parts[0]})


def all_pairs(items: DataFrame) -> Scored:
    """All unordered pairs i < j, in triangular blocks."""

    def apply(kernel, fields):
        def run(scores, q, c, same):
            chosen = (q["item_id"][:, None] < c["item_id"][None, :]) if same else np.ones(scores.shape, bool)
            x, y = np.nonzero(chosen)
            a, b = q["item_id"][x], c["item_id"][y]
            return blocks.batch(**kernel(scores[x, y], q["persona_id"][x] == c["persona_id"][y], np.minimum(a, b), np.maximum(a, b)))

        columns = ["item_id", "persona_id", "emb"]
        return blocks.cosine_blocks(items, items, run, fields, query_columns=columns, item_columns=columns, triangular=True)

    def pairs_of(key, q, c, same):
        yield [key], q, c, same, int

    def tasks(counter, fields):
        columns = ["item_id", "persona_id", "emb"]
        return blocks.cosine_blocks(items, items, None, fields, query_columns=columns, item_columns=columns, triangular=True, counter=_counting(counter, [], pairs_of, fields))

    def ranged(tasks, work, schema):
        return blocks.ranged(items, tasks, work, schema, ["item_id", "persona_id", "emb"])

    return Scored(apply, [], partial(tasks, fields=COUNTS), ranged=ranged, tasks=tasks, unordered=True)


def probes_and_gallery(probe: DataFrame, gallery: DataFrame, on: list[str] | None = None, least_quality: float | None = None) -> Scored:
    """Every probe against every gallery item of equal ``on`` columns, the item itself included.

    With least_quality (both sides have a quality) also under the key subset: 'full', and 'gated' where
    the quality of both items is at least that.
    """
    on = on or []
    columns = ["item_id", "persona_id", *(["quality"] if least_quality is not None else []), "emb"]
    kinds = "".join(f", {k} {probe.schema[k].dataType.simpleString()}" for k in on)

    def apply(kernel, fields):
        def run(scores, q, c, _):
            if least_quality is None:
                x, y = np.indices(scores.shape).reshape(2, -1)
                return blocks.batch(**kernel(scores.ravel(), q["persona_id"][x] == c["persona_id"][y], q["item_id"][x], c["item_id"][y]))
            return _subsets(kernel, scores, q, c, *[side["quality"] >= least_quality for side in (q, c)])

        subset = ", subset string" if least_quality is not None else ""
        return blocks.cosine_blocks(probe, gallery, run, fields + subset + kinds, query_columns=columns, item_columns=columns, on=on)

    def pairs_of(key, q, c, same):
        if least_quality is None:
            yield [key], q, c, False, partial(_met, q, c)
        else:
            yield from _gated(key, q, c, *[side["quality"] >= least_quality for side in (q, c)])

    def tasks(counter, fields):
        types, subset = [to_arrow_type(probe.schema[k].dataType) for k in on], ""
        if least_quality is not None:
            types, subset = [*types, pa.string()], ", subset string"
        return blocks.cosine_blocks(probe, gallery, None, fields + kinds + subset, query_columns=columns, item_columns=columns, on=on, counter=_counting(counter, types, pairs_of, fields))

    return Scored(apply, on if least_quality is None else [*on, "subset"], partial(tasks, fields=COUNTS), tasks=tasks)


def quantised_pairs(items: DataFrame, severities: list[float], least_quality: float | None = None) -> Scored:
    """Quantised probes (see quantised) against the clean vectors of the same items, under the key severity.

    With least_quality also under the key subset: 'full', and 'gated' where quality * (1 - severity)
    of both items is at least that. All severities are made in the kernel, from one exchange of the blocks.
    """

    def views(x: np.ndarray, side: str):
        out = []
        for s in severities:
            seen = x if s == 0 else np.floor(x / s + 0.5) * s
            kept = np.flatnonzero((seen != 0).any(axis=1))
            out.append((float(s), kept, (seen if side == "q" else x)[kept]))
        return out

    def apply(kernel, fields):
        def run(scores, q, c, _, severity):
            passed = [None, None] if least_quality is None else [side["quality"] * (1 - severity) >= least_quality for side in (q, c)]
            return _subsets(kernel, scores, q, c, *passed, severity=severity)

        columns = ["item_id", "persona_id", "emb"] if least_quality is None else ["item_id", "persona_id", "quality", "emb"]
        schema = fields + ", severity double" + (", subset string" if least_quality is not None else "")
        return blocks.cosine_blocks(items, items, run, schema, query_columns=columns, item_columns=columns, views=views)

    def pairs_of(key, q, c, same):
        if least_quality is None:
            yield [key], q, c, False, partial(_met, q, c)
            return
        yield from _gated(key, q, c, *[side["quality"] * (1 - key[0]) >= least_quality for side in (q, c)])

    def tasks(counter, fields):
        columns = ["item_id", "persona_id", *(["quality"] if least_quality is not None else []), "emb"]
        kinds, types = (", severity double, subset string", [pa.float64(), pa.string()]) if least_quality is not None else (", severity double", [pa.float64()])
        return blocks.cosine_blocks(items, items, None, fields + kinds, query_columns=columns, item_columns=columns, views=views, counter=_counting(counter, types, pairs_of, fields))

    return Scored(apply, ["severity"] if least_quality is None else ["severity", "subset"], partial(tasks, fields=COUNTS), tasks=tasks)


def seen_and_clean(items: DataFrame, ordinals: list[int], dim: int) -> Scored:
    """Vectors of each condition against the clean ones, under the key ordinal, from one exchange of the blocks.

    items: item_id, persona_id, seen (one vector of dim components a condition, null where there is none), clean.
    A condition's probes and gallery are the items that have both; the blocks stay persisted for the next pass.
    """
    none = F.lit([0.0] * dim)  # vectors aren't zero
    has = F.transform("seen", lambda v: F.when(v.isNull(), 0.0).otherwise(1.0))
    of_dim = lambda v: F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.lit("embeddings must be of one dimension")).cast("array<double>"))
    kept = items.where("clean IS NOT NULL")
    probes = kept.select("item_id", "persona_id", F.flatten(F.transform("seen", lambda v: F.when(v.isNull(), none).otherwise(of_dim(v)))).alias("emb"))
    gallery = kept.select("item_id", "persona_id", F.concat("clean", has).alias("emb"))
    columns, held, key = ["item_id", "persona_id", "emb"], {}, ", ordinal int"

    def views(x: np.ndarray, side: str):
        out = []
        for k in ordinals:
            own = x[:, k * dim : (k + 1) * dim] if side == "q" else x[:, :dim]
            rows = np.flatnonzero(own.any(axis=1) if side == "q" else x[:, dim + k])
            out.append((k, rows, own[rows]))
        return out

    def apply(kernel, fields):
        run = lambda scores, q, c, _, k: _subsets(kernel, scores, q, c, None, None, ordinal=np.int32(k))
        return blocks.cosine_blocks(probes, gallery, run, fields + key, query_columns=columns, item_columns=columns, views=views, held=held)

    def pairs_of(k, q, c, same):
        yield [k], q, c, False, partial(_met, q, c)

    def tasks(counter, fields):
        return blocks.cosine_blocks(probes, gallery, None, fields + key, query_columns=columns, item_columns=columns, views=views, counter=_counting(counter, [pa.int32()], pairs_of, fields), held=held)

    return Scored(apply, ["ordinal"], partial(tasks, fields=COUNTS), tasks=tasks)


def pair_scores(items: DataFrame) -> DataFrame:
    """i, j, score, is_genuine of all unordered pairs i < j."""
    return all_pairs(items).rows()


def probe_gallery_scores(probe: DataFrame, gallery: DataFrame, condition: str | None = None) -> DataFrame:
    """i, j, score, is_genuine (and the double column ``condition``) of every probe against every gallery item of its condition, the item itself included."""
    return probes_and_gallery(probe, gallery, [condition] if condition else None).rows()


def score_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, gen, imp: genuine and impostor pairs of each distinct score."""
    return pairs.groupBy(*keys, "score").agg(F.count_if("is_genuine").alias("gen"), F.count_if(~F.col("is_genuine")).alias("imp"))


def fmr_fnmr(pairs: DataFrame, thresholds: list[float], keys: list[str] | None = None) -> DataFrame:
    """fmr and fnmr at each threshold; a score equal to the threshold is accepted."""
    keys = keys or []
    counts = score_counts(pairs, keys)
    parts = []
    for k, t in enumerate(thresholds):
        accepted = F.col("score") >= F.lit(float(t))
        parts.append(F.struct(
            F.lit(float(t)).alias("threshold"),
            (F.sum(F.when(accepted, F.col("imp")).otherwise(0)) / F.nullif(F.sum("imp"), F.lit(0))).alias("fmr"),
            (F.sum(F.when(accepted, 0).otherwise(F.col("gen"))) / F.nullif(F.sum("gen"), F.lit(0))).alias("fnmr"),
        ).alias(f"t{k}"))
    one = counts.groupBy(*keys).agg(*parts)
    return one.select(*keys, F.inline(F.array(*[F.col(f"t{k}") for k in range(len(thresholds))])))


def roc(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, threshold, fmr, fnmr at every distinct score, and just above the largest."""
    return _curve(score_counts(pairs, keys or []), keys or [])


def _curve(counts: DataFrame, keys: list[str]) -> DataFrame:
    counts = counts.withColumn("bin", F.floor((F.col("score") + 1) * (BINS / 2)).cast("int"))
    bins = counts.groupBy(*keys, "bin").agg(F.sum("gen").alias("bin_gen"), F.sum("imp").alias("bin_imp"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        *keys, "bin", F.coalesce(F.sum("bin_gen").over(before), F.lit(0)).alias("gen_before"), F.coalesce(F.sum("bin_imp").over(before), F.lit(0)).alias("imp_before"),
        F.sum("bin_gen").over(by_key).alias("n_gen"), F.sum("bin_imp").over(by_key).alias("n_imp"),
    )
    within = Window.partitionBy(*keys, "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below_gen = F.coalesce(F.sum("gen").over(within), F.lit(0)) + F.col("gen_before")
    below_imp = F.coalesce(F.sum("imp").over(within), F.lit(0)) + F.col("imp_before")
    n_gen, n_imp = F.col("n_gen"), F.col("n_imp")
    own = F.struct(F.col("score").alias("threshold"), ((n_imp - below_imp) / F.nullif(n_imp, F.lit(0))).alias("fmr"), (below_gen / F.nullif(n_gen, F.lit(0))).alias("fnmr"))
    # the largest score also gives the point just above it
    above = F.struct(F.expr("java_method('java.lang.Math', 'nextUp', score)").cast("double").alias("threshold"), F.lit(0.0).alias("fmr"), F.lit(1.0).alias("fnmr"))
    last = (below_gen + F.col("gen") == n_gen) & (below_imp + F.col("imp") == n_imp)
    points = counts.join(bins, [*keys, "bin"]).select(*keys, F.when(last, F.array(own, above)).otherwise(F.array(own)).alias("points"))
    return points.select(*keys, F.inline("points"))


def _crossing(reached: Column, name: str) -> list[Column]:
    """Aggregates: the first point, by threshold, where ``reached`` holds (at), and the last where it doesn't (p)."""
    point = F.struct("threshold", "fmr", "fnmr")
    return [F.min(F.when(reached, point)).alias(f"{name}_at"), F.max(F.when(~reached, point)).alias(f"{name}_p")]


def _eer(at: Column, p: Column) -> Column:
    gap, last_gap = at["fmr"] - at["fnmr"], p["fmr"] - p["fnmr"]
    inside = p["fmr"] + last_gap / (last_gap - gap) * (at["fmr"] - p["fmr"])
    return F.when(at.isNull(), (p["fmr"] + p["fnmr"]) / 2).when(p.isNull(), (at["fmr"] + at["fnmr"]) / 2).otherwise(inside)


def _fixed(at: Column, p: Column, target: Column) -> Column:
    share = (target - p["fnmr"]) / (at["fnmr"] - p["fnmr"])
    return F.when(at.isNull(), p["fmr"]).when(p.isNull(), at["fmr"]).otherwise(p["fmr"] + share * (at["fmr"] - p["fmr"]))


def operating_points(points: DataFrame, targets: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, eer, and fmr_at_fnmr_0, _1, ... of the targets, in one pass over the points.

    eer: where the curves cross, interpolated; the mean of the rates where they don't. The false
    match rate falls and the false non-match rate rises with the threshold, so the points before
    the crossing are those where it has not been reached. fmr_at_fnmr: the false match rate where
    the false non-match rate reaches the target, interpolated past the last feasible point.
    """
    keys = keys or []
    aggregates = _crossing(F.col("fmr") <= F.col("fnmr"), "eer")
    for n, t in enumerate(targets):
        aggregates += _crossing(F.col("fnmr") > F.lit(t), f"f{n}")
    found = points.groupBy(*keys).agg(*aggregates)
    fixed = [_fixed(F.col(f"f{n}_at"), F.col(f"f{n}_p"), F.lit(float(t))).alias(f"fmr_at_fnmr_{n}") for n, t in enumerate(targets)]
    return found.select(*keys, _eer(F.col("eer_at"), F.col("eer_p")).alias("eer"), *fixed)


def eer(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, eer."""
    return operating_points(points, [], keys)


def fmr_at_fnmr(points: DataFrame, target: float, keys: list[str] | None = None) -> DataFrame:
    """keys, fmr_at_fnmr."""
    return operating_points(points, [target], keys).select(*(keys or []), F.col("fmr_at_fnmr_0").alias("fmr_at_fnmr"))


def check_pairs(pairs: DataFrame) -> None:
    """Raise unless all scores are finite and there are genuine and impostor pairs."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    r = pairs.agg(F.count_if(bad).alias("bad"), F.count_if("is_genuine").alias("gen"), F.count_if(~F.col("is_genuine")).alias("imp")).first()
    if r.bad or not r.gen or not r.imp:
        raise ValueError(f"{r.bad} scores are not finite; {r.gen} genuine and {r.imp} impostor pairs")


def quantised(items: DataFrame, severities: list[float]) -> DataFrame:
    """severity, item_id, persona_id, emb, clean: a degraded view where no pixels are, once a severity.

    Components are rounded to multiples of the severity (0 leaves them); all-zero vectors drop.
    """
    each = items.select("item_id", "persona_id", F.col("emb").alias("clean"), F.explode(F.array(*[F.lit(float(s)) for s in severities])).alias("severity"))
    degraded = F.transform("clean", lambda x: F.floor(x / F.col("severity") + 0.5).cast("double") * F.col("severity"))
    return each.withColumn("emb", F.when(F.col("severity") == 0, F.col("clean")).otherwise(degraded)).where(F.exists("emb", lambda x: x != 0))


def condition_pairs(items: DataFrame, severities: list[float]) -> DataFrame:
    """severity, i, j, score, is_genuine: degraded probes against the clean vectors of the same items."""
    return quantised_pairs(items, severities).rows()


def sweep(items: DataFrame, scored: Scored, severities: list[float], target: float = 0.01) -> DataFrame:
    """One row a severity: eer, fmr_at_fnmr (null where fewer than 2 items or identities are left) and counts."""
    metrics = scored.operating_points([target]).withColumnRenamed("fmr_at_fnmr_0", "fmr_at_fnmr")
    every = items.sparkSession.createDataFrame([(float(s),) for s in severities], "severity double")
    total = items.agg(F.count("*").alias("n_images"))
    out = every.crossJoin(F.broadcast(total)).join(scored.totals(), "severity", "left").join(metrics, "severity", "left")
    n_scored = F.coalesce("n_scored", F.lit(0))
    usable = (n_scored >= 2) & (F.col("n_impostor") > 0)
    return out.select(
        "severity", F.when(usable, F.col("eer")).alias("eer"), F.when(usable, F.col("fmr_at_fnmr")).alias("fmr_at_fnmr"), F.when(usable, F.col("n_pairs")).alias("n_pairs"),
        F.when(usable, F.col("n_genuine")).alias("n_genuine"), F.when(usable, F.col("n_impostor")).alias("n_impostor"), n_scored.alias("n_scored"), (F.col("n_images") - n_scored).alias("n_query_dropped"), "n_images",
    )


def gate_ablation(items: DataFrame, severities: list[float], least_quality: float, threshold: float, target: float = 0.01) -> DataFrame:
    """severity, subset (full, gated), n, pass_rate, n_pairs, n_genuine, n_impostor, fmr, fnmr, eer, fmr_at_fnmr.

    A subset of fewer than 2 items or identities has null metrics, and so has the gated subset of such a
    full one. Both subsets are always there.
    """
    scored = dataclasses.replace(quantised_pairs(items, severities, least_quality), cuts=(threshold,))
    metrics = scored.operating_points([target]).withColumnRenamed("fmr_at_fnmr_0", "fmr_at_fnmr")
    return _gate_table(scored, severities, threshold, metrics)


def gate_rates(items: DataFrame, severities: list[float], least_quality: float, threshold: float) -> DataFrame:
    """The columns of gate_ablation() up to fnmr: pairs are scored once, and only what reaches the threshold is counted."""
    return _gate_table(dataclasses.replace(quantised_pairs(items, severities, least_quality), cuts=(threshold,), histogram=False), severities, threshold)


def _gate_table(scored: Scored, severities: list[float], threshold: float, metrics: DataFrame | None = None) -> DataFrame:
    keys, columns = ["severity", "subset"], ["n_pairs", "n_genuine", "n_impostor", "fmr", "fnmr"]
    every = scored.bins().sparkSession.createDataFrame([(float(s), k) for s in severities for k in ("full", "gated")], "severity double, subset string")
    out = every.join(scored.totals(), keys, "left").join(scored.rates([threshold]).drop("threshold"), keys, "left")
    if metrics is not None:
        out, columns = out.join(metrics, keys, "left"), [*columns, *[c for c in metrics.columns if c not in keys]]
    out = out.withColumn("n", F.coalesce("n_scored", F.lit(0)))
    ok = (F.col("n") >= 2) & (F.col("n_impostor") > 0)
    by = Window.partitionBy("severity")
    full_ok = F.coalesce(F.max(F.when(F.col("subset") == "full", ok)).over(by), F.lit(False))
    n_full = F.max(F.when(F.col("subset") == "full", F.col("n"))).over(by)
    n = F.when((F.col("subset") == "full") | full_ok, F.col("n")).otherwise(0)
    rate = F.when(F.col("subset") == "full", 1.0).when(full_ok, F.col("n") / n_full).otherwise(0.0)
    return out.select("severity", "subset", n.alias("n"), rate.alias("pass_rate"), *[F.when(full_ok & ok, F.col(c)).alias(c) for c in columns])


def valid(items: DataFrame) -> DataFrame:
    return items.where(scoring.valid_vector(F.col("emb")))
