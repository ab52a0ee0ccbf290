"""Embedding near-duplicates by NN-descent.

A neighbour graph over the distinct vectors of each label starts from random-hyperplane buckets and
is refined through neighbours-of-neighbours joins until it settles. Edges at or above the threshold
are links. A vector whose list is saturated (full of links), or that lies in a large component, is
compared exactly with every vector of its label that an angular bound cannot exclude, in blocks of
fixed size and across components; the others are compared exactly within their component. Recall of
links is audited against brute force; where it falls short, every vector is compared across components.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, write_table

BLOCK = 512
SLACK = 1e-6  # radians, beyond what rounding can move an angle
NONE = np.iinfo(np.int64).max
NEAR = pa.schema([("ball", pa.int64()), ("o_u", pa.list_(pa.int64())), ("o_copies", pa.list_(pa.int64())), ("o_vec", pa.list_(pa.binary())), ("o_asked", pa.list_(pa.bool_()))])


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """[n, dim] doubles of a column of vectors stored as bytes of doubles or floats."""
    blobs = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    raw = b"".join(blobs)
    kind = "<f8" if len(raw) == 8 * dim * len(blobs) else "<f4"
    return np.frombuffer(raw, kind).reshape(len(blobs), dim).astype(np.float64)


def _pack(rows: DataFrame, wide: bool) -> DataFrame:
    """vec_id, grp, dim, vec: vectors as bytes; those that can't be compared are left out."""
    kind = "<f8" if wide else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, blobs, dims = [], [], []
            for i, v in enumerate(batch.column(1)):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and len(v) else None
                if x is None or v.values.null_count or not np.isfinite(x).all() or not x.any() or not np.isfinite(x @ x) or x @ x == 0:
                    continue
                keep.append(i), blobs.append((x + 0.0).astype(kind).tobytes()), dims.append(len(x))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["vec_id", "label", "dim", "vec"])

    return rows.where("label IS NOT NULL AND vec_id IS NOT NULL").mapInArrow(run, "vec_id long, label string, dim int, vec binary")


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    return (a @ b.T) / (na[:, None] * nb[None, :])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted rows again, cut so that no run of equal keys spans two tables."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        values = table.column(key).to_numpy()
        last = int(np.searchsorted(values, values[-1])) if len(values) else 0
        rest = table.slice(last)
        if last:
            yield table.slice(0, last)
    if rest is not None and rest.num_rows:
        yield rest


def _seed(nodes: DataFrame, tables: int, bits: int, near: int, seed: int) -> DataFrame:
    """u, v candidates: nodes that follow each other when those of a label are sorted by random-hyperplane bits.

    A range sort cuts each table of bits into tasks of even size, so no bucket and no label is one
    task's; pairs over a cut are left to the other tables.
    """

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * (bits + 1)))
                z = (_vectors(part.column(3), dim) @ planes[dim]).reshape(part.num_rows, tables, bits + 1)
                code = ((z[:, :, :bits] > 0) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                n = part.num_rows
                each = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), part.column(1).take(each), pa.array(np.full(n * tables, dim, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(code.ravel()), pa.array(z[:, :, bits].ravel())],
                    ["u", "label", "dim", "tbl", "code", "along"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys = np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            own = np.empty(batch.num_rows, object)
            own[:] = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
            ids, keys = np.append(ids, batch.column(0).to_numpy()), np.append(keys, own)
            found = []
            for i in range(1, near + 1):
                # pairs within the rows kept from the last batch were found there
                first = max(0, len(ids) - batch.num_rows - i)
                x, y = ids[first : len(ids) - i], ids[first + i :]
                same = keys[first : len(ids) - i] == keys[first + i :]
                found.append((x[same], y[same]))
            u, v = (np.concatenate(z) for z in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(u, v)), pa.array(np.append(v, u))], ["u", "v"])
            ids, keys = ids[-near:], keys[-near:]

    coded = nodes.select("u", "label", "dim", "vec").mapInArrow(codes, "u long, label string, dim int, tbl int, code long, along double")
    order = ["tbl", "label", "dim", "code", "along", "u"]
    ranged = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("u", "label", "dim", "tbl").mapInArrow(follow, "u long, v long").distinct()


def _scored(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v, sim for pairs u, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                a, b = _vectors(part.column(3), dim), _vectors(part.column(4), dim)
                sim = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], ["u", "v", "sim"])

    a = nodes.select("u", "dim", F.col("vec").alias("a"))
    b = nodes.select(F.col("u").alias("v"), F.col("vec").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "dim", "a", "b").mapInArrow(run, "u long, v long, sim double")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node, and the similarity that a better neighbour must exceed (-2 while the list isn't full)."""
    top = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    whole = Window.partitionBy("u")
    kept = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k)
    least = F.when(F.count("*").over(whole) >= k, F.min("sim").over(whole)).otherwise(F.lit(-2.0))
    return kept.select("u", "v", "sim", least.alias("least"))


def _refine(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Neighbours of neighbours: around each node, all members of its list (forward, and nearest of those that list it) meet."""
    back = graph.select(F.col("v").alias("c"), F.col("u").alias("m"), "sim")
    back = back.withColumn("nth", F.row_number().over(Window.partitionBy("c").orderBy(F.col("sim").desc(), "m"))).where(F.col("nth") <= k).select("c", "m")
    around = graph.select(F.col("u").alias("c"), F.col("v").alias("m")).union(back).distinct()
    bound = graph.groupBy("u").agg(F.max("least").alias("least"))
    members = around.join(nodes.select(F.col("u").alias("m"), "dim", "vec"), "m").join(bound.withColumnRenamed("u", "m"), "m", "left")
    sorted_members = members.select("c", "m", "dim", "vec", F.coalesce("least", F.lit(-2.0)).alias("least")).repartition("c").sortWithinPartitions("c")

    def meet(ids: np.ndarray, x: np.ndarray, least: np.ndarray):
        sim = _cosines(x, x)
        np.fill_diagonal(sim, -3)
        if sim.shape[1] > k:
            cut = -np.partition(-sim, k - 1, axis=1)[:, k - 1]
            sim = np.where(sim >= cut[:, None], sim, -3)
        i, j = np.nonzero(sim > np.maximum(least, -2.5)[:, None])
        return ids[i], ids[j], sim[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "c"):
            c, m = table.column("c").to_numpy(), table.column("m").to_numpy()
            least, dims = table.column("least").to_numpy(), table.column("dim").to_numpy()
            vec = table.column("vec").to_pylist()
            cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            out = []
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(c)], strict=True):
                if e - s > 1:
                    out.append(meet(m[s:e], _vectors(vec[s:e], int(dims[s])), least[s:e]))
            if out:
                u, v, sim = (np.concatenate(x) for x in zip(*out, strict=True))
                for i in range(0, len(u), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (u, v, sim)], ["u", "v", "sim"])

    return sorted_members.mapInArrow(run, "u long, v long, sim double")


def _packs(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """label, dim and at most about ``most`` rows of equal label and dim in each array of ``columns``; no shuffle."""
    kinds = ", ".join(f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("label", "ascending"), ("dim", "ascending")])
            labels, dims = table.column("label").to_pylist(), table.column("dim").to_pylist()
            start = 0
            for i in range(1, len(labels) + 1):
                if i == len(labels) or i - start == most or (labels[i], dims[i]) != (labels[start], dims[start]):
                    part = [pa.array([table.column(c).slice(start, i - start).to_pylist()], pa.list_(table.schema.field(c).type)) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([labels[start]]), pa.array([dims[start]], pa.int32()), *part], ["label", "dim", *columns])
                    start = i

    return rows.select("label", "dim", *columns).mapInArrow(run, f"label string, dim int, {kinds}")


def _balls(asked: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Each asked node in one ball: ball (its leader's id), lead, reach, and arrays us, copies, vecs.

    asked: u, label, dim, vec, copies, component. A component of m asked nodes is dealt into
    ceil(m / BLOCK) parts, and each part into balls of the threshold's angle at most around a leader.
    Nothing outside ``reach`` of the leader links with a member, by the triangle inequality of angles.
    """
    angle = float(np.arccos(np.clip(threshold, -1, 1)))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = asked.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("u"), parts).cast("int"))

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("u")
        us, copies, vecs = group["u"].to_numpy(), group["copies"].to_numpy(), group["vec"].tolist()
        x = _vectors(vecs, int(group["dim"].iloc[0]))
        apart = np.arccos(np.clip(_cosines(x, x), -1, 1))
        left, out = np.arange(len(us)), []
        while len(left):
            near = apart[left[0], left] <= angle
            near[0] = True
            i, lead = left[near], left[0]
            out.append((us[lead], vecs[lead], apart[lead, i].max() + angle + SLACK, us[i].tolist(), copies[i].tolist(), [vecs[k] for k in i.tolist()]))
            left = left[~near]
        found = pd.DataFrame(out, columns=["ball", "lead", "reach", "us", "copies", "vecs"])
        return found.assign(label=group["label"].iloc[0], dim=int(group["dim"].iloc[0]))

    fields = "ball long, lead binary, reach double, us array<long>, copies array<long>, vecs array<binary>, label string, dim int"
    return dealt.select("component", "part", "u", "label", "dim", "vec", "copies").groupBy("component", "part").applyInPandas(deal, fields)


def _complete(asked: DataFrame, nodes: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """u, n, v: links of the asked nodes with any node of their label, exactly, summed by block.

    n adds up to the vectors linked with u (for a node not asked: the asked ones alone), and the
    pairs u, v join what is linked. Leaders meet all nodes of their label in blocks; only nodes
    within a ball's reach meet its members.
    """
    balls = write_table(_balls(asked.select("u", "label", "dim", "vec", "copies", "component"), sizes, threshold), "balls")
    leads = _packs(balls, ["ball", "lead", "reach"], BLOCK)
    others = nodes.join(asked.select("u", F.lit(True).alias("asked")), "u", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    others = _packs(others, ["u", "copies", "vec", "asked"], BLOCK)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = _vectors(r["vec"], r["dim"])
                apart = np.arccos(np.clip(_cosines(_vectors(r["lead"], r["dim"]), x), -1, 1))
                inside = apart <= np.array(r["reach"])[:, None]
                rows = []
                for b in np.flatnonzero(inside.any(axis=1)).tolist():
                    i = np.flatnonzero(inside[b]).tolist()
                    rows.append({"ball": r["ball"][b], **{f"o_{c}": [r[c][k] for k in i] for c in ("u", "copies", "vec", "asked")}})
                    if len(rows) == 16:
                        yield pa.RecordBatch.from_pylist(rows, NEAR)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, NEAR)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, ns, vs = [], [], []
            for r in batch.to_pylist():
                a, b, dim = np.array(r["us"]), np.array(r["o_u"]), r["dim"]
                link = (_cosines(_vectors(r["vecs"], dim), _vectors(r["o_vec"], dim)) >= threshold) & (a[:, None] != b[None, :])
                if not link.any():
                    continue
                to_a, to_b = a, b
                while True:  # the smallest id that is linked inside this pair of blocks
                    after_b = np.minimum(to_b, np.where(link, to_a[:, None], NONE).min(axis=0))
                    after_a = np.minimum(to_a, np.where(link, after_b[None, :], NONE).min(axis=1))
                    if (after_a == to_a).all() and (after_b == to_b).all():
                        break
                    to_a, to_b = after_a, after_b
                # an asked node's links are counted from its own ball
                back = np.where(np.array(r["o_asked"]), 0, np.array(r["copies"]) @ link)
                us += [a, b]
                ns += [link @ np.array(r["o_copies"]), back]
                vs += [to_a, to_b]
            if us:
                u, n, v = np.concatenate(us), np.concatenate(ns), np.concatenate(vs)
                # once for each u and v of the batch
                order = np.lexsort((v, u))
                u, n, v = u[order], n[order], v[order]
                cut = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
                u, n, v = u[cut], np.add.reduceat(n, cut), v[cut]
                on = (n > 0) | (u != v)
                yield pa.RecordBatch.from_arrays([pa.array(x[on], pa.int64()) for x in (u, n, v)], ["u", "n", "v"])

    reached = leads.join(others, ["label", "dim"]).mapInArrow(near, "ball long, o_u array<long>, o_copies array<long>, o_vec array<binary>, o_asked array<boolean>")
    return reached.join(balls.select("ball", "dim", "us", "copies", "vecs"), "ball").mapInArrow(meet, "u long, n long, v long")


def _within(members: DataFrame, threshold: float) -> DataFrame:
    """u, inner: vectors linked with each node among the other members of its component, which is of BLOCK nodes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "component"):
            c, u, copies, dims = (table.column(k).to_numpy() for k in ("component", "u", "copies", "dim"))
            vec = table.column("vec").to_pylist()
            inner = np.zeros(len(c), np.int64)
            cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(c)], strict=True):
                x = _vectors(vec[s:e], int(dims[s]))
                link = _cosines(x, x) >= threshold
                np.fill_diagonal(link, False)
                inner[s:e] = link @ copies[s:e]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(inner)], ["u", "inner"])

    return members.select("component", "u", "copies", "dim", "vec").repartition("component").sortWithinPartitions("component").mapInArrow(run, "u long, inner long")


def _counted(nodes: DataFrame, comp: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """label, dim, vec, u, copies, n_links, component_id of each node.

    Nodes in ``full`` and in components of more than BLOCK nodes meet all nodes of their label,
    the others those of their component.
    """
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    told = comp.join(sizes, "component").join(full.select("u", F.lit(True).alias("full")), "u", "left")
    told = write_table(nodes.join(told, "u").withColumn("asked", F.coalesce("full", F.lit(False)) | (F.col("size") > BLOCK)).drop("full"), "told")
    members = told.where("asked").drop("size", "asked")
    asked = members.select("u")
    exact = write_table(_complete(members.select("u", "label", "dim", "vec", "copies", "component"), nodes, members.groupBy("component").agg(F.count("*").alias("size")), threshold), "exact")
    of = lambda c: comp.select(F.col("u").alias(c), F.col("component").alias(f"{c}_c"))
    merged = exact.where("u <> v").select("u", "v").distinct().join(of("u"), "u").join(of("v"), "v").where("u_c <> v_c")
    merged = write_table(merged.select(F.least("u_c", "v_c").alias("u"), F.greatest("u_c", "v_c").alias("v")).distinct(), "merged")
    if not merged.isEmpty():
        top = components(merged).select(F.col("node").alias("component"), F.col("component").alias("top"))
        comp = comp.join(top, "component", "left").select("u", F.coalesce("top", "component").alias("component"))
    inner = _within(told.where("size > 1 AND NOT asked"), threshold)
    counts = exact.groupBy("u").agg(F.sum("n").alias("n"))
    n_links = F.coalesce("n", F.lit(0)) + F.coalesce("inner", F.lit(0)) + F.col("copies") - 1
    per_node = nodes.join(comp, "u").join(inner, "u", "left").join(counts, "u", "left")
    return write_table(per_node.select("label", "dim", "vec", "u", "copies", n_links.alias("n_links"), F.col("component").alias("component_id")), "per-node")


@dataclasses.dataclass
class NearDuplicates:
    rows: DataFrame  # vec_id, n_links, component_id, kept, link_recall
    recall: float | None  # of the audited vectors' links; None if they have none


def near_duplicates(
    vectors: DataFrame, *, threshold: float = 0.98, k: int = 10, tables: int = 10, rounds: int = 5, settle: float = 0.002, queries: int = 256, least_recall: float = 0.99,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 11,
) -> NearDuplicates:
    """Links between vectors of equal label with cosine >= threshold (double precision), and their components.

    One row a distinct vec_id: n_links (other ids linked directly), component_id (smallest id reachable),
    kept (vec_id = component_id), link_recall (of about ``queries`` audited vectors; null if they have no
    link). A recall below 0.9 raises. Rows whose vector is null, empty, zero, or has a null or non-finite
    component, and rows with a null label, link with nothing; vectors of different length are not
    compared. Rows that repeat an id count as one vector, the first in the order of label and bytes;
    rows without id are left out of the links and returned with nulls. An empty table gives an empty
    one; other columns are not read. Equal vectors are one node of the graph, so any number of exact
    copies costs one list.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    wide = "double" in vectors.schema[vector_col].dataType.simpleString()
    packed = _pack(source, wide).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vec")).alias("x")).select("vec_id", "x.*")
    packed = write_table(packed, "vectors")
    nodes = write_table(packed.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("u"), F.count("*").alias("copies")), "nodes")
    n = nodes.count()
    bits = int(np.clip(np.log2(max(n, 2)) - 4, 4, 24))
    graph = write_table(_best(_scored(_seed(nodes, tables, bits, 3, seed), nodes), k), "graph")
    total = graph.agg(F.sum("sim")).first()[0] or 0.0
    for _ in range(rounds):
        better = write_table(_best(graph.select("u", "v", "sim").union(_refine(graph, nodes, k)), k), "graph")
        graph, last, total = better, total, better.agg(F.sum("sim")).first()[0] or 0.0
        if total - last <= settle * abs(total):
            break
    linked = graph.where(F.col("sim") >= threshold)
    links = write_table(linked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    linked_comp = components(links).select(F.col("node").alias("u"), "component")
    comp = write_table(nodes.select("u").join(linked_comp, "u", "left").select("u", F.coalesce("component", "u").alias("component")), "comp")
    # a list full of links may miss some, in its component or in another
    full = graph.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("n")).where((F.col("low") >= threshold) & (F.col("n") >= k)).select("u")
    per_node = _counted(nodes, comp, full, threshold)
    recall = audit(per_node, threshold, queries, n)
    if recall is not None and recall < least_recall:
        per_node = _counted(nodes, comp, nodes.select("u"), threshold)
        recall = audit(per_node, threshold, queries, n)
    if recall is not None and recall < 0.9:
        raise RuntimeError(f"only {recall:.3f} of the audited links were found")
    found = packed.join(per_node, ["label", "dim", "vec"]).select("vec_id", "n_links", "component_id")
    ids = source.select("vec_id").distinct()
    rows = ids.join(found, "vec_id", "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
        F.lit(recall).cast("double").alias("link_recall"),
    )
    return NearDuplicates(rows, recall)


def audit(per_node: DataFrame, threshold: float, queries: int, n: int) -> float | None:
    """Share of the links that brute force finds for about ``queries`` nodes that their n_links holds; None without links."""
    chosen = per_node.where(F.pmod(F.xxhash64("u", F.lit(5)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, queries / max(1, n))))
    sample: dict[tuple, list] = {}
    for r in chosen.select("u", "label", "dim", "vec").collect():
        sample.setdefault((r.label, r.dim), []).append((r.u, bytes(r.vec)))
    groups = {key: (np.array([u for u, _ in rows]), _vectors([v for _, v in rows], key[1])) for key, rows in sample.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, dims, copies = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy(), batch.column(4).to_numpy()
            u, true = [], []
            for (label, dim), (asked, x) in groups.items():
                i = np.flatnonzero((labels == label) & (dims == dim))
                if len(i):
                    link = (_cosines(x, _vectors(batch.column(3).take(pa.array(i)), dim)) >= threshold) & (asked[:, None] != ids[i][None, :])
                    u.append(asked), true.append(link @ copies[i])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(true))], ["u", "true"])

    true = per_node.select("u", "label", "dim", "vec", "copies").mapInArrow(run, "u long, true long").groupBy("u").agg(F.sum("true").alias("true"))
    found = true.join(per_node.select("u", (F.col("n_links") - F.col("copies") + 1).alias("found")), "u")
    got = found.agg(F.sum("true").alias("n"), F.sum(F.least("true", "found")).alias("hit")).first()
    return got.hit / got.n if got.n else None
