"""Blocked similarity kernels.

Vectors are packed into blocks of bounded size; each pair of a query block and an item block is one
row, scored by one matrix product. Pairs of blocks are never exchanged: the blocks of each side are
dealt to partitions, and each pair of partitions is a task, which reads the few blocks of both. Results
are reduced (top k, best in a group, counts by score) before they leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
DIGITS = 9
#: Least partitions of a side (if it has as many blocks), and the root of the block pairs that a task meets.
LEAST_PARTS, TASK_BLOCKS = 8, 6
#: What the blocks that a task keeps ready may take.
HELD = 96 << 20
#: Scores that are settled at once, so that what is made of them stays in the cache.
CHUNK = 1 << 16


def pack(df: DataFrame, columns: list[str], side: str, n: int, on: list[str]) -> DataFrame:
    """One row a block (and key ``on``): arrays of the columns; the first is the id, which deals rows to n blocks."""
    block = F.pmod(F.xxhash64(columns[0]), F.lit(n)).cast("int")
    fields = [F.collect_list(c).alias(f"{side}_{c}") for c in columns]
    return df.select(*on, block.alias("block"), *columns).groupBy(*on, "block").agg(*fields).withColumnRenamed("block", f"{side}_block")


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.values
    n = len(column)
    width = len(column.flatten()) // n if n else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, width) if flat is not None else np.zeros((0, 0))


#: views(matrix, side): (key, rows that are kept, their vectors) for each key, of the queries (side "q") or the items ("c"), whose columns may differ.
Views = Callable[[np.ndarray, str], list[tuple[float, np.ndarray, np.ndarray]]]


def unit(a: np.ndarray) -> np.ndarray:
    return a / np.sqrt((a * a).sum(axis=1))[:, None]


def halfway(digits: np.ndarray, dim: int, spare: np.ndarray | None = None) -> np.ndarray:
    """Which scores (flat, times 10**DIGITS; overwritten) of vectors of dim components are so near the middle of two whole numbers that the order of the sums decides. spare: memory of their size."""
    with np.errstate(invalid="ignore"):
        digits -= np.rint(digits, out=spare)
    return np.flatnonzero(np.abs(digits, out=digits) > 0.5 - 4 * (dim + 8) * 2.0**-53 * 10**DIGITS)


def _fused(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the products of the rows' components in their order; no product is rounded before it is added."""
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        total = 0.0
        for p, q in zip(x, y, strict=True):
            total = math.fma(p, q, total)
        out.append(total)
    return np.array(out)


def digits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b times 10**DIGITS, rounded, as the SQL has them: sums go by component, and what is halfway is rounded away from 0."""
    with np.errstate(over="ignore"):
        exact = (a == a.astype(np.float32)).all() and (b == b.astype(np.float32)).all()  # products of floats are doubles
    total = (lambda x, y: (x * y).cumsum(axis=1)[:, -1]) if exact else _fused
    x = np.clip(total(a, b) / np.sqrt(total(a, a) * total(b, b)), -1, 1) * 10.0**DIGITS
    whole = np.rint(x)
    return np.where(np.abs(x - whole) == 0.5, x + np.copysign(0.5, x), whole)


def settle(x: np.ndarray, scale: float, a: np.ndarray, b: np.ndarray, held: np.ndarray | None = None) -> None:
    """Set those of the scores of all a against all b (x; times scale they are times 10**DIGITS) that are halfway to the digits that the SQL rounds them to.

    The sums of a matrix product depend on the machine and on the places of the vectors in the blocks. held: memory for x twice, if it is of CHUNK scores at most.
    """
    if not x.size:
        return
    rows = max(1, CHUNK // x.shape[1])
    held = np.empty((2, min(rows, len(x)), x.shape[1])) if held is None else held
    for s in range(0, len(x), rows):
        part = x[s : s + rows]
        own, spare = (h[: len(part)].reshape(-1) for h in held)
        np.multiply(part, scale, out=own.reshape(part.shape))
        at = halfway(own, a.shape[1], spare)
        if len(at):
            i, j = np.divmod(at, x.shape[1])
            part[i, j] = digits(a[s + i], b[j]) / scale


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    scores = unit(a) @ unit(b).T
    scores *= 10.0**DIGITS
    settle(scores, 1, a, b)
    np.rint(scores, out=scores)
    scores /= 10.0**DIGITS
    return scores


class _Sides:
    """Blocks as they are made ready for the counters, kept for the next pairs of blocks of the task up to HELD bytes."""

    def __init__(self):
        self.held: dict[tuple, list] = {}
        self.bytes = 0

    def of(self, key: tuple, make: Callable[[], list]) -> list:
        if key not in self.held:
            made = make()
            self.bytes += _bytes(made)
            while self.held and self.bytes > HELD:
                self.bytes -= _bytes(self.held.pop(next(iter(self.held))))
            self.held[key] = made
        return self.held[key]


def _bytes(sides: list) -> int:
    return sum(v.nbytes for _, columns in sides for v in columns.values())


def _dealt(rows: int, keys: float) -> int:
    """Partitions of a side of so many blocks over so many keys, of which only equal ones meet."""
    return min(rows, max(LEAST_PARTS, math.ceil(rows / (TASK_BLOCKS * math.sqrt(keys)))))


def cosine_blocks(
    queries: DataFrame, items: DataFrame, kernel: Callable | None, schema: str, *, query_columns: list[str], item_columns: list[str], triangular: bool = False, on: list[str] | None = None, views: Views | None = None, counter: Callable | None = None, held: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Apply kernel(scores, q, c, same) to each pair of blocks; q and c map columns to arrays, scores are cosines rounded to 9 digits.

    The vector column is the last of each list. Zero vectors must have been filtered out. With
    triangular (both sides the same table) only block pairs in order are visited. Only blocks of
    equal ``on`` columns meet; these are named last in ``schema``. With views, the kernel is called
    once a key, as kernel(scores, q, c, same, key), with the queries as the view shows them against
    the items that it keeps: the blocks are exchanged once for all keys.

    held: the packed blocks of both sides are kept there (persisted) for the next call on the same sides.

    With counter instead of a kernel, each task makes counter() = (add, finish): add(key, q, c, same)
    takes each pair of blocks (key: the values of ``on``, or the view's key alone, as a tuple; q and c
    with their vectors as "emb" and, brought to length 1, as "unit"), and the batches of finish(), and of add() if it gives any, are all that leaves the task.
    """
    on = on or []
    blocks_of = lambda n: max(1, -(-n // BLOCK))
    if on:  # the blocks of a key are filled by its own rows
        found = items.groupBy(*on).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
        size, rows = blocks_of(found.most or 0), blocks_of(found.n or 0)
        n_left, left_rows = size, rows
    else:
        size = rows = blocks_of(items.count())
        n_left = left_rows = size if triangular else blocks_of(queries.count())
    left = pack(queries, query_columns, "q", n_left, on).repartition(_dealt(left_rows, left_rows / n_left))
    right = pack(items, item_columns, "c", size, on).repartition(_dealt(rows, rows / size))
    if held is not None:
        left, right = (held[k] if k in held else held.setdefault(k, side.persist()) for k, side in (("q", left), ("c", right)))
    right = right.hint("shuffle_replicate_nl")
    if on:
        pairs = left.join(right, on)
    else:
        pairs = left.join(right, F.col("q_block") <= F.col("c_block")) if triangular else left.crossJoin(right)
    names = [f"q_{c}" for c in query_columns] + [f"c_{c}" for c in item_columns] + ["q_block", "c_block"]

    keyed = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, finish = counter() if counter else (None, None)
        sides = _Sides()
        for batch in batches:
            for i in range(batch.num_rows):
                block = lambda n: batch.column(names.index(n))[i]  # noqa: B023, E731
                columns = lambda side, own: {c: block(f"{side}_{c}").values.to_numpy(zero_copy_only=False) for c in own[:-1]}  # noqa: B023, E731
                key = tuple(batch.column(keyed + k)[i].as_py() for k in range(len(on)))
                left_no, right_no = block("q_block").as_py(), block("c_block").as_py()
                same = left_no == right_no
                if counter:

                    def ready(side, own):
                        x, kept = _matrix(block(f"{side}_{own[-1]}").values), columns(side, own)  # noqa: B023
                        if not views:
                            return [((), kept | {"unit": unit(x), "emb": x})]
                        return [((k,), {c: v[rows] for c, v in kept.items()} | {"unit": unit(seen), "emb": seen}) for k, rows, seen in views(x, side)]

                    left_sides = sides.of(("q", left_no, *key), lambda: ready("q", query_columns))  # noqa: B023
                    right_sides = sides.of(("c", right_no, *key), lambda: ready("c", item_columns))  # noqa: B023
                    for (view, q), (_, c) in zip(left_sides, right_sides, strict=True):
                        yield from add(view or key, q, c, same) or ()
                    continue
                a, b = _matrix(block(names[len(query_columns) - 1]).values), _matrix(block(names[len(query_columns) + len(item_columns) - 1]).values)
                q, c = columns("q", query_columns), columns("c", item_columns)
                if views:
                    for (view, left_rows, seen), (_, right_rows, met) in zip(views(a, "q"), views(b, "c"), strict=True):
                        part = lambda side, rows: {k: v[rows] for k, v in side.items()}
                        yield kernel(cosines(seen, met), part(q, left_rows), part(c, right_rows), same, view)
                    continue
                out = kernel(cosines(a, b), q, c, same)
                for k, name in enumerate(on):
                    out = out.append_column(name, pa.array([key[k]] * out.num_rows, batch.column(keyed + k).type))
                yield out
        if counter:
            yield from finish()

    return pairs.select(*names, *on).mapInArrow(run, schema)


def ranged(items: DataFrame, tasks: int, work: Callable, schema: str, columns: list[str]) -> DataFrame:
    """work(k, pairs) for k = 0, 1, ..., one task each, in the order of the partitions: every task scores all unordered pairs and keeps its own share.

    pairs() gives (q, c, same), as for the counters of cosine_blocks, of each pair of blocks in order. A task holds all blocks, and
    nothing but the packed blocks is exchanged: for results that are as many as the pairs.
    """
    size = max(1, -(-items.count() // BLOCK))
    packed = pack(items, columns, "c", size, []).drop("c_block").repartition(1)
    every = items.sparkSession.range(0, tasks, 1, tasks).join(packed.hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: list[dict] = []
        mine = None
        for found in batches:
            for i in range(found.num_rows):
                mine = found.column(0)[i].as_py()
                own = {c: found.column(k + 1)[i].values for k, c in enumerate(columns)}
                x = _matrix(own[columns[-1]])
                sides.append({c: own[c].to_numpy(zero_copy_only=False).copy() for c in columns[:-1]} | {"unit": unit(x), "emb": x})

        def pairs():
            for i, q in enumerate(sides):
                for j in range(i, len(sides)):
                    yield q, sides[j], i == j

        if mine is not None:
            yield from work(mine, pairs)

    return every.select("id", *[f"c_{c}" for c in columns]).mapInArrow(run, schema)


def batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))
