"""Candidate search shared by the two exact repeat removers.

Texts are sequences of symbols (bytes or words). Every window of ``width`` symbols has an anchor:
its leftmost ``gram``-symbol run of least hash, which depends on the window's content alone, so
equal windows have equal anchors. Consecutive windows with one anchor occurrence form a block, and
a block's hash covers all symbols of its windows and their place around the anchor. Blocks are
exchanged by anchor hash and sorted:
 - an anchor that occurs once proves that its windows do not repeat;
 - of the blocks of any other anchor, the first occurrences of each different one are opened: the
   operator compares their windows;
 - further occurrences are copies of an opened block: equal anchors, places and block hashes.
Copies are told apart within map batches already, so a block in a third of all documents reaches
its reducer a few times a batch, and reducers stream over sorted rows without holding a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, content_hash, mix64, prefix_hash, sliding_min, slices, window_hash, write_table

#: Symbolise a run of documents: raw bytes of each -> (values of all symbols, number of symbols of each, lanes and step of content_hash).
Symbols = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, int]]
BATCH_BYTES, SLICE_BYTES = 24 << 20, 384 << 10
LEAD, COPIED, COPY = 0, 1, 2  # kinds of rows: a lead, a lead with copies in its batch, a copy


def unique_rows(docs: DataFrame, id_col: str, text_col: str, *, carry: bool = False) -> tuple[DataFrame, bool]:
    """(doc, doc_id, text) with a unique doc that sorts as doc_id does.

    doc is doc_id itself if ids are unique and not null. Otherwise rows are numbered in the order
    (doc_id, text hash), null ids last, so that each row is a document of its own. With carry, all
    columns follow in the struct ``row``.
    """
    more = ["row"] if carry else []
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    bad = t.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count()
    if not bad:
        return t.select(F.col("doc_id").alias("doc"), "doc_id", "text", *more), True
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranged = t.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return write_table(ranged.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text", *more), "rows"), False


def blocks(values: np.ndarray, counts: np.ndarray, lanes: np.ndarray, step: int, width: int, gram: int):
    """Blocks of concatenated documents: (anchor hash, block hash, document index, first and last window start, anchor place).

    Places are relative to the block's document.
    """
    none = np.zeros(0, np.int64)
    reach = width - gram + 1
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(values)
    if n < width:
        return none.astype(U64), none.astype(U64), none, none, none, none
    h = mix64(window_hash(prefix_hash(values), gram))
    low = sliding_min(h, reach)
    # the last window start of each document; windows over a document's end are not valid
    doc_of_end = np.repeat(ends, np.maximum(counts, 0))[: len(low)]
    at = np.arange(len(low))
    valid = at + width <= doc_of_end
    change = np.empty(len(low), dtype=bool)
    change[0] = True
    change[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(low)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    out_p, out_lo, out_hi = [], [], []
    while len(first):
        place = np.empty(len(first), np.int64)
        for i in range(0, len(first), 20_000):
            f = first[i : i + 20_000]
            place[i : i + 20_000] = f + (h[f[:, None] + np.arange(reach)] == low[f][:, None]).argmax(axis=1)
        end = np.minimum(place, last)
        out_p.append(place), out_lo.append(first), out_hi.append(end)
        more = place < last
        first, last = place[more] + 1, last[more]
    if not out_p:
        return none.astype(U64), none.astype(U64), none, none, none, none
    p, lo, hi = (np.concatenate(x) for x in (out_p, out_lo, out_hi))
    doc = np.searchsorted(ends, lo, side="right")
    shape = ((p - lo).astype(U64) << U64(32)) | (hi - lo).astype(U64)
    block = mix64(content_hash(lanes, step, lo, hi + width) ^ mix64(shape))
    base = starts[doc]
    return h[p], block, doc, lo - base, hi - base, p - base


def merged(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [lo, end) intervals."""
    if not len(lo):
        return lo, end
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.append(True, lo[1:] > end[:-1])
    at = np.flatnonzero(new)
    return lo[at], end[np.append(at[1:], len(lo)) - 1]


def _spread(lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
    """lo, hi - lo and place - lo in one number that sorts as lo does."""
    return (lo << 32) | ((hi - lo) << 16) | (place - lo)


def candidates(rows: DataFrame, symbols: Symbols, width: int, gram: int, *, opened: int) -> DataFrame:
    """doc, lo, hi, place, anchor, block, copy: the windows that may repeat, by block.

    Windows start in [lo, hi], around the anchor's place. The first ``opened`` occurrences of each
    block have copy = false, all later ones true.
    """
    if width - gram + 1 > 60_000:
        raise ValueError("width is too large")

    def flush(found: list[tuple], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, c, d, lo, hi, place = (np.concatenate(x) for x in zip(*found, strict=True))
        d, at = ids[d], _spread(lo, hi, place)
        order = np.lexsort((at, d, c, a))
        a, c, d, at = a[order], c[order], d[order], at[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))) if len(a) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(a)))
        nth = np.arange(len(a)) - np.repeat(first, size)
        kind = np.where(nth >= opened, COPY, np.where(np.repeat(size, size) > opened, COPIED, LEAD)).astype(np.int8)
        # copies go anywhere, leads where their anchor belongs
        route = np.where(kind == COPY, mix64(d.astype(U64)), a).view(np.int64)
        for i in range(0, len(a), 50_000):
            s = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (route, kind, a.view(np.int64), c.view(np.int64), d, at)], ["route", "kind", "anchor", "block", "doc", "at"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, held, n = [], [], 0, 0
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for s, e in slices([len(t) for t in texts], SLICE_BYTES):
                part = texts[s:e]
                a, c, d, lo, hi, place = blocks(*symbols(part), width, gram)
                found.append((a, c, d + n, lo, hi, place))
                ids.append(docs[s:e])
                n += e - s
                held += sum(map(len, part))
                if held >= BATCH_BYTES:
                    yield from flush(found, np.concatenate(ids))
                    found, ids, held, n = [], [], 0, 0
        if found:
            yield from flush(found, np.concatenate(ids))

    def marks(kind: np.ndarray, a: np.ndarray, c: np.ndarray, d: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        lo = at >> 32
        fields = [d, lo, lo + ((at >> 16) & 0xFFFF), lo + (at & 0xFFFF), a, c]
        return pa.RecordBatch.from_arrays([*[pa.array(x) for x in fields], pa.array(kind == COPY)], ["doc", "lo", "hi", "place", "anchor", "block", "copy"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leads come sorted by anchor, block, doc and place. An anchor's first row waits for a second one."""
        held: list[np.ndarray] | None = None  # the row that waits
        live: int | None = None  # the anchor of the rows that were emitted last
        run, seen = None, 0  # the block of the last row, and its rows so far
        for batch in batches:
            kind, a, c, d, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            copies = kind == COPY
            if copies.any():
                yield marks(*(x[copies] for x in (kind, a, c, d, at)))
                kind, a, c, d, at = (x[~copies] for x in (kind, a, c, d, at))
            if held is not None and len(a):
                kind, a, c, d, at = (np.append(x, y) for x, y in zip(held, (kind, a, c, d, at), strict=True))
                held = None
            if not len(a):
                continue
            new = np.append(True, a[1:] != a[:-1])
            of = np.cumsum(new) - 1
            alive = np.bincount(of) > 1
            alive |= np.bincount(of, weights=kind == COPIED) > 0
            alive[0] |= live is not None and a[0] == live
            if not alive[-1]:
                held = [x[-1:] for x in (kind, a, c, d, at)]
            first = np.flatnonzero(new | np.append(True, c[1:] != c[:-1]))
            nth = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
            if run == (a[0], c[0]):
                nth[: first[1] if len(first) > 1 else len(a)] += seen
            out = alive[of]
            if alive[-1]:
                live, run, seen = a[-1], (a[-1], c[-1]), int(nth[-1]) + 1
            if out.any():
                yield marks(*(x[out] for x in (np.where(nth >= opened, COPY, LEAD), a, c, d, at)))

    sent = rows.select("doc", "text").mapInArrow(scan, "route long, kind byte, anchor long, block long, doc long, at long")
    dealt = sent.repartition("route").sortWithinPartitions(F.col("kind") == COPY, "anchor", "block", "doc", "at")
    return write_table(dealt.mapInArrow(judge, "doc long, lo long, hi long, place long, anchor long, block long, copy boolean"), "marks")


def sizes_of(rows: DataFrame, unit: int) -> int:
    """A number of groups that grows with the bytes of text: one for each ``unit`` of them, 128 at least."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(128, -(-total // unit))


def with_marks(texts: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """doc, text (null where there are no marks), and the marks.

    texts is (doc, text), joined from the left: the exchange below is the same as that of the last
    join, with all texts, so Spark reuses it and the texts are exchanged once.
    """
    return texts.join(listed, "doc", "left").select("doc", F.when(F.col(column).isNotNull(), F.col("text")).alias("text"), column)
