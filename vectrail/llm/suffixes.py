"""Suffix-array removal of repeated byte strings.

A sparse suffix array over anchor places (see repeats): suffixes right of the anchors, and
reversed prefixes left of them, are sorted by a mergesort whose comparisons find the common
extension by binary search over prefix polynomial hashes. Runs of the sorted orders with a common
extension of r (right) and o (left) bytes are the equal strings of length o + r around an anchor.
Extensions of neighbours in the order are verified byte by byte, so a collision cannot pass there.

The array holds the first OPENED occurrences of each different block of bytes around an anchor.
Further occurrences (groups of more copies) share the place of those in the array: their anchors'
64-bit hashes and the 64-bit hashes of all their bytes (no polynomials) are equal, and their bytes
are not compared once more. Anchors with very many different blocks are split by the bytes that
all windows of a range of places around the anchor share.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_VALUE, byte_lanes, prefix_hash, range_hash
from .repeats import candidates, merged, sizes_of, unique_rows, with_marks

GRAM = 24
#: Occurrences of each block whose bytes are compared.
OPENED = 2
#: An anchor with more opened occurrences is split into so many ranges of places, and by what its windows share there.
HOT_ANCHOR, RANGES = 256, 8


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return BYTE_VALUE[raw], np.array([len(t) for t in texts], dtype=np.int64), byte_lanes(raw), 8


#: (columns of a batch, whether each text was cut, what is kept of it) -> columns.
Rewrite = Callable[[list[pa.Array], list[bool], list[bytes]], list[pa.Array]]


class SuffixSorter:
    """Sorts suffixes raw[start:end] within segments; start and end bound each suffix."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.prefix = prefix_hash(BYTE_VALUE[raw])

    def extension(self, a, b, most) -> np.ndarray:
        """Length of the common extension from places a and b, at most ``most``, by binary search over hashes."""
        low = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            ok = low + step <= most
            n = np.where(ok, step, 0)
            same = ok & (range_hash(self.prefix, a + low, a + low + n) == range_hash(self.prefix, b + low, b + low + n))
            low += np.where(same, step, 0)
            step >>= 1
        return low

    def less(self, a, a_end, b, b_end) -> np.ndarray:
        """Whether suffix a sorts before suffix b (a proper prefix sorts first)."""
        n, m = a_end - a, b_end - b
        common = self.extension(a, b, np.minimum(n, m))
        over = (common >= n) | (common >= m)
        top = len(self.raw) - 1
        x = self.raw[np.minimum(a + common, top)]
        y = self.raw[np.minimum(b + common, top)]
        return np.where(over, n < m, x < y)

    def sort(self, start: np.ndarray, end: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Stable order within segments (segment is sorted): a bottom-up mergesort of all segments at once."""
        n = len(start)
        order = np.arange(n)
        new = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if n else np.zeros(0, int)
        seg_lo = np.repeat(new, np.diff(np.append(new, n)))
        seg_hi = np.repeat(np.append(new[1:], n), np.diff(np.append(new, n)))
        width = 1
        longest = int((seg_hi - seg_lo).max(initial=0))
        while width < longest:
            i = np.flatnonzero(seg_hi - seg_lo > width)
            base = seg_lo[i] + (i - seg_lo[i]) // (2 * width) * (2 * width)
            middle = np.minimum(base + width, seg_hi[i])
            top = np.minimum(base + 2 * width, seg_hi[i])
            left = i < middle
            lo, hi = np.where(left, middle, base), np.where(left, top, middle)
            zero = lo.copy()
            own = order[i]
            while True:  # place among the other run: left runs count smaller ones, right runs smaller or equal ones
                act = np.flatnonzero(lo < hi)
                if not len(act):
                    break
                mid = (lo[act] + hi[act]) >> 1
                other, me = order[mid], own[act]
                x, y = np.where(left[act], other, me), np.where(left[act], me, other)
                below = self.less(start[x], end[x], start[y], end[y])
                up = np.where(left[act], below, ~below)
                lo[act] = np.where(up, mid + 1, lo[act])
                hi[act] = np.where(up, hi[act], mid)
            to = base + (i - np.where(left, base, middle)) + (lo - zero)
            merged_order = order.copy()
            merged_order[to] = own
            order = merged_order
            width *= 2
        return order

    def neighbours(self, order, start, end, segment) -> np.ndarray:
        """Verified common extension of each suffix with the one before it in the order; -1 at a segment's start."""
        out = np.full(len(order), -1, np.int64)
        same = np.flatnonzero(np.append(False, segment[order][1:] == segment[order][:-1])) if len(order) else np.zeros(0, int)
        a, b = order[same - 1], order[same]
        most = np.minimum(end[a] - start[a], end[b] - start[b])
        common = self.extension(start[a], start[b], most)
        for i in range(0, len(same), 50_000):  # collision check: the bytes themselves
            s = slice(i, i + 50_000)
            size = common[s]
            offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            bad = self.raw[np.repeat(start[a[s]], size) + offset] != self.raw[np.repeat(start[b[s]], size) + offset]
            if bad.any():
                row = np.repeat(np.arange(len(size)), size)[bad]
                first = np.full(len(size), np.iinfo(np.int64).max)
                np.minimum.at(first, row, offset[bad])
                common[s] = np.minimum(size, first)
        out[same] = common
        return out


def repeated_windows(raw, anchor, left, right, first, last, doc, place, width):
    """Which windows around anchors start earlier elsewhere.

    Occurrence i has ``left[i]`` bytes before and ``right[i]`` bytes from its anchor place in raw, at
    anchor[i]; its windows start first[i]..last[i] bytes before the anchor (first >= last). Occurrences
    are in segments of equal anchors, given in sorted order of ``doc`` and ``place`` in each segment.
    Returns (occurrence, bytes before the anchor) of the repeated windows.
    """
    segment = anchor["segment"]
    at = anchor["at"]
    n = len(at)
    forward = SuffixSorter(raw)
    order = forward.sort(at, at + right, segment)
    right_common = forward.neighbours(order, at, at + right, segment)
    backward = SuffixSorter(raw[::-1].copy())
    mirror = len(raw) - at
    back_order = backward.sort(mirror, mirror + left, segment)
    left_common = backward.neighbours(back_order, mirror, mirror + left, segment)
    found_i, found_o = [], []
    index = np.arange(n)
    for o in range(int(last.min(initial=0)), int(first.max(initial=-1)) + 1):
        act = (last <= o) & (o <= first)
        if act.sum() < 2:
            continue
        # equal right parts of width - o bytes and equal left parts of o bytes are runs of the orders
        rid, lid = np.empty(n, np.int64), np.empty(n, np.int64)
        rid[order] = np.maximum.accumulate(np.where(right_common < width - o, index, 0))
        lid[back_order] = np.maximum.accumulate(np.where(left_common < o, index, 0))
        i = np.flatnonzero(act)
        by = np.lexsort((place[i], doc[i], lid[i], rid[i]))
        i = i[by]
        r, left_id = rid[i], lid[i]
        again = np.append(False, (r[1:] == r[:-1]) & (left_id[1:] == left_id[:-1]))
        found_i.append(i[again]), found_o.append(np.full(int(again.sum()), o))
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_o)


def remove_repeats(docs: DataFrame, *, width: int = 100, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start; overlaps count, and
    strings are judged on the input. Columns: doc_id, n_bytes, spans (array of [start, end) of
    maximal removed runs), kept (binary). Null text counts as empty. Rows that repeat an id, and rows
    without id (which come last), are documents of their own, ordered by text hash. Texts shorter than
    the width keep all bytes. An empty table gives an empty one; other columns are not read.

    With rewrite, the result has the columns of docs instead: in the same pass over the texts,
    rewrite gets a batch's columns, which texts were cut, and what is kept of each, and gives the columns anew.
    """
    carry = rewrite is not None
    rows, plain = unique_rows(docs, id_col, text_col, carry=carry)
    gram = min(GRAM, width)
    reach = width - gram
    marks = candidates(rows, byte_symbols, width, gram, opened=OPENED)
    groups = sizes_of(rows, 1 << 19)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each opened block; of a hot anchor's block, those of each range of windows, under a key of what they share."""
        kinds = {"place": pa.int32(), "first": pa.int32(), "last": pa.int32(), "context": pa.binary()}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("key", "doc", "start", "place", "first", "last", "context")}
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                if not own.is_valid:
                    continue
                text = text.as_py()
                columns = (own.values.field(k).to_pylist() for k in ("lo", "hi", "place", "anchor", "hot"))
                for lo, hi, place, anchor, hot in zip(*columns, strict=True):
                    # windows start ``least`` to ``most`` bytes before the anchor
                    pieces = [(place - hi, place - lo, anchor)]
                    if hot:
                        pieces = []
                        for r in range(RANGES):
                            low, high = r * (reach + 1) // RANGES, (r + 1) * (reach + 1) // RANGES - 1
                            least, most = max(low, place - hi), min(high, place - lo)
                            if least <= most:
                                core = text[place - low : place + width - high]
                                pieces.append((least, most, int.from_bytes(hashlib.blake2b(core, digest_size=8, key=struct.pack("<qi", anchor, r)).digest(), "little", signed=True)))
                    for least, most, key in pieces:
                        out["key"].append(key), out["doc"].append(doc), out["start"].append(place - most)
                        out["place"].append(most), out["first"].append(most), out["last"].append(least)
                        out["context"].append(text[place - most : place - least + width])
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "doc", "start"], kind="stable")
        sizes = group["context"].str.len().to_numpy(np.int64)
        raw = np.frombuffer(b"".join(group["context"]), np.uint8)
        begin = np.cumsum(sizes) - sizes
        key, start, doc, place, first, last = (group[k].to_numpy(np.int64) for k in ("key", "start", "doc", "place", "first", "last"))
        segment = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
        i, o = repeated_windows(raw, {"segment": segment, "at": begin + place}, place, sizes - place, first, last, doc, start, width)
        at = start[i] + place[i] - o
        order = np.lexsort((at, doc[i]))
        d, s = doc[i][order], at[order]
        new = np.append(True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)) if len(d) else np.zeros(0, bool)
        at_new = np.flatnonzero(new)
        end = np.append(at_new[1:], len(d)) - 1
        return pd.DataFrame({"doc": d[at_new], "lo": s[at_new], "hi": s[end] if len(d) else s})

    names = [f"c{i}" for i in range(len(docs.columns))] if carry else ["doc_id", "n_bytes", "spans", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, marks in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                lo = hi = np.zeros(0, np.int64)
                if marks.is_valid:
                    lo, hi = (marks.values.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi"))
                x, y = merged(lo, hi + width)
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)])
                edges = [0, *np.stack([x, y], axis=1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) if len(x) else text)
            if rewrite is not None:
                out = rewrite(list(batch.column(3).flatten()), [bool(s) for s in spans], kept)
                yield pa.RecordBatch.from_arrays(out, names)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names)

    texts = rows.select("doc", "text")
    opened = marks.where("NOT copy").select("doc", "lo", "hi", "place", "anchor")
    crowds = opened.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ANCHOR).select("anchor", F.lit(True).alias("hot"))
    opened = opened.join(crowds, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = opened.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "place", "anchor", "hot")).alias("asked"))
    sent = with_marks(texts, asked, "asked").mapInArrow(contexts, "key long, doc long, start long, place int, first int, last int, context binary")
    single = sent.groupBy(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("bucket")).applyInPandas(compare, "doc long, lo long, hi long")
    both = marks.where("copy").select("doc", "lo", "hi").union(single)
    listed = both.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("removed"))
    alone = plain and not carry
    joined = (texts if alone else rows).join(listed, "doc", "left").select(F.col("doc" if alone else "doc_id").alias("doc_id"), "text", "removed", *(["row"] if carry else []))
    if not carry:
        return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    # columns of docs may have any names
    done = joined.mapInArrow(cut, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]))
    return done.toDF(*docs.columns)


def digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
