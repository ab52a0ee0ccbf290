"""Substring removal by counted word windows.

Every window of ``width`` words that may repeat (see repeats) has a Rabin-Karp hash, and Spark counts
the windows of equal anchor and hash and finds the first document of each. The windows of a block
that occurs many times are hashed and counted once, with the block's first document, and every
occurrence reads the verdicts. Repeated windows merge into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_lanes, content_hash, window_hash61, word_bounds
from .repeats import candidates, merged, unique_rows, with_marks

GRAM = 14
#: Windows of one anchor are dealt by their distance from it, in ranges of so many.
RANGE = 16


def word_values(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Value of each word, and the words' starts."""
    raw = np.frombuffer(text, np.uint8)
    start, end = word_bounds(raw)
    return content_hash(byte_lanes(raw), 8, start, end), start


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    values, start = word_values(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return values, np.diff(np.append(0, np.searchsorted(start, ends))), values, 1


def remove_repeats(docs: DataFrame, *, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``width`` words that starts in an earlier document too.

    Words are runs of bytes other than blank and tab to carriage return, unchanged. Earlier means a
    smaller doc_id; windows are judged on the input. Columns: doc_id, n_words, spans (array of
    [start, end) of removed words, maximal), kept (string: kept words joined by one blank). Null text
    has no words. Rows that repeat an id, and rows without id (which come last), are documents of
    their own, ordered by text hash. Texts shorter than the width keep all words. An empty table
    gives an empty one; other columns are not read.

    Windows are equal if their anchors' 64-bit hashes and their hashes modulo 2**61 - 1 are.
    """
    rows, plain = unique_rows(docs, id_col, text_col)
    marks = candidates(rows, word_symbols, width, min(GRAM, width), opened=1)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """anchor, far, block, doc, least, hashes: the windows of each opened block, by range of distances from the anchor."""
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("anchor", "far", "block", "doc", "least", "hashes")}
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                if not own.is_valid:
                    continue
                lo, hi, place, anchor, block = (own.values.field(k).to_numpy(zero_copy_only=False).tolist() for k in ("lo", "hi", "place", "anchor", "block"))
                # backwards, so that the distance from the anchor grows
                h = window_hash61(word_values(text.as_py())[0], width)[::-1].astype("<i8")
                n = len(h) - 1
                for x, y, p, a, b in zip(lo, hi, place, anchor, block, strict=True):
                    for far in range((p - y) // RANGE, (p - x) // RANGE + 1):
                        least, most = max(p - y, far * RANGE), min(p - x, far * RANGE + RANGE - 1)
                        out["anchor"].append(a), out["far"].append(far), out["block"].append(b), out["doc"].append(doc)
                        out["least"].append(least), out["hashes"].append(h[n - p + least : n - p + most + 1])
            kinds = {"far": pa.int32(), "least": pa.int32(), "hashes": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            count, spans, kept = [], [], []
            for text, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                words = text.split()  # splits at blank and tab to carriage return
                x = y = np.zeros(0, np.int64)
                if own.is_valid:
                    last, bits = (own.values.field(k).to_numpy(zero_copy_only=False) for k in ("last", "bits"))
                    i, o = np.nonzero((bits[:, None] >> np.arange(RANGE)) & 1)
                    x, y = merged(last[i] - o, last[i] - o + width)
                count.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)])
                edges = [0, *np.stack([x, y], axis=1).ravel().tolist(), len(words)]
                kept.append(b" ".join([w for k in range(0, len(edges), 2) for w in words[edges[k] : edges[k + 1]]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(spans, span), pa.array(kept)], ["doc_id", "n_words", "spans", "kept"])

    texts = rows.select("doc", "text")
    asked = marks.where("NOT copy").groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "place", "anchor", "block")).alias("asked"))
    sent = with_marks(texts, asked, "asked").mapInArrow(hashes, "anchor long, far int, block long, doc long, least int, hashes array<long>")
    windows = sent.repartition("anchor", "far").select("anchor", "far", "block", "doc", "least", F.posexplode("hashes").alias("nth", "hash"))
    # counted by Spark within the one exchange: equal windows lie equally far from equal anchors
    first = F.min("doc").over(Window.partitionBy("anchor", "far", "hash"))
    judged = windows.select("anchor", "far", "block", (F.col("least") + F.col("nth") - F.col("far") * RANGE).alias("bit"), first.alias("first"))
    verdicts = judged.groupBy("anchor", "far", "block").agg(F.collect_list(F.struct("bit", "first")).alias("windows"))
    found = marks.select("doc", "place", "anchor", "block").join(verdicts, ["anchor", "block"])
    bits = F.aggregate("windows", F.lit(0), lambda acc, w: acc.bitwiseOR(F.when(w["first"] < F.col("doc"), F.call_function("shiftleft", F.lit(1), w["bit"])).otherwise(0)))
    removed = found.select("doc", (F.col("place") - F.col("far") * RANGE).alias("last"), bits.alias("bits")).where("bits <> 0")
    listed = removed.groupBy("doc").agg(F.collect_list(F.struct("last", "bits")).alias("removed"))
    joined = (texts if plain else rows).join(listed, "doc", "left").select(F.col("doc" if plain else "doc_id").alias("doc_id"), "text", "removed")
    return joined.mapInArrow(cut, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string")


def digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return removed.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
