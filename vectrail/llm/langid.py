"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with FTRL-proximal and elastic-net penalties (per-coordinate steps, L1 zeroes most
weights), then calibrated by one temperature on rows the weights did not see.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_sample, mix64

BITS = 15
UNKNOWN = "und"


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each text between blanks, and the number of code points of each."""
    padded = [" " + t.lower() + " " for t in texts]
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.array([len(t) for t in padded], dtype=np.int64)


def gram_buckets(flat: np.ndarray, orders: tuple[int, ...]) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each place, for each n (grams over the end are shorter lists)."""
    out = []
    c = flat.astype(U64)
    for n in orders:
        m = len(c) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        key = c[:m].copy()
        for k in range(1, n):
            key = key * U64(0x100000001B3) + c[k : k + m]
        out.append(((key * U64(0x9E3779B97F4A7C15) + U64(n * 0xD6E8FEB86659FD93 % (1 << 64))) >> U64(64 - BITS)).astype(np.int64))
    return out


@dataclasses.dataclass
class LanguageModel:
    """weights [2**BITS, languages] already hold the idf; probabilities are softmax(margin / temperature)."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    orders: tuple[int, ...]

    def margins(self, texts: list[str]) -> np.ndarray:
        n = len(texts)
        if not n:
            return np.zeros((0, len(self.languages)))
        flat, size = _codes(texts)
        ends = np.cumsum(size)
        total = np.zeros((n, len(self.languages)))
        grams = np.zeros(n)
        for order, bucket in zip(self.orders, gram_buckets(flat, self.orders), strict=True):
            if not len(bucket):
                continue
            lo = np.minimum(ends - size, len(bucket))
            hi = np.minimum(np.maximum(ends - order + 1, lo), len(bucket))
            for k in range(len(self.languages)):
                run = np.zeros(len(bucket) + 1)
                np.cumsum(self.weights[:, k][bucket], out=run[1:])
                total[:, k] += run[hi] - run[lo]
            grams += hi - lo
        return total / np.maximum(grams, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.languages:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts))
        p = softmax(self.margins(texts) / self.temperature)
        best = p.argmax(axis=1) if len(texts) else np.zeros(0, np.int64)
        return best, p[np.arange(len(texts)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if z.size else z
    return e / e.sum(axis=1, keepdims=True) if z.size else z


def _bags(rows: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """Buckets and counts of each sampled row: at most 2**BITS entries a row, however long its text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                flat, _ = _codes([row.column(0)[0].as_py()])
                bucket, count = np.unique(np.concatenate(gram_buckets(flat, orders)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [row.column(1), row.column(2), pa.array([bucket.astype("<u2").tobytes()]), pa.array([count.astype("<u4").tobytes()])],
                    ["label", "part", "bucket", "count"],
                )

    return rows.select("text", "label", "part").mapInArrow(run, "label string, part int, bucket binary, count binary")


def train(
    labelled: DataFrame, *, key: str, text_col: str, label_col: str, sample: int = 3000, orders: tuple[int, ...] = (1, 2, 3),
    alpha: float = 0.6, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005, epochs: int = 6, minibatch: int = 16, seed: int = 3,
) -> LanguageModel:
    """Fit on at most about ``sample`` rows, chosen by the hash of ``key``; a fifth of them only calibrates.

    Rows with a null text, null label or no letter teach nothing. Without usable rows the model has
    no language and predicts 'und' for every text.
    """
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    kept = bounded_sample(usable, key, sample, [text_col, label_col]).where(has_letter(F.col(text_col)))
    rows = kept.select(
        F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"),
        F.pmod(F.xxhash64(F.col(key), F.lit(29)), F.lit(5)).cast("int").alias("part"), F.xxhash64(F.col(key), F.lit(31)).alias("turn"),
    )
    got = _bags(rows.orderBy("turn").select("text", "label", "part"), orders).toArrow().to_pylist()
    got.sort(key=lambda r: (r["bucket"], r["count"], r["label"]))
    order = np.random.default_rng(seed).permutation(len(got))
    got = [got[i] for i in order]
    languages = sorted({r["label"] for r in got})
    k, dim = len(languages), 1 << BITS
    if not k:
        return LanguageModel([], np.zeros((dim, 0)), np.zeros(0), 1.0, orders)
    bucket = [np.frombuffer(r["bucket"], "<u2").astype(np.int64) for r in got]
    tf = [np.frombuffer(r["count"], "<u4").astype(float) for r in got]
    tf = [x / max(1.0, x.sum()) for x in tf]
    y = np.array([languages.index(r["label"]) for r in got])
    fit = np.array([r["part"] != 0 for r in got])
    if not fit.any() or fit.all():
        fit[:] = True
    df = np.bincount(np.concatenate([b for b, f in zip(bucket, fit, strict=True) if f]), minlength=dim)
    idf = np.log((1 + fit.sum()) / (1 + df)) + 1
    scale = 100.0  # term frequencies are shares; this keeps steps and penalties near one
    x = [t * idf[b] * scale for b, t in zip(bucket, tf, strict=True)]

    z, n, w = np.zeros((dim, k)), np.zeros((dim, k)), np.zeros((dim, k))
    zb, nb, bias = np.zeros(k), np.zeros(k), np.zeros(k)
    which = np.flatnonzero(fit)
    for _ in range(epochs):
        for i in range(0, len(which), minibatch):
            rows_now = which[i : i + minibatch]
            touched = np.unique(np.concatenate([bucket[r] for r in rows_now]))
            # the weights of touched coordinates follow from the accumulated gradients
            zt, nt = z[touched], n[touched]
            w[touched] = np.where(np.abs(zt) <= l1, 0.0, -(zt - np.sign(zt) * l1) / ((beta + np.sqrt(nt)) / alpha + l2))
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
            margin = np.stack([x[r] @ w[bucket[r]] for r in rows_now]) + bias
            p = softmax(margin)
            p[np.arange(len(rows_now)), y[rows_now]] -= 1
            p /= len(rows_now)
            g = np.zeros((dim, k))
            for r, gr in zip(rows_now, p, strict=True):
                g[bucket[r]] += x[r][:, None] * gr
            g = g[touched]
            sigma = (np.sqrt(nt + g * g) - np.sqrt(nt)) / alpha
            z[touched] += g - sigma * w[touched]
            n[touched] += g * g
            gb = p.sum(axis=0)
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * bias
            nb += gb * gb
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    held = np.flatnonzero(~fit) if not fit.all() else which
    margin = np.stack([x[r] @ w[bucket[r]] for r in held]) + bias
    return LanguageModel(languages, w * idf[:, None] * scale, bias, temperature(margin, y[held]), orders)


def temperature(margin: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        z = margin / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score. Whole texts are read.

    'und' with score 0 for a null text, a text without any letter, and a model without languages. A
    null id stays null; repeated rows give a row each; an empty table gives an empty one; ties
    between languages go to the first in alphabetical order; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                best, score = model.predict(texts)
                known = [bool(k) and bool(model.languages) for k in part.column(2).to_pylist()]
                lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), has_letter(text).alias("letters"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")
