"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; a line's features describe it and its neighbours. Forward-backward
marginals, weighted by line length, give the document's score.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_lanes, content_hash, labelled_sample, platt, slices, word_bounds

#: Byte classes whose share of a line is a feature.
_CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b"!", b"|", b"#$%&*@^~_=+<>{}[]\\/", b".,;:?'\"()-", b" \t",
]
_IN_CLASS = np.zeros((len(_CLASSES), 256), dtype=bool)
for _k, _bytes in enumerate(_CLASSES):
    _IN_CLASS[_k, list(_bytes)] = True
OWN = len(_CLASSES) * 3 + 7
FEATURES = 3 * OWN + 1
SLICE_BYTES, CHUNK_LINES = 512 << 10, 16_384


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, start and end of each line, lines of each text). A text has one line more than line ends."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    end = np.flatnonzero(raw == 10)
    start = np.append(0, end[:-1] + 1)
    lines = np.diff(np.append(-1, np.searchsorted(end, np.cumsum([len(t) + 1 for t in texts]) - 1)))
    return raw, start, end, lines


def _again(raw: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each line (not an empty one) occurs more than once in its text."""
    h = content_hash(byte_lanes(raw), 8, start, end)
    order = np.lexsort((h, doc))
    same = np.append(False, (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (end[order][1:] > start[order][1:]))
    out = np.empty(len(h), bool)
    out[order] = same | np.append(same[1:], False)
    return out


def _own_features(raw: np.ndarray, start: np.ndarray, end: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Features of lines by themselves; raw holds these lines and their line ends."""
    size = end - start
    n = np.maximum(size, 1)
    own = np.zeros((len(size), OWN))
    for k in range(len(_CLASSES)):
        run = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_IN_CLASS[k][raw], out=run[1:])
        share = (run[end] - run[start]) / n
        own[:, 3 * k], own[:, 3 * k + 1], own[:, 3 * k + 2] = np.sqrt(share), share > 0.04, share > 0.3
    words = run[end] - run[start] + 1  # blanks are the last class
    base = 3 * len(_CLASSES)
    own[:, base] = np.minimum(np.log1p(size) / 8, 2)
    own[:, base + 1] = np.minimum(size / words / 10, 2)
    own[:, base + 2] = (size > 0) & np.isin(raw[np.maximum(end - 1, 0)], list(b".!?"))
    own[:, base + 3] = size < 20
    own[:, base + 4] = again
    # words that repeat the word before them in their line
    word, word_end = word_bounds(raw)
    h = content_hash(byte_lanes(raw), 8, word, word_end)
    line = np.searchsorted(end, word)
    twice = np.zeros(len(word) + 1, np.int32)
    np.cumsum(np.append(False, (h[1:] == h[:-1]) & (line[1:] == line[:-1]))[: len(word)], out=twice[1:])
    repeated = (twice[np.searchsorted(word, end)] - twice[np.searchsorted(word, start)]) / np.maximum(words, 1)
    own[:, base + 5], own[:, base + 6] = np.sqrt(np.minimum(repeated, 1)), repeated > 0.15
    return own


def _own_chunks(raw: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Own features of the lines in turn, in chunks of CHUNK_LINES lines and SLICE_BYTES bytes at most (or one line)."""
    again = _again(raw, start, end, doc)
    first = 0
    while first < len(start):
        last = min(first + CHUNK_LINES, max(first + 1, int(np.searchsorted(end, start[first] + SLICE_BYTES))))
        chunk, at = slice(first, last), start[first]
        yield chunk, _own_features(raw[at : end[last - 1] + 1], start[chunk] - at, end[chunk] - at, again[chunk])
        first = last


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, lines of each text): a line's own features, those of the lines before and after it, and 1."""
    raw, start, end, lines = _lines(texts)
    doc = np.repeat(np.arange(len(texts)), lines)
    x = np.zeros((len(start), FEATURES))
    for chunk, own in _own_chunks(raw, start, end, doc):
        x[chunk, :OWN] = own
    x[:, -1] = 1
    inside = doc[1:] == doc[:-1]
    x[1:, OWN : 2 * OWN] = x[:-1, :OWN] * inside[:, None]
    x[:-1, 2 * OWN : 3 * OWN] = x[1:, :OWN] * inside[:, None]
    return x, end - start, lines


def emissions(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line_features @ weights, bytes of each line, lines of each text), with one chunk's features in memory."""
    raw, start, end, lines = _lines(texts)
    doc = np.repeat(np.arange(len(texts)), lines)
    each = np.empty((len(start), 3))
    for chunk, own in _own_chunks(raw, start, end, doc):
        each[chunk] = own @ weights[:-1].reshape(3, OWN).T
    z = each[:, 0] + weights[-1]
    inside = doc[1:] == doc[:-1]
    z[1:] += each[:-1, 1] * inside
    z[:-1] += each[1:, 2] * inside
    return z, end - start, lines


def sampled_lines(text: bytes, most: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, bytes) of all lines of a text, or of segments spread evenly over it, about ``most`` lines in all."""
    raw, start, end, lines = _lines([text])
    n = len(start)
    take = np.arange(n)
    if n > most:
        pieces = max(1, most // segment)
        first = np.linspace(0, n - segment, pieces).astype(np.int64)
        take = np.unique(first[:, None] + np.arange(segment))
    near = np.unique(np.clip(np.concatenate([take - 1, take, take + 1]), 0, n - 1))
    own = np.zeros((len(near) + 2, OWN))  # the last rows are the lines outside the text
    for chunk, part in _own_chunks(raw, start, end, np.zeros(n, np.int64)):
        lo, hi = np.searchsorted(near, (chunk.start, chunk.stop))
        own[lo:hi] = part[near[lo:hi] - chunk.start]
    row = lambda i: np.where((i >= 0) & (i < n), np.searchsorted(near, np.clip(i, 0, n - 1)), len(near))
    x = np.concatenate([own[row(take)], own[row(take - 1)], own[row(take + 1)], np.ones((len(take), 1))], axis=1)
    return x, (end - start)[take]


def forward_backward(emission: np.ndarray, lines: np.ndarray, transition: np.ndarray):
    """Marginals of all lines [n, 2], expected transitions [2, 2] and log partitions of chains laid end to end.

    All chains advance in step, the longest first, so a step costs what the chains still running need.
    """
    order = np.argsort(-lines, kind="stable")
    size = lines[order]
    start = (np.cumsum(lines) - lines)[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    top = emission.max(axis=1, keepdims=True)
    e, m = np.exp(emission - top), np.exp(transition)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones(len(e))
    for t in range(longest):
        i = start[: active[t]] + t
        a = e[i] if t == 0 else (alpha[i - 1] @ m) * e[i]
        scale[i] = a.sum(axis=1)
        alpha[i] = a / scale[i][:, None]
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        i = start[: active[t]] + t
        v = beta[i] * e[i] / scale[i][:, None]
        beta[i - 1] = v @ m.T
        pairs += (alpha[i - 1].T @ v) * m
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    log_z = np.add.reduceat(np.log(scale) + top[:, 0], (np.cumsum(lines) - lines)) if len(lines) else np.zeros(0)
    return marginal, pairs, log_z


@dataclasses.dataclass
class QualityModel:
    weights: np.ndarray  # of 'good' against 'bad', by feature
    transition: np.ndarray
    slope: float
    shift: float

    def line_marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, size, lines = emissions(texts, self.weights)
        marginal, _, _ = forward_backward(np.stack([np.zeros(len(z)), z], axis=1), lines, self.transition)
        return marginal[:, 1], size, lines

    def raw_scores(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        if not texts:
            return np.zeros(0)
        good, size, lines = self.line_marginals(texts)
        weight = size + 1.0
        first = np.cumsum(lines) - lines
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        p = np.clip(self.raw_scores(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def _lines_of(rows: DataFrame, most: int, segment: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x, size = sampled_lines((row.column(0)[0].as_py() or "").encode(), most, segment)
                yield pa.RecordBatch.from_arrays([row.column(1), row.column(2), pa.array([x.astype("<f2").tobytes()]), pa.array([size.astype("<i4").tobytes()])], ["label", "part", "x", "size"])

    return rows.select("text", "label", "part").mapInArrow(run, "label int, part int, x binary, size binary")


def train(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    sample: int = 3000, fit_lines: int = 192, segment: int = 48, steps: int = 120, rate: float = 0.15, penalty: float = 1e-3,
) -> QualityModel:
    """Fit on at most about ``sample`` labelled documents; a fifth of them only calibrates the score.

    Lines take their document's label. For fitting only, longer chains are cut into ``segment`` lines,
    and of a document of more than ``fit_lines`` lines, segments spread evenly over it teach.
    Without labels of both kinds the score is 0.5 for every text, or the only label seen.
    """
    got = _lines_of(labelled_sample(docs, labels, label_col, sample, id_col, text_col), fit_lines, segment).toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], r["part"], r["x"]))
    kinds = {r["label"] for r in got}
    if len(kinds) < 2:
        return QualityModel(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, 0.0 if not kinds else 4.0 if kinds.pop() else -4.0)

    def chains(rows: list[dict]):
        x = np.concatenate([np.frombuffer(r["x"], "<f2").reshape(-1, FEATURES) for r in rows]).astype(float)
        count = np.array([len(r["size"]) // 4 for r in rows])
        return x, np.repeat([r["label"] for r in rows], count), count, np.concatenate([np.frombuffer(r["size"], "<i4") for r in rows])

    fit = [r for r in got if r["part"] != 0] or got
    x, y, count, size = chains(fit)
    cut = np.concatenate([[segment] * (c // segment) + [c % segment] * (c % segment > 0) for c in count.tolist()]).astype(int)
    first = np.cumsum(cut) - cut
    weight = np.repeat(1.0 / np.maximum(1, np.repeat(1, len(cut))), cut)
    inner = np.ones(len(y), bool)
    inner[first] = False
    seen = np.zeros((2, 2))
    pos = np.flatnonzero(inner)
    np.add.at(seen, (y[pos - 1], y[pos]), 1)
    w, tr = np.zeros(FEATURES), np.zeros((2, 2))
    theta_m, theta_v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    n = len(y)
    for step in range(1, steps + 1):
        z = x @ w
        marginal, pairs, _ = forward_backward(np.stack([np.zeros(n), z], axis=1), cut, tr)
        gw = x.T @ ((marginal[:, 1] - y) * weight) / n + penalty * w
        gt = (pairs - seen) / n + penalty * tr
        g = np.append(gw, gt.ravel())
        theta_m = 0.9 * theta_m + 0.1 * g
        theta_v = 0.99 * theta_v + 0.01 * g * g
        move = rate * (theta_m / (1 - 0.9**step)) / (np.sqrt(theta_v / (1 - 0.99**step)) + 1e-8)
        w, tr = w - move[:FEATURES], tr - move[FEATURES:].reshape(2, 2)
    model = QualityModel(w, tr, 1.0, 0.0)
    held = [r for r in got if r["part"] == 0] or got
    x, _, count, size = chains(held)
    marginal, _, _ = forward_backward(np.stack([np.zeros(len(x)), x @ w], axis=1), count, tr)
    at = np.cumsum(count) - count
    raw = np.add.reduceat(marginal[:, 1] * (size + 1.0), at) / np.add.reduceat(size + 1.0, at)
    raw = np.clip(raw, 1e-6, 1 - 1e-6)
    model.slope, model.shift = platt(np.log(raw / (1 - raw)), np.array([r["label"] for r in held]))
    return model


def score(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All columns of docs and the score (0 to 1), appended under ``score_col``.

    The name is extended by underscores while docs has a column of that name (in any case); the
    new column is always the last. A null text counts as empty (one empty line). Rows pass one by
    one, so repeated rows, null ids and empty tables need no rule. Whole texts are read.
    """
    names = {c.lower() for c in docs.columns}
    while score_col.lower() in names:
        score_col += "_"
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()]
            found = [model.scores(texts[s:e]) for s, e in slices([len(t) for t in texts], SLICE_BYTES)]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, schema)
