"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares short stretches of text by their common four-letter subsequences, each weighted
by a decay to the power of the length it spans; letters may be apart, so inserted characters,
separators and endings only weaken a match. The kernel is evaluated against a few landmark
stretches (Nyström), a linear SVM is trained on those features, and since each feature is a sum
over subsequences, the trained function folds into one weight a subsequence. A text's margin is
that of its worst stretch.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, mix64, platt, slices

ORDER, SPAN, DECAY, BITS = 4, 7, 0.6, 18
STRETCH = 8  # a stretch holds the subsequences that start within so many characters
#: Share of toxic documents that the calibration supposes: without evidence a document counts as clean.
PRIOR = 0.15
LEAST_SQUARE = 2.0  # keeps stretches of hardly any letters from growing large
SLICE_CHARS = 512 << 10
#: Offsets of the second to fourth letter, and the weight of what they span.
PATTERNS = [(o, np.float32(DECAY ** (o[-1] + 1 - ORDER))) for o in itertools.combinations(range(1, SPAN), ORDER - 1)]

SYMBOLS = 1024  # Latin letters have codes of their own, other letters share the rest


def codes(text: str) -> np.ndarray:
    """Lower-case letters by code point; 32 for white space, 33 for any other character."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOL[np.where(c < 0x300, c, 0x300 + c % (SYMBOLS - 0x300))]


_SYMBOL = np.array([i if i >= 0x300 or chr(i).isalpha() else 32 if chr(i).isspace() else 33 for i in range(SYMBOLS)], dtype=np.uint16)


def _place_codes() -> list[np.ndarray]:
    """For each place in a subsequence a random code for each letter; what can't stand there raises a bit of its own.

    White space may stand first only, where it marks the start of a word.
    """
    out = []
    for k in range(ORDER):
        code = (mix64(np.arange(SYMBOLS, dtype=np.uint64) + np.uint64(5000 * (k + 1))) >> np.uint64(64 - BITS)).astype(np.uint32)
        code[[33] if k == 0 else [32, 33]] = 1 << (BITS + k)
        out.append(code)
    return out


_CODES = _place_codes()
NOTHING = 1 << BITS


def _keys(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.float32]]:
    """For each pattern the subsequence that starts at each place (NOTHING where a symbol can't stand)."""
    n = len(raw)
    padded = np.append(raw, np.full(SPAN, 33, np.uint16))
    code = [c[padded] for c in _CODES]
    for offsets, weight in PATTERNS:
        key = code[0][:n] ^ code[1][offsets[0] : offsets[0] + n]
        key ^= code[2][offsets[1] : offsets[1] + n]
        key ^= code[3][offsets[2] : offsets[2] + n]
        yield np.minimum(key, NOTHING, out=key), weight


def stretch_margins(raw: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The kernel machine's value on the stretch that starts at each place, over its length.

    The length takes each occurrence by itself, which is exact unless a stretch repeats a subsequence.
    """
    total, square = np.zeros(len(raw), np.float32), np.zeros(len(raw), np.float32)
    for key, weight in _keys(raw):
        total += weights[key] * weight
        square += (key < NOTHING) * (weight * weight)

    def over_stretch(x: np.ndarray) -> np.ndarray:
        run = np.zeros(len(raw) + STRETCH + 1)
        np.cumsum(x, out=run[1 : len(raw) + 1])
        run[len(raw) + 1 :] = run[len(raw)]
        return run[STRETCH : STRETCH + len(raw)] - run[: len(raw)]

    return over_stretch(total) / np.sqrt(over_stretch(square) + LEAST_SQUARE)


def features(stretches: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Explicit kernel features of stretches, unit length: (subsequences, weights)."""
    out = []
    for raw in stretches:
        keys, weights = [], []
        for key, weight in _keys(raw):
            keys.append(key[:STRETCH])
            weights.append(np.full(len(keys[-1]), weight))
        key, weight = np.concatenate(keys), np.concatenate(weights)
        known = key < NOTHING
        u, at = np.unique(key[known], return_inverse=True)
        v = np.bincount(at, weight[known], len(u))
        out.append((u.astype(np.int64), v / np.sqrt(float(v @ v) + LEAST_SQUARE)))
    return out


@dataclasses.dataclass
class ToxicityModel:
    """weights: the SVM's function by subsequence (the last entry, for no subsequence, is 0)."""

    weights: np.ndarray
    slope: float
    shift: float
    landmarks: list[str] = dataclasses.field(default_factory=list)

    def margins(self, texts: list[str]) -> np.ndarray:
        """The largest value of any stretch; 0 for an empty text, which has none."""
        if not texts:
            return np.zeros(0)
        raw = [np.append(np.uint16(32), codes(t)) for t in texts]
        size = np.array([len(r) + SPAN for r in raw])
        filler = np.full(SPAN, 33, np.uint16)
        m = stretch_margins(np.concatenate([x for r in raw for x in (r, filler)]), self.weights)
        return np.maximum.reduceat(m, np.cumsum(size) - size)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def _sentences(rows: DataFrame, most: int, longest: int) -> DataFrame:
    """At most ``most`` sentences of each sampled document, by their hash, of at most ``longest`` characters."""
    cut = F.expr(rf"regexp_extract_all(text, '[^.!?\\n]{{1,{longest}}}', 0)")
    ranked = F.array_sort(F.transform(cut, lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s"))))
    return rows.select("label", "part", "turn", F.transform(F.slice(ranked, 1, most), lambda x: x["s"]).alias("sentences"))


def train(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = 3000,
    sentences: int = 40, sentence_chars: int = 300, landmarks: int = 160, rounds: int = 4, penalty: float = 1e-3, seed: int = 7,
) -> ToxicityModel:
    """Fit on at most about ``sample`` labelled documents, ``sentences`` sentences of each (bounds of the fit only).

    A toxic document's sentences are a bag with at least one bad stretch: the first guess of it is
    the stretch whose letters are most typical of toxic documents, later rounds take the machine's
    own worst stretch. Clean documents give the stretches that the machine finds worst (hard
    negatives) and random ones. A fifth of the documents only calibrates. Without labels of both
    kinds the score is 0.5 for every text, or the only label seen.
    """
    got = _sentences(labelled_sample(docs, labels, label_col, sample, id_col, text_col), sentences, sentence_chars).toArrow().to_pylist()
    return fit_sentences(got, landmarks=landmarks, rounds=rounds, penalty=penalty, seed=seed)


def fit_sentences(got: list[dict], *, landmarks: int, rounds: int, penalty: float, seed: int) -> ToxicityModel:
    """The fit itself, on rows of label, part, turn and sentences."""
    got = sorted(got, key=lambda r: (r["turn"], r["label"]))
    kinds = {r["label"] for r in got}
    zero = np.zeros(NOTHING + 1, np.float32)
    if len(kinds) < 2:
        return ToxicityModel(zero, 0.0, 0.0 if not kinds else 4.0 if kinds.pop() else -4.0)
    rng = np.random.default_rng(seed)
    gap = "." * SPAN + " "
    strings = [" " + gap.join(r["sentences"] or [""]) + gap for r in got]
    texts = [codes(s) for s in strings]
    label = np.array([r["label"] for r in got])
    fit = np.array([r["part"] != 0 for r in got])
    if len(set(label[fit])) < 2 or len(set(label[~fit])) < 2:
        fit[:] = True
    bad = [texts[i] for i in np.flatnonzero(fit & (label == 1))]
    clean = [texts[i] for i in np.flatnonzero(fit & (label == 0))]

    # the first guess: log odds of the subsequences without gaps, by the documents that hold them
    seen = np.zeros((2, NOTHING + 1))
    for kind, group in ((1, bad), (0, clean)):
        for t in group:
            key, _ = next(_keys(t))
            seen[kind, np.unique(key)] += 1
    rate = (seen + 2) / (np.array([[len(clean)], [len(bad)]]) + 4)
    odds = np.log(rate[1] / rate[0])
    odds[NOTHING] = 0
    guess = np.where((odds > 1.0) & (seen[1] >= 4), odds, 0).astype(np.float32)

    def worst(group: list[np.ndarray], weights: np.ndarray, each: int, least: float) -> list[np.ndarray]:
        out = []
        for t in group:
            m = stretch_margins(t, weights)
            for _ in range(each):
                i = int(m.argmax())
                if m[i] <= least:
                    break
                out.append(t[i : i + STRETCH + SPAN])
                m[max(0, i - STRETCH) : i + STRETCH] = -np.inf
        return out

    def contiguous(t: np.ndarray) -> np.ndarray:
        key, _ = next(_keys(t))
        run = np.append(0, np.cumsum(guess[key]))
        m = np.full(len(key), -np.inf)
        m[: len(key) - STRETCH + 1] = run[STRETCH:] - run[:-STRETCH]
        return m

    def usual(margins: list[float]) -> float:
        """What few clean documents exceed: a bad document must, to teach what is bad in it."""
        return float(np.quantile(margins, 0.97)) if margins else 0.0

    least = max(2.5, usual([float(contiguous(t).max(initial=-1e9)) for t in clean]))
    positive = []
    for t in bad:
        m = contiguous(t)
        if len(m) and m.max() > least:
            i = int(m.argmax())
            positive.append(t[i : i + STRETCH + SPAN])
    negative = [t[i : i + STRETCH + SPAN] for t in clean for i in rng.integers(0, max(1, len(t) - STRETCH), 4).tolist()]
    negative += [t[i : i + STRETCH + SPAN] for t in clean for i in [int(contiguous(t).argmax())]]
    weights = zero
    chosen: list[np.ndarray] = []
    for _ in range(rounds):
        if not positive:
            break
        kinds_of = [np.frombuffer(x, np.uint16) for x in sorted({x.tobytes() for x in positive})]
        kinds_of = [kinds_of[i] for i in rng.permutation(len(kinds_of))]
        spread = _spread(features(kinds_of[:3000]), landmarks // 2)
        chosen = [kinds_of[i] for i in spread] + [negative[i] for i in rng.permutation(len(negative))[: landmarks // 2].tolist()]
        weights, bias = _svm(positive, negative, chosen, penalty, rng)
        negative = (negative + worst(clean, weights, 2, -1.0 - bias))[-12_000:]
        least = max(-bias, usual([float(stretch_margins(t, weights).max()) for t in clean]))
        positive = worst(bad, weights, 2, least) or positive
    model = ToxicityModel(weights, 1.0, 0.0, ["".join(map(chr, x)) for x in chosen])
    held = np.flatnonzero(~fit) if not fit.all() else np.arange(len(texts))
    margins = [model.margins([strings[i] for i in held[k : k + 40]]) for k in range(0, len(held), 40)]
    model.slope, model.shift = platt(np.concatenate(margins), label[held], PRIOR)
    return model


def _spread(rows: list[tuple[np.ndarray, np.ndarray]], most: int) -> list[int]:
    """Rows far from each other under the kernel, greedily."""
    near = np.full(len(rows), -1.0)
    dense = np.zeros(NOTHING + 1)
    out: list[int] = []
    at = 0
    while len(out) < min(most, len(rows)):
        out.append(at)
        u, v = rows[at]
        dense[u] = v
        near = np.maximum(near, [dense[a] @ b for a, b in rows])
        dense[u] = 0
        at = int(near.argmin())
        if near[at] > 0.999:
            break
    return out


def _svm(positive: list[np.ndarray], negative: list[np.ndarray], chosen: list[np.ndarray], penalty: float, rng) -> tuple[np.ndarray, float]:
    """Weights by subsequence of the SVM on Nyström features, by averaged subgradient steps on the balanced hinge loss."""
    marks = features(chosen)
    # a table over the landmarks' own subsequences only; all others share its last row, of zeros
    known = np.unique(np.concatenate([u for u, _ in marks]))
    row_of = np.full(NOTHING + 1, len(known), np.int32)
    row_of[known] = np.arange(len(known))
    table = np.zeros((len(known) + 1, len(marks)))
    for j, (u, v) in enumerate(marks):
        table[row_of[u], j] = v
    gram = np.stack([table[row_of[u]].T @ v for u, v in marks])
    value, vector = np.linalg.eigh(gram)
    keep = value > 1e-4 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # Nyström: k(x) @ root are the features
    x = np.empty((len(positive) + len(negative), root.shape[1]))
    for i in range(0, len(x), 500):
        part = (positive + negative)[i : i + 500]
        x[i : i + 500] = np.stack([table[row_of[u]].T @ v for u, v in features(part)]) @ root
    y = np.append(np.ones(len(positive)), -np.ones(len(negative)))
    groups = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b, steps = np.zeros_like(w), 0.0, 3000
    for step in range(1, steps + 1):
        i = np.concatenate([rng.choice(g, 32) for g in groups])
        active = y[i] * (x[i] @ w + b) < 1
        rate = 1 / (penalty * (step + 200))
        w = w * (1 - rate * penalty) + rate * (y[i] * active) @ x[i] / len(i)
        b += 0.5 / np.sqrt(step) * float((y[i] * active).mean())
        if step > steps // 2:
            mean_w += w
            mean_b += b
    mean_w, mean_b = mean_w / (steps - steps // 2), mean_b / (steps - steps // 2)
    folded = np.zeros(NOTHING + 1, np.float32)
    folded[known] = table[:-1] @ (root @ mean_w)
    folded[NOTHING] = 0
    return folded, float(mean_b)


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "toxic_score") -> DataFrame:
    """All columns of docs and the score (0 to 1), appended under ``score_col``.

    The name is extended by underscores while docs has a column of that name (in any case); the
    new column is always the last. A null text counts as empty, which has no stretch (margin 0).
    Rows pass one by one, so repeated rows, null ids and empty tables need no rule. Whole texts are
    read.
    """
    names = {c.lower() for c in docs.columns}
    while score_col.lower() in names:
        score_col += "_"
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]
            found = [model.scores(texts[s:e]) for s, e in slices([len(t) for t in texts], SLICE_CHARS)]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, schema)
