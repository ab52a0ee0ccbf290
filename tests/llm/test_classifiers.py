"""Held-out accuracy, brute-force marginals and edge cases of the three classifiers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.llm import langid, quality, toxicity
from vectrail.llm.queries import queries

D = "/root/testdata/sf0.01"


def labels(spark, column, d):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}


def rate(pairs):
    return sum(pairs) / len(pairs)


def test_language_held_out(spark):
    rows = {r.doc_id: r for r in queries()["op1_langid"](spark, D).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i in lang if rows[i].held_out]
    assert rows.keys() == lang.keys() and 0.2 < len(held) / len(lang) < 0.3
    assert rate([rows[i].lang_pred == lang[i] for i in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)] + [(900, None, "en"), (901, "x", None), (902, "12", "en")], "doc_id long, text string, lang string")
    model = langid.train(train, key="doc_id", text_col="text", label_col="lang")
    again = langid.train(train.repartition(5), key="doc_id", text_col="text", label_col="lang")
    assert model.languages == ["en", "fr"] and (model.weights == again.weights).all()
    assert (model.weights == 0).mean() > 0.9 and model.temperature > 0  # sparse
    rows = [(1, None, "a"), (2, "", "b"), (3, "123 !?", "c"), (4, "the dog", "d"), (4, "the dog", "e"), (None, "le chat " * 2000, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "fr"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    empty = langid.train(train.where("false"), key="doc_id", text_col="text", label_col="lang")
    assert {r.lang_pred for r in langid.identify(train, empty).collect()} == {"und"}
    assert langid.identify(train.where("false"), model).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    lines = np.array([3, 1, 5, 2])
    e, t = rng.standard_normal((11, 2)), rng.standard_normal((2, 2))
    marginal, pairs, log_z = quality.forward_backward(e, lines, t)
    at, want_pairs = 0, np.zeros((2, 2))
    for c, n in enumerate(lines):
        p = np.zeros((n, 2))
        joint = np.zeros((2, 2))
        total = 0.0
        for ys in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + k, y] for k, y in enumerate(ys)) + sum(t[a, b] for a, b in zip(ys, ys[1:])))
            total += w
            for k, y in enumerate(ys):
                p[k, y] += w
            for a, b in zip(ys, ys[1:]):
                joint[a, b] += w
        assert np.allclose(marginal[at : at + n], p / total) and np.isclose(log_z[c], np.log(total))
        want_pairs += joint / total
        at += n
    assert np.allclose(pairs, want_pairs)


@pytest.mark.parametrize("name,column", [("op7_quality", "quality"), ("op9_toxicity", "toxic")])
def test_scores_held_out(spark, name, column):
    d = D if column == "quality" else D.replace("0.01", "0.1")  # toxic labels are few
    rows = {r.doc_id: r for r in queries()[name](spark, d).collect()}
    truth = labels(spark, column, d)
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    held = [i for i in truth if rows[i].held_out]
    pos, neg = ([rows[i].score for i in held if truth[i] == k] for k in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc >= (0.97 if column == "quality" else 0.75)
    least = 0.3 if column == "quality" else 0.5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in rows.values())


def test_toxicity_tolerates_gaps():
    rng = np.random.default_rng(9)
    parts = ["ka", "lo", "mi", "ten", "sur", "pa", "ved", "nor", "qui", "ta"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    plain = lambda n: " ".join(word() for _ in range(n))
    rows = [dict(label=i % 2, part=i % 5, turn=i, sentences=[plain(9) + (" grumbler " if i % 2 else " ") + plain(9), plain(12)]) for i in range(400)]
    model = toxicity.fit_sentences(rows, landmarks=40, rounds=3, penalty=1e-3, seed=1)
    clean = model.scores([plain(20) for _ in range(50)])
    bad = model.scores([f"{plain(8)} {w} {plain(8)}" for w in ("grumbler", "GRUMBLER!", "grumxbler", "g.r.u.m.b.l.e.r", "grumbl er", "grumblerish")])
    assert np.quantile(clean, 0.9) < 0.5 < bad[:3].min() and bad.min() > np.quantile(clean, 0.9)


@pytest.mark.parametrize("module,column", [(quality, "quality"), (toxicity, "toxic")])
def test_scoring_edge_cases(spark, module, column):
    docs = spark.createDataFrame([(i, f"text {i} grumble" if i % 2 else "fine words here.\nmore", None) for i in range(60)], "doc_id long, text string, source string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (999, 1)], f"doc_id long, {column} int")
    model = module.train(docs, marks)
    rows = [(1, None, "a"), (1, "", "b"), (None, "line\n" * 3000, None), (2, "\n\n", "c")]
    odd = spark.createDataFrame(rows, f"doc_id long, text string, {column}_score string")
    got = module.score(odd, model)
    assert got.columns == ["doc_id", "text", f"{column}_score", f"{column}_score_"]
    assert [0 <= r[3] <= 1 for r in got.collect()] == [True] * 4 and {r[2] for r in got.collect()} == {"a", "b", "c", None}
    assert module.score(odd.where("false"), model).count() == 0
    for only, want in ((marks.where("false"), 0.5), (marks.where(F.col(column) == 1), 0.98)):
        values = [r[3] for r in module.score(odd, module.train(docs, only)).collect()]
        assert all(v == pytest.approx(want, abs=0.01) for v in values)


def test_long_texts_are_scored_in_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "Gamma!", "|||", "x", "", "12 34", "alpha alpha"]
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(n)).encode() for n in (1, 40, 0, 300)] + [b"", b"\n\n", b"w " * 900]
    w = rng.standard_normal(quality.FEATURES)
    x, size, lines = quality.line_features(texts)
    assert lines.tolist() == [t.count(b"\n") + 1 for t in texts]
    for chunk, most in ((16_384, 512 << 10), (7, 512 << 10), (50, 64)):
        monkeypatch.setattr(quality, "CHUNK_LINES", chunk)
        monkeypatch.setattr(quality, "SLICE_BYTES", most)
        z, size2, lines2 = quality.emissions(texts, w)
        assert np.allclose(z, x @ w) and (size == size2).all() and (lines == lines2).all()
    whole, _ = quality.sampled_lines(texts[3], 1000, 10)
    assert np.allclose(whole, quality.line_features([texts[3]])[0])
    some, size = quality.sampled_lines(texts[3], 40, 10)
    assert len(some) == len(size) == 40 and all((np.abs(whole - r).sum(axis=1) < 1e-9).any() for r in some)


def test_a_text_of_line_ends_takes_little_memory():
    import resource

    model = quality.QualityModel(np.linspace(-1, 1, quality.FEATURES), np.zeros((2, 2)), 1.0, 0.0)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 <= model.scores([b"\n" * 300_000])[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def test_language_margins_equal_a_loop_over_grams():
    rng = np.random.default_rng(1)
    model = langid.LanguageModel(["a", "b", "c"], rng.standard_normal((1 << langid.BITS, 3)), rng.standard_normal(3), 1.7, (1, 2, 3))
    texts = ["The cat", "", "é", "ab ab ab", "x" * 50]
    got = model.margins(texts)
    for text, row in zip(texts, got, strict=True):
        padded = " " + text.lower() + " "
        grams = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
        buckets = [langid.gram_buckets(np.array(list(map(ord, g)), np.uint32), (len(g),))[0][0] for g in grams]
        assert np.allclose(row, sum(model.weights[b] for b in buckets) / len(grams) + model.bias)
    best, score = model.predict(texts)
    p = np.exp(got / 1.7) / np.exp(got / 1.7).sum(axis=1, keepdims=True)
    assert (best == p.argmax(axis=1)).all() and np.allclose(score, p.max(axis=1))


def explicit_kernel(raw):
    """(weight of each gapped subsequence of a stretch, sum of the squared weights of all occurrences), by enumeration."""
    out, square = {}, 0.0
    padded = np.append(raw, np.full(toxicity.SPAN, 33, np.uint16))
    for i in range(min(len(raw), toxicity.STRETCH)):
        for rest in itertools.combinations(range(i + 1, i + toxicity.SPAN), toxicity.ORDER - 1):
            letters = [int(padded[k]) for k in (i, *rest)]
            if letters[0] == 33 or any(c in (32, 33) for c in letters[1:]):
                continue
            key = 0
            for place, c in enumerate(letters):
                key ^= int(toxicity._CODES[place][c])
            weight = toxicity.DECAY ** (rest[-1] - i + 1 - toxicity.ORDER)
            out[key], square = out.get(key, 0.0) + weight, square + weight * weight
    return out, square


def test_folded_machine_equals_the_explicit_kernel():
    rng = np.random.default_rng(2)
    stretches = [toxicity.codes("".join(rng.choice(list("abcde .é"), 15))) for _ in range(30)]
    size = lambda k: np.sqrt(sum(v * v for v in k.values()) + toxicity.LEAST_SQUARE)
    kernels = [explicit_kernel(s) for s in stretches]
    for (u, v), (k, _) in zip(toxicity.features(stretches), kernels, strict=True):
        assert dict(zip(u.tolist(), v.tolist(), strict=True)).keys() == k.keys()
        assert np.allclose(v, [k[a] / size(k) for a in u.tolist()], rtol=1e-4)
    weights, _ = toxicity._svm(stretches[:10], stretches[10:20], stretches[:12], 1e-3, np.random.default_rng(0))
    for s, (k, square) in zip(stretches[20:], kernels[20:], strict=True):
        want = sum(float(weights[a]) * v for a, v in k.items()) / np.sqrt(square + toxicity.LEAST_SQUARE)
        assert toxicity.stretch_margins(s, weights)[0] == pytest.approx(want, rel=1e-3, abs=1e-4)
    # the machine's weights are a combination of the landmarks' kernels: nothing else has a weight
    assert set(np.flatnonzero(weights).tolist()) <= set().union(*[k.keys() for k, _ in kernels[:12]])
