import random

import numpy as np
import pytest

from vectrail.llm import suffixes


def brute(docs, width):
    """(doc, bytes removed, kept) by a dictionary of all strings."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - width + 1):
            w = text[s : s + width]
            if w in seen:
                gone[s : s + width] = True
            seen.add(w)
        out[doc] = bytes(np.frombuffer(text, np.uint8)[~gone])
    return out


def run(spark, docs, width):
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in suffixes.remove_repeats(df, width=width).collect()}


@pytest.mark.parametrize("width,letters,seed", [(100, "ab", 1), (40, "abc", 2), (24, "a", 3), (100, "abcdefgh ", 4)])
def test_equals_brute_force(spark, width, letters, seed):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 30, 120, 300]))) for _ in range(12)]
    docs = []
    for i in range(60):
        parts = [rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 5))]
        docs.append((i * 3, "".join(parts).encode()))
    docs.append((1000, pieces[0].encode() * 4))
    got, want = run(spark, docs, width), brute(docs, width)
    assert {k: bytes(r.kept) for k, r in got.items()} == want
    for k, r in got.items():
        spans = [(s.start, s.end) for s in r.spans]
        assert sum(e - s for s, e in spans) == r.n_bytes - len(want[k])
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_edge_cases(spark):
    text = "é" * 120
    rows = [(1, text, "x"), (1, text, "y"), (None, text, None), (None, None, None), (2, "", "z"), (3, "short", None), (4, text + "tail", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = suffixes.remove_repeats(df).collect()
    assert len(got) == len(rows)
    whole = sorted((r.n_bytes, len(r.kept)) for r in got)
    # 240 bytes of one letter: the first document keeps the first strings, everything later repeats
    assert whole.count((0, 0)) == 2 and (5, 5) in whole
    assert sum(k for n, k in whole if n == 240) < 240
    assert suffixes.remove_repeats(df.where("false")).count() == 0


def test_query_on_table(spark):
    from vectrail.llm.queries import queries

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries()["op8_suffixes"](spark, d).collect()}
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs, 100)
    import hashlib

    assert {k: r.kept_sha256 for k, r in got.items()} == {k: hashlib.sha256(v).hexdigest() for k, v in want.items()}
    assert sum(r.n_removed for r in got.values()) == sum(len(t) for _, t in docs) - sum(map(len, want.values()))


def test_hot_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_ANCHOR", 1)
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    docs = []
    for i in range(40):  # near copies: every block has many variants
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        docs.append((i, "".join(text).encode()))
    for opened in (1, 2):
        monkeypatch.setattr(suffixes, "OPENED", opened)
        assert {k: bytes(r.kept) for k, r in run(spark, docs, 100).items()} == brute(docs, 100)


def test_strings_that_collide_under_polynomials(spark):
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    y = x.translate(str.maketrans("ab", "ba"))
    docs = [(1, x.encode()), (2, y.encode()), (3, (x + "-" + y).encode())]
    assert {k: bytes(r.kept) for k, r in run(spark, docs, 1100).items()} == brute(docs, 1100)
