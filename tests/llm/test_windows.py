import hashlib
import random
import re

import pytest

from vectrail.llm import windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs, width):
    first, out = {}, {}
    words = {d: WORD.findall(t) for d, t in docs}
    for d in sorted(words):
        for s in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][s : s + width]), d)
    for d, ws in words.items():
        gone = set()
        for s in range(len(ws) - width + 1):
            if first[tuple(ws[s : s + width])] < d:
                gone.update(range(s, s + width))
        out[d] = (len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone))
    return out


@pytest.mark.parametrize("width,vocabulary,seed", [(50, 3, 1), (20, 2, 2), (14, 1, 3), (50, 50, 4)])
def test_equals_brute_force(spark, width, vocabulary, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["w%d" % i for i in range(vocabulary)])
    gap = lambda: rng.choice([" ", "  ", "\n", "\t ", " \x0b"])
    pieces = [[word() for _ in range(rng.choice([10, 60, 130]))] for _ in range(8)]
    docs = []
    for i in range(50):
        ws = [w for _ in range(rng.randint(0, 4)) for w in (rng.choice(pieces) if rng.random() < 0.6 else [word() for _ in range(rng.randint(0, 70))])]
        docs.append((i * 7, "".join(w + gap() for w in ws).encode()))
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id long, text string").repartition(3)
    got = windows.remove_repeats(df, width=width).collect()
    want = brute(docs, width)
    assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.kept.encode()) for r in got} == want


def test_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 0), (1, text, 1), (None, text, 2), (None, None, 3), (2, "", 4), (3, "few words", None), (4, text + " é", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = windows.remove_repeats(df).collect()
    assert sorted((r.n_words, len(r.kept.split())) for r in got) == [(0, 0), (0, 0), (2, 2), (60, 0), (60, 0), (60, 60), (61, 1)]
    assert windows.remove_repeats(df.where("false")).count() == 0


def test_query_on_table(spark):
    from vectrail.llm.queries import queries

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries()["op6_windows"](spark, d).collect()}
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs, 50)
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == {k: (a, b, hashlib.sha256(c).hexdigest()) for k, (a, b, c) in want.items()}


def test_words_that_collide_under_polynomials(spark):
    # words, and sequences of words, whose polynomial hashes modulo 2**64 are equal under every odd base
    morse = lambda n, a, b: [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]
    x, y = "".join(morse(1024, "a", "b")), "".join(morse(1024, "b", "a"))
    docs = [(1, " ".join([x] * 60)), (2, " ".join([y] * 60)), (3, " ".join(morse(2048, "u", "v"))), (4, " ".join(morse(2048, "v", "u"))), (5, " ".join([x] * 55))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for width in (50, 1024):
        got = windows.remove_repeats(df, width=width).collect()
        want = brute([(d, t.encode()) for d, t in docs], width)
        assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.kept.encode()) for r in got} == want
