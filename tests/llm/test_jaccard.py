import random
import re

import pytest

from vectrail.llm import jaccard

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs, words, num, den):
    """doc -> (set size, smallest reachable doc), comparing all pairs."""
    sets = {}
    for d, t in docs:
        ws = WORD.findall(bytes(t.encode()).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        sets[d] = {tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else {tuple(ws)} if ws else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("words,num,den,seed", [(3, 90, 100, 1), (5, 80, 100, 2), (1, 1, 2, 3)])
def test_equals_brute_force(spark, words, num, den, seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 40 if words == 1 else 400)
    docs = []
    for base in range(8):
        text = [word() for _ in range(rng.choice([2, 12, 60, 200]))]
        for _ in range(rng.choice([1, 4, 40])):
            own = list(text)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            docs.append((len(docs) * 5, " ".join(w.upper() if rng.random() < 0.1 else w for w in own)))
    docs += [(5000 + i, t) for i, t in enumerate(["", " \n", "one", "ONE", "one two", "é à", "É à"])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = jaccard.join(df, words=words, threshold=(num, den)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, words, num, den)


def test_edge_cases(spark):
    rows = [(1, "a b c d", 1), (1, "a b c d", 2), (None, "a b c d", 3), (None, None, 4), (2, None, 5), (3, "x y z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls int")
    got = jaccard.join(df).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 1, 3)]
    assert jaccard.join(df.where("false")).count() == 0


def test_query_on_table(spark):
    from vectrail.llm.queries import queries

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op5_jaccard"](spark, d).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 3, 90, 100)


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_words_that_collide_under_polynomials(spark):
    # equal under every odd base modulo 2**64, though no byte of them is equal
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    df = spark.createDataFrame([(1, f"{x} {y} {x}"), (2, f"{y} {x} {y}"), (3, x), (4, y), (5, f"{x} {y} {x}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_hot_tokens_are_split_by_further_orders(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_PAIRS", 2)
    rng = random.Random(9)
    line = [f"c{i}" for i in range(12)]
    docs = []
    for i in range(90):  # many documents share a line; some of them are near copies of each other
        own = [f"w{rng.randint(0, 6)}" for _ in range(rng.choice([3, 8, 25]))] if i % 3 else list(docs[rng.randrange(len(docs))][1].split()[12:]) if docs else ["x"]
        if i % 2 and own:
            own[rng.randrange(len(own))] = "edit"
        docs.append((i, " ".join(line + own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for words, num, den in ((1, 7, 10), (3, 90, 100)):
        got = jaccard.join(df, words=words, threshold=(num, den)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, words, num, den)
