import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vectrail.llm import packing

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_tokens_equal_the_library(library):
    from test_bpe import odd_texts, samples

    own = packing.FastTokenizer(FILE, most=30, added=True)
    for text in samples() + odd_texts():
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_hilbert_curve_steps_by_one():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        key = packing.hilbert_key(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def check(rows, texts, library, most):
    """Pieces cover each document once, sequences are gapless, and none is padded unless its length is a power of two or full."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        want = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert p["ids_crc32"] == zlib.crc32(np.array(want[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(want)
    assert by_doc.keys() == texts.keys()
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= most and (at & (at - 1)) == 0


def test_query_on_table(spark, library):
    from vectrail.llm.queries import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    check([r.asDict() for r in queries()["op10_packing"](spark, d).collect()], texts, library, 2048)


def test_edge_cases(spark, library):
    texts = {1: None, 2: "", 3: "word " * 500, 4: "the same", 5: "the same", 6: "é" * 40}
    df = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, key int")
    check([r.asDict() for r in packing.digests(packing.pack(df, FILE, max_tokens=64)).collect()], texts, library, 64)
    twice = packing.pack(df.where("doc_id = 4").union(df.where("doc_id = 4")), FILE, max_tokens=64).collect()
    assert sum(r.length for r in twice if r.doc_id == 4) == 2 * twice[0].doc_tokens
    assert packing.pack(df.where("false"), FILE).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack(nulls, FILE).collect()} == {None}


def test_texts_with_nul(library):
    own = packing.FastTokenizer(FILE)
    for text in ["a \0b", "\0b", "a b", " \0", "\0", "a \0b c", "\0\0 \0"]:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_added_tokens_equal_the_library_as_it_is(spark):
    library = Tokenizer.from_file(FILE)
    texts = dict(enumerate(["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x \n", "a  <|endoftext|>\0b", "<|endoftext", "no mark"]))
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check([r.asDict() for r in packing.digests(packing.pack(df, FILE, max_tokens=64)).collect()], texts, library, 64)
