import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from vectrail.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def samples():
    rng = random.Random(3)
    alphabet = "aé ß日🎉\n\t 1 '.s!Ⅷ  \x1c\x85$ THEthe"
    out = ["", " ", "  a  b ", "\n\n x\t y  z  ", "don't we'll I'M 123", "a" * 3000, " lead", "trail ", "a \nb", "x  y", "<|endoftext|> é́"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]


def odd_texts(n=10_000):
    """Short texts of control characters, unusual blanks, special tokens and letters."""
    rng = random.Random(1)
    parts = ["a", "b", "The", " ", "  ", "\n", "\0", "\x1c", "\x1d", "\x85", "\xa0", "<|endoftext|>", "<|", "é", "ß", "中", "'s", "1", "23", "\t", "\ufeff", "😀", "\r\n", "."]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_odd_texts_equal_the_library(library):
    coder, texts = bpe.codec(RANKS, P.PATTERN).encoder(), odd_texts()
    got = [x for i in range(0, len(texts), 500) for x in coder.encode(texts[i : i + 500])]
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    own = bpe.codec(RANKS, P.PATTERN)
    assert [own.decode(x) for x in got] == [t.encode() for t in texts]


def test_equals_the_library(library):
    coder = bpe.codec(RANKS, P.PATTERN).encoder(most=50)  # a small cache is cleared on the way
    texts = samples()
    got = [x.tolist() for i in range(0, len(texts), 40) for x in coder.encode(texts[i : i + 40])]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_spark_round_trip_and_edge_cases(spark, library):
    texts = samples()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "same", ""), (7, None, None), (7, "same", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    key = lambda x: (x[0] is None, x[0], x[1])
    assert sorted([(r.doc_id, bytes(r.bytes)) for r in got], key=key) == sorted([(i, (t or "").encode()) for i, t, _ in rows], key=key)
    assert bpe.encode(df.where("false"), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.codec(RANKS, P.PATTERN).decode(__import__("numpy").array([60_000]))


def test_query_on_table(spark, library):
    from vectrail.llm.queries import queries

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries()["op2_bpe"](spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        x = got.pop(r.doc_id)
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert not got


def test_texts_with_nul(library):
    coder = bpe.codec(RANKS, P.PATTERN).encoder()
    texts = ["a \0b", "\0b", "a b", " \0", "\0", "a \0b c", "\0\0 \0"]
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert [coder.codec.decode(x) for x in coder.encode(texts)] == [t.encode() for t in texts]
