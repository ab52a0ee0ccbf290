"""The stages against plain versions on the smallest table, and on awkward rows."""

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from test_jaccard import brute as brute_components
from test_suffixes import brute as brute_suffixes
from vectrail.llm import quality, toxicity

D = "/root/testdata/sf0.001"


def table(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "ngram_jaccard", "suffix_array", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    labels = spark.read.parquet(f"{D}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    for name, module, rule in (("quality", quality, lambda s: s >= 0.3), ("toxicity", toxicity, lambda s: s < 0.5)):
        before, after = kept[name]
        rows = table(before)
        model = module.train(before, labels)
        texts = [(r.text or "").encode() if name == "quality" else r.text or "" for r in rows.values()]
        want = {i for i, t in zip(rows, texts, strict=True) if rule(model.scores([t])[0])}
        assert set(table(after)) == want
    before, after = kept["ngram_jaccard"]
    comps = brute_components([(r.doc_id, r.text or "") for r in before.collect()], 5, 80, 100)
    assert set(table(after)) == {d for d, (_, c) in comps.items() if c == d}
    before, after = kept["suffix_array"]
    want = {d: t.decode("utf-8", "ignore") for d, t in brute_suffixes([(r.doc_id, (r.text or "").encode()) for r in before.collect()], 100).items()}
    got = table(after)
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    before, after = kept["packing"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    total = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    assert total == after.agg(F.sum("length")).first()[0] and set(table(after)) == set(table(before))


def test_awkward_rows(spark):
    text = "plain words of a long enough sentence that is good to read. " * 4
    rows = [(1, text, "en", "s", 5, "x"), (1, text, "en", "s", 5, "x"), (2, None, None, None, None, None), (None, "another text altogether, quite short", None, None, 3, "y"), (3, "", "en", "s", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        if name == "packing":
            assert out.count() >= 0
        elif name in ("ngram_jaccard", "suffix_array"):
            docs = out
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc"]
        else:
            assert out.columns == docs.columns and out.count() <= docs.count()
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 2, 3]
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, D).count() == 0
