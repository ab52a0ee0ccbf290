"""N-gram Jaccard join by multiple-global-order filtering.

Two shingle sets of similarity t or more share a token in the prefixes of their sets under every
global token order. Equal sets are one node (a 128-bit key), and each node's prefixes under all
orders are written once. The first order (rare tokens first, by a fixed-size count sketch) proposes
pairs, which size, position and parity-bitmap bounds thin out; pairs stay only if their prefixes meet
under each further order too. Texts are fetched and compared exactly for what is left.

The result is connectivity, so pairs are not enumerated within groups of copies: each prefix token
first links its members to the one with the fewest rarer tokens, and only pairs that are still in
different components after that are proposed in the second round, where tokens of very many
pairs are split by the prefix tokens of the further orders.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_lanes, components, content_hash, drop_table, mix64, slices, word_bounds, write_in_parts, write_table
from .repeats import unique_rows

SKETCH_BITS, SLICE_BITS = 20, 16
SLICE_BYTES = 512 << 10
ORDERS = 3
BITMAPS = ("b0", "b1", "b2", "b3")
#: Least and largest number of bits (log2) that mark wanted documents; what is broadcast stays below 8 MB.
MARK_BITS = (16, 26)
#: A token whose rows would meet in more pairs than this is split by further orders first.
HOT_PAIRS = 1 << 20
#: Tokens and pairs are exchanged in so many parts by hash, one after the other: a part's shuffle files go before the next begins.
PARTS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document) of the distinct shingles, sorted by document and hash. A-Z is lower-cased.

    A text of fewer words has its whole sequence as the only shingle; one without words has none.
    """
    raw = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    start, end = word_bounds(raw)
    value = content_hash(byte_lanes(raw), 8, start, end)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, bounds)
    count = np.diff(np.append(0, upto))
    first = upto - count
    doc = np.repeat(np.arange(len(texts)), count)
    n = max(0, len(value) - words + 1)
    h = np.zeros(n, dtype=U64)
    for k in range(words):
        h = mix64(h * U64(3) + value[k : k + n])
    inside = (doc[:n] == doc[words - 1 : words - 1 + n]) if n else np.zeros(0, bool)
    h, owner = h[inside], doc[:n][inside]
    short = np.flatnonzero((count > 0) & (count < words))
    one = count[short].astype(U64)
    for k in range(words - 1):
        more = count[short] > k
        one[more] = mix64(one[more] * U64(7) + value[first[short[more]] + k])
    h, owner = np.append(h, one), np.append(owner, short)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], owner[new]


def class_keys(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two independent keys of each document's set, from sums of its hashes: equal sets have equal keys."""
    ends, out = np.cumsum(n), []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        run = np.append(U64(0), np.cumsum(mix64(h ^ U64(salt))))
        out.append(mix64(run[ends] - run[ends - n] + n.astype(U64)).view(np.int64))
    return out


def parity_bitmaps(h: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """[docs, 4] of 64 bits: for each of 256 hash buckets, whether the set holds an odd number of its tokens.

    Two sets differ in at least as many tokens as their bitmaps do in bits.
    """
    bucket = ((h >> U64(17)) & U64(255)).astype(np.int64)
    odd = (np.bincount(owner * 256 + bucket, minlength=docs * 256) & 1).astype(np.uint8).reshape(docs, 256)
    return np.packbits(odd, axis=1).view("<i8").reshape(docs, 4)


def prefix_length(n, num: int, den: int):
    """Tokens of a set of n of which any similar set must hold one: n - ceil(n * num / den) + 1."""
    return n + (-n * num) // den + 1


def in_order(h: np.ndarray, owner: np.ndarray, sketch: np.ndarray, which: int) -> np.ndarray:
    """Places of the tokens, document by document, in the global order ``which``. h and owner are sorted by (owner, h).

    Order 0 is by count, the others by its rough logarithm and then by a hash of their own. What one
    number can't tell apart stays in the order of h, so the order is the same for all documents.
    """
    count = sketch[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)]
    rare = np.minimum(np.floor(np.log2(count + 1.0) * (64 if which == 0 else 2)), 4095).astype(U64)
    minor = h if which == 0 else mix64(h + U64(which * 0xA0761D6478BD642F % (1 << 64)))
    bits = max(1, int(owner[-1]).bit_length()) if len(owner) else 1
    key = (owner.astype(U64) << U64(64 - bits)) | (rare << U64(52 - bits)) | (minor >> U64(12 + bits))
    return np.argsort(key, kind="stable")


def _in_slices(batch: pa.RecordBatch, words: int):
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    for s, e in slices([len(t) for t in texts], SLICE_BYTES):
        h, owner = shingle_sets(texts[s:e], words)
        yield s, e, h, owner


def _summaries(rows: DataFrame, words: int) -> DataFrame:
    """doc, n, k1, k2, text_hash of each document; and the count sketch of each task in slices (part, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc", "n", "k1", "k2", "text_hash", "part", "sketch"]
        for batch in batches:
            for s, e, h, owner in _in_slices(batch, words):
                n = np.bincount(owner, minlength=e - s)
                np.add.at(sketch, (h >> U64(64 - SKETCH_BITS)).astype(np.int64), 1)
                keys = [pa.array(k) for k in class_keys(h, n)]
                own, text_hash = batch.column(0).slice(s, e - s), batch.column(2).slice(s, e - s)
                yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64()), *keys, text_hash, pa.nulls(e - s, pa.int32()), pa.nulls(e - s, pa.binary())], names)
        parts = range(1 << (SKETCH_BITS - SLICE_BITS))
        blobs = [zlib.compress(sketch[p << SLICE_BITS : (p + 1) << SLICE_BITS].tobytes(), 1) for p in parts]
        k = len(blobs)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 5, pa.array(list(parts), pa.int32()), pa.array(blobs, pa.binary())], names)

    return rows.select("doc", "text", F.xxhash64("text")).mapInArrow(run, "doc long, n long, k1 long, k2 long, text_hash long, part int, sketch binary")


def _sketch(summaries: DataFrame) -> np.ndarray:
    """The summed sketch: 2**SKETCH_BITS counts, whatever the input's size. Each part is summed in a task of its own."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.uint64)
                total[part] = total[part] + own if part in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["part", "sketch"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    summed = summaries.where("part IS NOT NULL").select("part", "sketch").repartition("part").mapInArrow(add, "part int, sketch binary")
    for r in summed.collect():
        out[r.part << SLICE_BITS : (r.part + 1) << SLICE_BITS] = np.frombuffer(zlib.decompress(r.sketch), np.uint64)
    return out


def _marked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, text of all wanted documents (docs: doc) and of a few others.

    A bitmap of at least 16 bits a wanted document, up to 2**26 bits, picks them without an
    exchange of the texts. Beyond four million wanted documents it only lets more others pass.
    """
    bits = 1 << min(MARK_BITS[1], max(MARK_BITS[0], (docs.count() * 16).bit_length()))
    bit = F.pmod(F.xxhash64("doc"), F.lit(bits))
    marks = docs.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    marked = rows.select("doc", "text", bit.alias("bit")).withColumn("bucket", F.expr("bitmap_bucket_number(bit)")).withColumn("at", F.expr("bitmap_bit_position(bit)"))
    marked = marked.join(F.broadcast(marks), "bucket").where("getbit(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) = 1")
    return marked.select("doc", "text")


def _fronts(rows: DataFrame, sketch, words: int, num: int, den: int) -> DataFrame:
    """node, n, bitmaps, f0, f1, f2: the prefixes of each document's set under all orders.

    f0 holds whole tokens in order; of the others, which are only tested for a common token, 32 bits do.
    """

    def lists(values: np.ndarray, owner: np.ndarray, docs: int, kind: pa.DataType) -> pa.ListArray:
        ends = np.cumsum(np.bincount(owner, minlength=docs))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for s, e, h, owner in _in_slices(batch, words):
                docs = e - s
                n = np.bincount(owner, minlength=docs)
                first, most = np.cumsum(n) - n, prefix_length(n, num, den)
                take = np.arange(len(h)) - first[owner] < most[owner]
                fronts = []
                for which in range(ORDERS):
                    front = h[in_order(h, owner, counts, which)][take]
                    fronts.append(lists(front.view(np.int64), owner[take], docs, pa.int64()) if which == 0 else lists((front & U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), owner[take], docs, pa.int32()))
                bitmaps = [pa.array(b) for b in parity_bitmaps(h, owner, docs).T.copy()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, docs), pa.array(n, pa.int32()), *bitmaps, *fronts], ["node", "n", *BITMAPS, "f0", "f1", "f2"])

    return rows.select("doc", "text").mapInArrow(run, "node long, n int, b0 long, b1 long, b2 long, b3 long, f0 array<long>, f1 array<int>, f2 array<int>")


def _verify(pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """u, v of the pairs (a, b, a_text, b_text) whose shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0

        def shingles(key: int, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            if key not in known:
                if held > 4 << 20:
                    known.clear()
                    held = 0
                known[key] = shingle_sets([text.as_py()], words)[0]
                held += len(known[key])
            return known[key]

        for batch in batches:
            u, v = [], []
            a_text, b_text = (batch.column(k).cast(pa.binary()) for k in (2, 3))
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = shingles(a, a_text[i]), shingles(b, b_text[i])
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                if den * shared >= num * (len(both) - shared):
                    u.append(a), v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(run, "u long, v long")


def join(
    docs: DataFrame, *, words: int = 3, threshold: tuple[int, int] = (90, 100), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc, doc_id, text_hash, n_shingles, component_id, component: components of documents whose shingle sets are similar.

    Two documents link when intersection / union >= threshold (a fraction of whole numbers). doc_id
    and component_id are ids; component_id is the smallest doc_id reachable by links (null if only
    documents without id are). doc and component are the rows' unique keys, text_hash is xxhash64 of the text. Texts without words,
    null ones too, have no shingle and link with nothing. Rows that repeat an id, and rows without
    id, are documents of their own. An empty table gives an empty one; other columns are not read.
    """
    num, den = threshold
    rows, plain = unique_rows(docs, id_col, text_col)
    spark = docs.sparkSession
    summaries = write_table(_summaries(rows, words), "summaries")
    sketch = spark.sparkContext.broadcast(_sketch(summaries))
    known = summaries.where("part IS NULL").select("doc", "n", "k1", "k2", "text_hash")
    # a node of the graph is the smallest document with its set
    sets = write_table(known.where("n > 0").groupBy("k1", "k2").agg(F.min("doc").alias("node")), "sets")
    fronts = write_table(_fronts(_marked(rows, sets.select(F.col("node").alias("doc"))), sketch, words, num, den).where("n > 0"), "fronts")

    def shared_of(part: int) -> DataFrame:
        tokens = fronts.select("node", "n", F.posexplode("f0").alias("pos", "key")).where(F.pmod(F.xxhash64("key"), F.lit(PARTS)) == part)
        by_token = tokens.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.struct("pos", "n", "node")).alias("lead"))
        return tokens.join(by_token.where("low <> high").select("key", "lead"), "key")

    shared = write_in_parts(shared_of, "shared", PARTS)

    def fits(a: str, b: str) -> str:
        size = f"{den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n)"
        return f"{size} AND {num + den} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {num} * ({a}.n + {b}.n)"

    def filtered(pairs: DataFrame) -> DataFrame:
        """Pairs (a written table) whose parity bitmaps differ in no more tokens than similar sets may, and whose prefixes meet under all further orders."""
        proposed = pairs

        def plausible(part: int) -> DataFrame:
            pairs = proposed.where(F.pmod(F.xxhash64("a", "b"), F.lit(PARTS)) == part)
            for side in ("a", "b"):
                pairs = pairs.join(fronts.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *BITMAPS)]), side)
            apart = " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in BITMAPS)
            return pairs.where(f"({apart}) * {num + den} <= {den - num} * (a_n + b_n)").select("a", "b")

        pairs = write_in_parts(plausible, "plausible", PARTS)
        met = pairs
        for side in ("a", "b"):
            met = met.join(fronts.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("f1", "f2")]), side)
        met = write_table(met.where("arrays_overlap(a_f1, b_f1) AND arrays_overlap(a_f2, b_f2)").select("a", "b"), "met")
        drop_table(pairs)
        return met

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = filtered(pairs)
        wanted = write_table(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "wanted")
        text = write_table(_marked(rows, wanted).join(wanted, "doc"), "texts")
        one = pairs.join(text.select(F.col("doc").alias("a"), F.col("text").alias("a_text")), "a")
        both = one.join(text.select(F.col("doc").alias("b"), F.col("text").alias("b_text")), "b")
        links = write_table(_verify(both, words, num, den), "links")
        drop_table(text)
        return links

    star = shared.alias("m").where("lead.node <> node AND " + fits("lead", "m"))
    star = write_table(star.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct(), "star")
    links = verified(star)
    drop_table(star)
    placed = shared.select("key", "node", "n", "pos").join(components(links).select("node", "component"), "node", "left")
    placed = write_table(_contested(placed.select("key", "node", "n", "pos", F.coalesce("component", "node").alias("comp"))), "placed")
    drop_table(shared)
    cross = write_table(_across(placed, fronts, fits), "cross")
    if not cross.isEmpty():
        links = links.union(verified(cross))
    comp = components(links).select(F.col("node"), "component")
    for table in (placed, cross, fronts):
        drop_table(table)

    named_sets = write_table(sets.join(comp, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component")), "components")
    out = known.join(named_sets, ["k1", "k2"], "left").select("doc", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))
    if plain:
        return out.select("doc", F.col("doc").alias("doc_id"), "text_hash", "n_shingles", F.col("component").alias("component_id"), "component")
    names = rows.select("doc", "doc_id")
    named = out.join(names, "doc").join(names.select(F.col("doc").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return named.select("doc", "doc_id", "text_hash", "n_shingles", "component_id", "component")


def _contested(rows: DataFrame) -> DataFrame:
    """Rows of the keys that lie in several components, with the component of the key's leader (main) and the pairs to be met (pairs)."""
    of = rows.groupBy("key", "comp").agg(F.min(F.struct("pos", "n", "node")).alias("lead"), F.count("*").alias("size"))
    of = of.groupBy("key").agg(F.min(F.struct("lead", "comp", "size")).alias("first"), F.count("*").alias("comps"), F.sum("size").alias("size"))
    pairs = (F.col("size") - F.col("first.size")) * F.col("size")
    return rows.join(of.where("comps > 1").select("key", F.col("first.comp").alias("main"), pairs.alias("pairs")), "key")


def _across(rows: DataFrame, fronts: DataFrame, fits) -> DataFrame:
    """a, b: pairs of different components that share a key and fit.

    Members of a key's main component don't meet each other. Keys of more than HOT_PAIRS pairs are
    first split by the prefix tokens of the second order, and then of the third: similar sets share
    one under every order.
    """

    def met(part: DataFrame) -> DataFrame:
        a, b = part.where("comp <> main").alias("a"), part.alias("b")
        both = a.join(b, (F.col("a.key") == F.col("b.key")) & F.expr("a.comp <> b.comp AND (b.comp = b.main OR a.node < b.node) AND " + fits("a", "b")))
        return both.select(F.expr("least(a.node, b.node)").alias("a"), F.expr("greatest(a.node, b.node)").alias("b"))

    found = []
    for front in ("f1", "f2"):
        found.append(met(rows.where(F.col("pairs") <= HOT_PAIRS)))
        hot = rows.where(F.col("pairs") > HOT_PAIRS)
        if hot.isEmpty():
            break
        split = hot.select("key", "node", "n", "pos", "comp").join(fronts.select("node", F.explode(front).alias("more")), "node")
        rows = write_table(_contested(split.select(F.xxhash64("key", "more").alias("key"), "node", "n", "pos", "comp")), "split")
    else:
        found.append(met(rows))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def digests(joined: DataFrame) -> DataFrame:
    return joined.select("doc_id", "n_shingles", "component_id")
