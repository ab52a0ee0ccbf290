"""Sequence packing along a space-filling curve.

Each document's hashed token counts are projected to a few dimensions; the grid cell's Hilbert
key orders the documents; a range sort cuts the curve into tasks, and each task packs its
stretch of neighbours into sequences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, write_table

DIMENSIONS, BITS, BUCKETS = 4, 10, 1024


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer grid cells [n, d], d * bits <= 62, by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class FastTokenizer:
    """The ids that the tokenizers library gives for a byte-level BPE file.

    With ``added``, the file's added tokens in a text give their own ids, as the library does by
    default, and the stretches between them are encoded on their own; without, they are ordinary text.

    A text in which no blank meets other white space is cut before blanks; pieces already seen in
    the task are looked up (bounded), the rest go through tiktoken with the file's own ranks. A text
    with U+0000 (which marks a text's first piece) goes through tiktoken whole.
    """

    def __init__(self, path: str, most: int = 700_000, added: bool = False):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        vocabulary, found = library.get_vocab(with_added_tokens=False), library.get_added_tokens_decoder()
        if added and any(t.single_word or t.lstrip or t.rstrip or (t.normalized and library.normalizer) for t in found.values()):
            raise ValueError("added tokens that depend on what is around them are not supported")
        self.added = {t.content: i for i, t in found.items()} if added else {}
        # the leftmost, and of those the longest
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte = self._alphabet()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}
        # a special token of the vocabulary is never the result of merges
        ranks = {k: v for k, v in ranks.items() if not (k.startswith(b"<|") and k.endswith(b"|>"))}
        self.encode_piece = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = max([*vocabulary.values(), *found]) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes | None] = {}
        self.most = most

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """Visible characters stand for their own byte, the others for code points from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def _piece(self, piece: str) -> bytes | None:
        first = piece[:1] == "\0"
        if not piece or piece == "\0" or piece[-1].isspace() or (not first and piece[0].isspace()):
            return None
        return np.array(self.encode_piece(piece[1:] if first else " " + piece), self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.cut is not None and self.cut.search(text):
            return b"".join([np.array([self.added[t]], self.dtype).tobytes() if t in self.added else self._plain(t) for t in self.cut.split(text)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if "\0" in text:
            return np.array(self.encode_piece(text), self.dtype).tobytes()
        known = self.known
        if len(known) > self.most:
            known.clear()
        pieces = ("\0" + text).split(" ")
        for p in set(pieces).difference(known):
            known[p] = self._piece(p)
        try:
            return b"".join([known[p] for p in pieces])
        except TypeError:  # a blank meets white space
            return np.array(self.encode_piece(text), self.dtype).tobytes()


def _projection(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))


def curve_keys(ids: list[np.ndarray], seed: int = 5) -> np.ndarray:
    """Hilbert keys of token lists: hashed log counts, unit length, random projection, grid cell."""
    n = len(ids)
    size = np.array([len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.uint64) if n else np.zeros(0, np.uint64)
    bucket = (mix64(np.arange(1 << 17, dtype=np.uint64)) >> np.uint64(54)).astype(np.int64)[flat.astype(np.int64) & ((1 << 17) - 1)]
    counts = np.bincount(np.repeat(np.arange(n), size) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    v = np.log1p(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    z = v @ _projection(seed)
    cells = np.clip((z + 3.0) / 6.0 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells, BITS)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, ids: narrow little-endian ids (with the end id) and the Hilbert key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None
        for batch in batches:
            tok = tok or FastTokenizer(tokenizer, added=True)
            end = np.array([end_id], tok.dtype).tobytes()
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                blobs = [tok.encode(t or "") + end for t in part.column(1).to_pylist()]
                keys = curve_keys([np.frombuffer(b, tok.dtype) for b in blobs])
                width = pa.array([tok.dtype.itemsize] * len(blobs), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), width, pa.array(blobs, pa.binary())], ["doc_id", "key", "width", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, key long, width int, ids binary")


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, *, max_tokens: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``max_tokens`` ids, neighbours on the curve together.

    Each document's ids end with ``end_id``. A task fills its sequences one after another, cutting
    documents where a sequence is full; the rest at the end of a task is cut into sequences whose
    lengths are powers of two, so that nothing is padded. Columns: doc_id, start (ids of the
    document before the piece), length, ids (32-bit little-endian), doc_tokens, sequence_id,
    offset. A null text counts as empty (one piece, the end id alone); a null id stays null;
    repeated rows are packed each; ties on the curve are ordered by id and by ids; an empty table
    gives no pieces; other columns are not read. A document's ids pass through one task, its own.
    """
    tokens = write_table(tokenize(docs, tokenizer, end_id, id_col=id_col, text_col=text_col), "packing")
    order = [F.col("key"), F.col("doc_id"), F.xxhash64("ids")]
    along = tokens.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequence, fill = 0, 0
        held: list[list] = []  # pieces of the sequence that isn't full yet
        out: list[list] = []

        def emit(rows: list[list]) -> pa.RecordBatch:
            c = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            doc_ids, blobs, widths = batch.column(0).to_pylist(), batch.column(2), batch.column(1).to_pylist()
            for doc_id, blob, width in zip(doc_ids, blobs, widths, strict=True):
                ids = np.frombuffer(blob.as_buffer(), "<u2" if width == 2 else "<u4")
                start, total = 0, len(ids)
                while start < total:
                    length = min(total - start, max_tokens - fill)
                    held.append([doc_id, start, length, ids[start : start + length].astype("<u4").tobytes(), total, base + sequence, fill])
                    start += length
                    fill += length
                    if fill == max_tokens:
                        out += held
                        held, fill = [], 0
                        sequence += 1
                if len(out) >= 1000:
                    yield emit(out)
                    out = []
        rest = fill
        pieces = held[::-1]
        while rest:
            size = 1 << (rest.bit_length() - 1)
            fill = 0
            while fill < size:
                doc_id, start, length, ids, total, _, _ = pieces.pop()
                part = min(length, size - fill)
                out.append([doc_id, start, part, ids[: 4 * part], total, base + sequence, fill])
                fill += part
                if part < length:
                    pieces.append([doc_id, start + part, length - part, ids[4 * part :], total, 0, 0])
            sequence += 1
            rest -= size
        if out:
            yield emit(out)

    return along.select("doc_id", "width", "ids").mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """The query's columns: the piece's ids as their crc32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
