"""Byte-level BPE encoding and decoding with numpy merge rounds.

Rows are pre-token byte strings in length-bucketed padded matrices. In each round every row
merges its leftmost pair of minimum rank; pairs are found in an open-addressed hash table;
rows are compacted after the merge and finished rows leave the matrix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

NO_RANK = np.iinfo(np.int32).max


class PairTable:
    """Hash lookup (left id, right id) -> merged id, over open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(max(1, len(key)) * 3 - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full(1 << self.bits, NO_RANK, dtype=np.int32)
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 1
        while len(todo):
            free = self.keys[slot[todo]] == np.iinfo(np.uint64).max
            take, first = np.unique(slot[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[take], self.values[take] = key[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(todo))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        flat = key.ravel()
        out = np.full(flat.shape, NO_RANK, dtype=np.int32)
        slot, todo = self._slot(flat), np.arange(len(flat))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == flat[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != np.iinfo(np.uint64).max)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out.reshape(left.shape)


class Codec:
    """Ranks of one vocabulary; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():  # every split of a token into two tokens merges to it
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.table = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))

    def merge(self, words: list[bytes], cells: int = 1 << 20) -> list[bytes]:
        """Ids of each word, as the bytes of an int32 array. Buckets hold words of similar length, at most about ``cells`` cells."""
        out = [b""] * len(words)
        length = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        start = 0
        while start < len(order):
            # rows of at most 1.25 times (plus 2) the shortest row's length share a matrix
            least = int(length[order[start]])
            end = int(np.searchsorted(length[order], least * 5 // 4 + 2, side="right"))
            end = max(start + 1, min(end, start + max(1, cells // (least + 2))))
            rows = order[start:end]
            for row, ids in zip(rows.tolist(), self._bucket([words[i] for i in rows], length[rows]), strict=True):
                out[row] = ids
            start = end
        return out

    def _bucket(self, words: list[bytes], length: np.ndarray) -> list[bytes]:
        n, width = len(words), int(length.max())
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        valid = np.arange(width) < length[:, None]
        ids = np.full((n, width), -1, dtype=np.int32)
        ids[valid] = self.byte_id[raw]
        done = [b""] * n
        row, size = np.arange(n), length.copy()
        # ranks of adjacent pairs are kept and only those beside a merge are looked up again
        rank = np.full((n, width), NO_RANK, dtype=np.int32)
        if width > 1:
            pair = valid[:, 1:]
            rank[:, :-1][pair] = self.table.get(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(row):
            at = rank.argmin(axis=1)  # the leftmost of the minimum
            best = rank[np.arange(len(row)), at]
            finished = best == NO_RANK
            if finished.any():
                for i in np.flatnonzero(finished).tolist():
                    done[row[i]] = ids[i, : size[i]].tobytes()
                on = ~finished
                row, size, ids, rank, at, best = row[on], size[on], ids[on], rank[on], at[on], best[on]
                if not len(row):
                    break
            # compaction: every row gives up the column right of its merged pair
            n, r = len(row), np.arange(len(row))
            ids[r, at] = best
            keep = np.ones(ids.shape, dtype=bool)
            keep[r, at + 1] = False
            ids, rank = ids[keep].reshape(n, -1), rank[keep].reshape(n, -1)
            size = size - 1
            rank[r, at] = NO_RANK
            near = np.flatnonzero(at + 1 < size)
            a = at[near]
            rank[near, a] = self.table.get(ids[near, a], ids[near, a + 1])
            near = np.flatnonzero(at)
            a = at[near]
            rank[near, a - 1] = self.table.get(ids[near, a - 1], ids[near, a])
        return done

    # -------------------------------------------------------------- texts

    def encoder(self, most: int = 700_000) -> "TextEncoder":
        return TextEncoder(self, most)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a list of ids; an unknown id raises ValueError."""
        known = self.tokens
        if len(ids) and (ids.min() < 0 or ids.max() >= len(known)):
            raise ValueError("an id is not in the vocabulary")
        return b"".join([known[i] for i in ids.tolist()])


def _one_word(piece: str) -> bool:
    """Whether a piece is a single match of the pattern: Latin letters after at most one blank."""
    word = piece[1:] if piece[:1] == " " else piece
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class TextEncoder:
    """Encodes texts; pieces seen before in this task are looked up. Bounded to ``most`` pieces.

    A text in which no blank meets other white space is cut before each blank: no match of the
    pattern reaches over such a place. Other texts, and texts with U+0000 (which marks a text's
    first piece), are matched as a whole.
    """

    def __init__(self, codec: Codec, most: int):
        self.codec, self.most = codec, most
        self.piece: dict[str, bytes | None] = {}  # None: a blank may meet white space here
        self.word: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.word]
        self.word.update(zip(new, self.codec.merge([w.encode() for w in new]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.piece) > self.most:
            self.piece.clear()
        if len(self.word) > self.most:
            self.word.clear()
        known, find = self.piece, self.codec.pattern.findall
        # the first piece has no blank before it, which its leading "\0" marks
        whole = ["\0" in text for text in texts]
        pieces = [("\0" + text).split(" ") if text and not w else [] for text, w in zip(texts, whole, strict=True)]
        new = [p for p in set().union(*pieces) if p not in known]
        split: list[list[str] | None] = []
        for p in new:
            first = p[:1] == "\0"
            if not p or p == "\0" or p[-1].isspace() or (not first and p[0].isspace()):
                split.append(None)
                continue
            own = p[1:] if first else " " + p
            split.append([own] if _one_word(own) else find(own))
        self._learn(set().union(*[ws for ws in split if ws]))
        word = self.word
        for p, ws in zip(new, split, strict=True):
            known[p] = ws and (word[ws[0]] if len(ws) == 1 else b"".join([word[w] for w in ws]))
        out = []
        for text, ps, w in zip(texts, pieces, whole, strict=True):
            try:
                ids = None if w else b"".join([known[p] for p in ps])
            except TypeError:
                ids = None
            if ids is None:
                words = find(text)
                self._learn(set(words))
                ids = b"".join([word[w] for w in words])
            out.append(np.frombuffer(ids, np.int32))
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>): the BPE ids of each whole text.

    A null text counts as empty and gives an empty list; a null id stays null; repeated rows each
    give a row; an empty table gives an empty table; other columns are not read, so their names
    cannot clash. Very long texts are encoded whole; memory is bounded by the row and the cache.
    rank_file is a path on every executor (an installed package's file), read once a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or codec(rank_file, pattern).encoder()
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                ids = coder.encode([t or "" for t in texts[i : i + 256]])
                sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(ids)), lists], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids, bytes (binary): the bytes that the ids stand for. Null ids decode to empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lists = codec(rank_file, pattern), batch.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            empty = lists.is_null().to_numpy(zero_copy_only=False)
            texts = [b"" if empty[i] else own.decode(values[offsets[i] : offsets[i + 1]]) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The query's digest columns, from the operator's ids and bytes."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )
