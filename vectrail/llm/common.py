"""Shared plumbing of the corpus operators: scratch tables, samples, components, hashing."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Most bytes of an Arrow batch while an operator's own tables are written: what a JVM task and its Python worker hold at once.
ARROW_BYTES = 4 << 20
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What is set while a table is written. A written table is read from its files, so its shuffle files go at once, not when the driver happens to collect its garbage.
_WHILE_WRITING = {_ARROW_SETTING: str(ARROW_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_OWN_ROOTS: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only on a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_ROOTS:
            _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="vectrail-")
        root = _OWN_ROOTS[app]
    return root.rstrip("/")


def write_table(df: DataFrame, label: str, into: DataFrame | None = None) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder (or add it to the table ``into``) and read it back.

    Lost executors only cost their running tasks afterwards. The table lives until the
    application ends (or until drop_table), since lazy results may still read it.
    """
    spark = df.sparkSession
    path = into._vectrail_path if into is not None else f"{scratch_root(spark)}/vectrail/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("append").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _WRITTEN.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._vectrail_path = path
    return table


def write_in_parts(part, label: str, parts: int) -> DataFrame:
    """One table of part(0), part(1), ..., written one after the other, so that only one part's exchanges are on disk."""
    table = None
    for k in range(parts):
        table = write_table(part(k), label, table)
    return table


def drop_table(table: DataFrame) -> None:
    """Delete a scratch table that no later result reads."""
    path = getattr(table, "_vectrail_path", None)
    if path:
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the gateway may be gone at exit; the folder is scratch space
            break


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, limit: int, extra: list[str]) -> DataFrame:
    """At most about ``limit`` rows, chosen by the hash of ``key`` alone.

    The threshold comes from a count of the narrow columns, so texts are only read for
    the rows kept, and a rerun takes the same rows. Small inputs are taken whole.
    """
    n = df.select(key).count()
    if n <= limit:
        return df.select(key, *extra)
    share = limit / n
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1_000_003)) < int(share * 1_000_003)).select(key, *extra)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, id_col: str, text_col: str) -> DataFrame:
    """text, label, part, turn of labelled documents, at most about ``sample`` // 2 of either label.

    The sample is taken from the labels alone, so what is broadcast to the documents is bounded by it.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    few = [bounded_sample(known.where(w), id_col, sample // 2, ["label"]) for w in ("label = 1", "label <> 1")]
    key = few[0].union(few[1]).select(F.col(id_col).cast("long").alias("label_id"), (F.col("label") == 1).cast("int").alias("label"))
    text = docs.select(F.col(id_col).cast("long").alias("label_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64(F.col("label_id"), F.lit(29)), F.lit(5)).cast("int").alias("part")
    return text.join(F.broadcast(key), "label_id").select("text", "label", part, F.xxhash64(F.col("label_id"), F.lit(31)).alias("turn"))


def platt(x: np.ndarray, y: np.ndarray, positive: float = 0.5) -> tuple[float, float]:
    """Slope (positive) and shift of the log odds of label 1 over a margin x, label 1 weighing ``positive`` of the whole."""
    unit = max(1e-9, float(np.std(x)))
    x = np.stack([x / unit, np.ones(len(x))], axis=1)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    c = np.where(y == 1, positive / max(1, y.sum()), (1 - positive) / max(1, (y == 0).sum())) * len(y)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (c * (q - t)) + 1e-2 * (b - [1.0, 0.0])
        h = (x * (c * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(b[0], 0.05)) / unit, float(b[1])


# ---------------------------------------------------------------- hashing in numpy


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Odd base of the polynomial hashes modulo 2**64, its inverse, and a random value for each byte.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; grown by doubling and kept in the worker."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: H[j] = sum of values[i] * BASE**i for i < j, modulo 2**64."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each [start, end), independent of where it starts (Rabin-Karp by prefix sums)."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` values."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, dtype=U64)
    _, down = powers(n)
    return (prefix[width:] - prefix[:n]) * down


#: Prime modulus 2**61 - 1 of the Rabin-Karp hashes that decide on their own, and a base of them.
PRIME = (1 << 61) - 1
PRIME_BASE = 0x1B873593CC9E2D51
_M30, _M31, _P = U64((1 << 30) - 1), U64((1 << 31) - 1), U64(PRIME)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for a and b below it."""
    a1, a0, b1, b0 = a >> U64(31), a & _M31, b >> U64(31), b & _M31
    middle = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << U64(1)) + (middle >> U64(30)) + ((middle & _M30) << U64(31)) + a0 * b0)


def _prime_powers(base: int, n: int) -> np.ndarray:
    key = f"prime-{base}"
    have = _POWERS.get(key, np.ones(1, U64))
    while len(have) < n:
        step = np.full(len(have), pow(base, len(have), PRIME), U64)
        have = np.concatenate([have, mulmod(have, step)])
    _POWERS[key] = have
    return have[:n]


def window_hash61(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**61 - 1 of every window of ``width`` values, from prefix sums.

    Two different windows collide for at most width of the 2**61 bases, whatever they hold.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    x = mulmod(_reduced(values), _prime_powers(PRIME_BASE, len(values)))
    high, low = np.cumsum(x >> U64(31)), np.cumsum(x & _M31)
    prefix = np.append(U64(0), _reduced((high >> U64(30)) + ((high & _M30) << U64(31)) + _reduced(low)))
    return mulmod(_reduced(prefix[width:] + (_P - prefix[:n])), _prime_powers(pow(PRIME_BASE, -1, PRIME), n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span, y = 1, x
    while span * 2 <= width:
        y = np.minimum(y[: len(y) - span], y[span:])
        span *= 2
    if span < width:
        y = np.minimum(y[:n], y[width - span : width - span + n])
    return y[:n]


#: Runs of more than so many lanes are hashed by blake2b instead of lane by lane.
MOST_LANES = 64
_LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def byte_lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros after the end)."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def content_hash(lanes: np.ndarray, step: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the content of each run [start, end), wherever it starts.

    A lane holds ``step`` symbols (8 bytes, or 1 wide value). Each lane is mixed in by a function that is
    not linear, so there is no algebraic collision, as there is for any polynomial modulo 2**64
    (Thue-Morse words). Runs of at most one lane and equal length never collide.
    """
    size = end - start
    out = mix64(size.astype(U64) * U64(0x632BE59BD9B4E019) + U64(0x9FB21C651E98DF25))
    count = -(-size // step)
    rows = np.flatnonzero((count > 0) & (count <= MOST_LANES))
    at, left, h = start[rows], size[rows], out[rows]
    while len(rows):
        x = lanes[at]
        if step > 1:
            x = x & _LANE_MASK[np.minimum(left, step)]
        h = mix64((h ^ x) + U64(0xA0761D6478BD642F))
        more = left > step
        if not more.all():
            out[rows[~more]] = h[~more]
            rows, at, left, h = rows[more], at[more], left[more], h[more]
        at, left = at + step, left - step
    for i in np.flatnonzero(count > MOST_LANES).tolist():
        content = np.ascontiguousarray(lanes[start[i] : end[i] : step])
        if step > 1 and size[i] % step:
            content[-1] &= _LANE_MASK[size[i] % step]
        out[i] = int.from_bytes(hashlib.blake2b(content.tobytes() + int(size[i]).to_bytes(8, "little"), digest_size=8).digest(), "little")
    return out


#: Whitespace bytes of a word separator: tab to carriage return, and the blank.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separator bytes."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    solid = np.empty(len(raw) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    np.logical_not(SPACE[raw], out=solid[1:-1].view(bool))
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def slices(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """Cut consecutive rows into runs of at most ``most`` units (a longer row stands alone)."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges has columns u, v (long, u != v). Returns node, component (smallest node) for all
    nodes on an edge. Neighbourhoods are only aggregated by min and joined back, so a hub
    is never gathered in one task (the joins are plain equi-joins, which AQE splits).
    Each round is written to the shared scratch folder.
    """

    def star(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every edge now points from the larger to the smaller node
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low2, large.u == low2.k)
        return (
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select(F.col("k").alias("u"), F.col("m").alias("v")))
            .distinct()
        )

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = write_table(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), "cc")
    seen = None
    for _ in range(rounds):
        after = write_table(star(now), "cc")
        drop_table(now)
        now, last, seen = after, seen, mark(after)
        if seen == last or seen[0] == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
