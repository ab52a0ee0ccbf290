import numpy as np
import pytest
from pyspark.sql import types as T

from vectrail.llm import neighbours

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, threshold):
    ok = {i: (np.array(v, np.float32).astype(float), g) for i, v, g in rows if v is not None and g is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(i for i, _, _ in rows)
    root, count = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(ok)
    for p, i in enumerate(keys):
        for j in keys[p + 1 :]:
            (a, g), (b, h) = ok[i], ok[j]
            if g == h and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                count[i] += 1
                count[j] += 1
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: (count[i], find(i), find(i) == i) for i in ids}


def table(seed, n=240, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    base = rng.standard_normal((12, dim))
    for i in range(n):
        v = rng.standard_normal(dim)
        if i % 3:  # copies near a few bases; the first base has many
            v = base[int(rng.integers(0, 12)) if rng.random() < 0.6 else 0] * rng.uniform(0.5, 2) + rng.standard_normal(dim) * rng.choice([0, 0.02, 0.08, 0.2])
        rows.append((i * 3, [float(x) for x in v], int(rng.integers(0, 2))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_brute_force(spark, seed):
    rows = table(seed)
    rows += [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0] * 15 + [None], 1), (9004, [float("nan")] * 16, 1), (9005, rows[1][1], None), (9006, [], 0), (9007, [1.0, 2.0], 0), (9008, [1.0, 2.0], 0)]
    out = neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.rows.collect()}
    want = brute(rows, 0.98)
    assert out.recall >= 0.9
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in got)  # no link below the threshold
    assert got == want


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], 2)]
    got = neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA)).rows.collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, None, None, None)}
    assert neighbours.near_duplicates(spark.createDataFrame([], SCHEMA)).rows.count() == 0


def test_links_between_saturated_groups(spark):
    # two groups of twelve: the ten nearest of each vector lie in its own group, yet all 24 are linked
    rng = np.random.default_rng(4)
    base, aside = rng.standard_normal(64), rng.standard_normal(64)
    aside -= base * (aside @ base) / (base @ base)
    centre = [base, base + 0.15 * aside * np.linalg.norm(base) / np.linalg.norm(aside)]
    rows = [(i, [float(x) for x in centre[i % 2] + 0.005 * rng.standard_normal(64)], 1) for i in range(24)]
    rows += [(100 + i, [float(x) for x in rng.standard_normal(64)], 1) for i in range(60)]
    out = neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.rows.collect()}
    want = brute(rows, 0.98)
    assert sum(w[0] for w in want.values()) == 24 * 23
    assert got == want
    assert out.recall == 1.0


def test_short_recall_compares_every_vector(spark):
    rows = table(5)
    found = neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA), rounds=0, tables=1, k=2, least_recall=1.01)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.rows.collect()} == brute(rows, 0.98)


def test_equals_sql_on_a_table_with_links(spark, tmp_path):
    import duckdb

    from vectrail.llm import queries

    # 4,000 vectors in clusters of 1 to 60 of each label
    rng = np.random.default_rng(8)
    rows = []
    while len(rows) < 4000:
        base = rng.standard_normal(32)
        spread = rng.choice([0.0, 0.02, 0.03, 0.05])
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.choice([1, 1, 2, 5, 20, 60]))):
            rows.append((len(rows), [float(x) for x in np.float32(base + spread * rng.standard_normal(32))], label))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op3_neighbours(spark, str(tmp_path)).toPandas()
    # only near pairs can be reached, so the closure may start from the linked vectors alone
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet").toPandas()
    x = np.stack(e["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sql = duckdb.connect()
    near = np.argwhere((x @ x.T >= 0.97) & (e["label"].to_numpy()[:, None] == e["label"].to_numpy()[None, :]))
    linked = sorted({int(i) for i, j in near if i != j})
    sql.register("embeddings", e[e["vec_id"].isin(e["vec_id"].iloc[linked])])
    want = sql.sql(queries.OP3_SQL).df().set_index("vec_id")
    got = got.set_index("vec_id")
    assert got["n_links"].sum() == want["n_links"].sum() > 30_000
    assert (got.loc[want.index, ["n_links", "component_id", "kept"]] == want[["n_links", "component_id", "kept"]]).all().all()
    rest = got.drop(want.index)
    assert (rest["n_links"] == 0).all() and rest["kept"].all()
    assert set(got["link_recall"]) == {1.0}
