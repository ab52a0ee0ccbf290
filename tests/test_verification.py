import math

import pytest

from vectrail.operators import verification as v


def pairs(spark, *rows):
    return spark.createDataFrame([(float(s), g) for s, g in rows], "score double, is_genuine boolean")


def test_rates_at_thresholds(spark):
    p = pairs(spark, (0.9, True), (0.8, False), (0.4, True), (0.3, False))
    got = {r.threshold: (r.fmr, r.fnmr) for r in v.fmr_fnmr(p, [0.5, 0.8, 0.9]).collect()}
    assert got == {0.5: (0.5, 0.5), 0.8: (0.5, 0.5), 0.9: (0.0, 0.5)}


def test_roc_corners(spark):
    got = sorted((r.threshold, r.fmr, r.fnmr) for r in v.roc(pairs(spark, (0.9, True), (0.2, False))).collect())
    assert got == [(0.2, 1, 0), (0.9, 0, 0), (math.nextafter(0.9, 2), 0, 1)]


@pytest.mark.parametrize("rows,want", [
    ([(0.9, True)] * 8 + [(0.1, False)] * 12, 0.0), ([(0.42, True)] * 3 + [(0.42, False)] * 4, 0.5),
    ([(0.7, True), (0.7, False), (0.2, True), (0.2, False)], 0.5), ([(0.6, True), (0.4, True), (0.5, False), (0.3, False)], 0.5),
    ([(0.05, True)] + [(0.9, True)] * 7 + [(0.1, False)] * 12, 0.125),
])
def test_eer(spark, rows, want):
    assert v.eer(v.roc(pairs(spark, *rows))).first().eer == pytest.approx(want)


@pytest.mark.parametrize("rows,target,want", [
    ([(0.6, True), (0.4, True), (0.5, False), (0.3, False)], 0.0, 0.5), ([(0.6, True), (0.4, True), (0.5, False), (0.3, False)], 1.0, 0.0),
    ([(0.5, True), (0.3, True), (0.5, False), (0.4, False)], 0.75, 0.25), ([(0.5, True), (0.3, True), (0.5, False), (0.4, False)], 0.5, 0.5),
])
def test_fmr_at_fnmr(spark, rows, target, want):
    assert v.fmr_at_fnmr(v.roc(pairs(spark, *rows)), target).first().fmr_at_fnmr == pytest.approx(want)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, persona_id int, emb array<double>")


def test_pair_counts(spark):
    t = items(spark, [(i, p, [1.0 + i, 2.0]) for i, p in enumerate([0, 0, 1, 1, 2])])
    got = v.pair_scores(t).collect()
    assert len(got) == 10 and sum(r.is_genuine for r in got) == 2 and all(r.i < r.j for r in got)
    t = items(spark, [(i, i // 2, [1.0 + i, 2.0]) for i in range(6)])
    got = v.probe_gallery_scores(t, t).collect()
    assert (len(got), sum(r.is_genuine for r in got)) == (36, 12)


def test_sweep_and_degenerate_conditions(spark):
    t = items(spark, [(0, 0, [0.01, 0.02]), (1, 0, [1.0, 0.1]), (2, 1, [0.2, 1.0]), (3, 1, [0.3, 2.0])])
    rows = {r.severity: r for r in v.sweep(t, v.quantised_pairs(t, [0.0, 0.5, 9.0]), [0.0, 0.5, 9.0]).collect()}
    assert (rows[0.0].n_scored, rows[0.0].n_query_dropped, rows[0.0].n_pairs) == (4, 0, 16)
    assert (rows[0.5].n_scored, rows[0.5].n_query_dropped, rows[0.5].n_pairs) == (3, 1, 9)
    assert (rows[9.0].n_scored, rows[9.0].n_query_dropped, rows[9.0].eer, rows[9.0].n_pairs) == (0, 4, None, None)


def test_check_pairs(spark):
    v.check_pairs(pairs(spark, (0.1, True), (0.2, False)))
    for bad in ([(0.1, True)], [(0.1, True), (float("nan"), False)]):
        with pytest.raises(ValueError):
            v.check_pairs(pairs(spark, *bad))


def test_roc_is_monotone(spark):
    import random

    rng = random.Random(1)
    points = sorted((r.threshold, r.fmr, r.fnmr) for r in v.roc(pairs(spark, *[(round(rng.random(), 2), rng.random() < 0.4) for _ in range(300)])).collect())
    assert all(a[1] >= b[1] and a[2] <= b[2] for a, b in zip(points, points[1:]))


def test_counters_equal_the_curve(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 8))
    t = items(spark, [(i, i % 6, [float(x) for x in base[i % 6] + rng.standard_normal(8) * 0.7]) for i in range(60)])
    scored, rows = v.all_pairs(t), v.pair_scores(t)
    targets = [0.0, 0.01, 0.1, 0.5, 1.0]
    want = v.operating_points(v.roc(rows), targets).first().asDict()
    assert scored.operating_points(targets).first().asDict() == pytest.approx(want)
    key = lambda r: tuple(round(x, 9) for x in r)
    assert sorted(map(key, scored.points().collect())) == sorted(map(key, v.roc(rows).collect()))
    cuts = [0.3, -0.2, 0.9, 0.3 + 1e-9]
    assert sorted(map(key, scored.rates(cuts).collect())) == sorted(map(key, v.fmr_fnmr(rows, cuts).collect()))


def test_gate_ablation_degenerate_subsets(spark):
    t = spark.createDataFrame([(0, 0, 0.9, [1.0, 0.1]), (1, 0, 0.9, [0.9, 0.2]), (2, 1, 0.1, [0.1, 1.0]), (3, 1, 0.1, [0.2, 1.0])], "item_id long, persona_id int, quality double, emb array<double>")
    rows = {(r.severity, r.subset): r for r in v.gate_ablation(t, [0.0, 5.0], 0.5, 0.5).collect()}
    assert (rows[0.0, "full"].n, rows[0.0, "full"].eer, rows[0.0, "full"].n_pairs) == (4, 0.0, 16)
    gated = rows[0.0, "gated"]  # two items of one identity
    assert (gated.n, gated.pass_rate, gated.eer, gated.fmr, gated.n_pairs) == (2, 0.5, None, None, None)
    assert (rows[5.0, "full"].n, rows[5.0, "full"].fmr, rows[5.0, "gated"].n, rows[5.0, "gated"].pass_rate) == (0, None, 0, 0.0)


def test_pairs_of_blocks_are_not_exchanged(spark):
    t = items(spark, [(i, i // 2, [1.0 + i, 2.0]) for i in range(6)])
    for scored in (v.all_pairs(t), v.probes_and_gallery(t, t, ["persona_id"]), v.quantised_pairs(t, [0.0, 0.5])):
        above, _, below = scored.rows()._jdf.queryExecution().executedPlan().toString().partition("CartesianProduct")
        assert "MapInArrow" in above and "Exchange" not in above and "REPARTITION_BY_NUM" in below


def test_blocks_of_a_key_are_filled_by_its_own_rows(spark):
    import pyarrow as pa

    from vectrail.operators import blocks

    t = spark.createDataFrame([(i, i % 10, [1.0 + i, 2.0]) for i in range(3000)], "item_id long, k int, emb array<double>")
    kernel = lambda scores, q, c, same: blocks.batch(n=pa.array([scores.size]))
    met = blocks.cosine_blocks(t, t, kernel, "n long, k int", query_columns=["item_id", "emb"], item_columns=["item_id", "emb"], on=["k"])
    assert [r.n for r in met.collect()] == [300 * 300] * 10


def test_pairs_are_scored_twice_for_all_metrics(spark):
    import dataclasses

    t = spark.createDataFrame([(i, i % 3, 0.5 + i / 100, [1.0 + i % 7, 2.0 + i % 5, float(i % 4)]) for i in range(40)], "item_id long, persona_id int, quality double, emb array<double>")
    calls = []

    def counted(scored):
        return dataclasses.replace(scored, tally=lambda counter: calls.append(1) or scored.tally(counter))

    scored = dataclasses.replace(counted(v.quantised_pairs(t, [0.0, 1.0], 0.6)), cuts=(0.5,))
    rows, keys = scored.rows(), ["severity", "subset"]
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, scored.operating_points([0.1]).collect())) == sorted(map(key, v.operating_points(v.roc(rows, keys), [0.1], keys).collect()))
    assert sorted(map(key, scored.rates([0.5]).collect())) == sorted(map(key, v.fmr_fnmr(rows, [0.5], keys).collect()))
    assert sum(r.n_pairs for r in scored.totals().collect()) == rows.count() and len(calls) == 2


def test_the_curve_exchanges_no_scores(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(v, "RANGE_BYTES", 8 << v.FINE_BITS + 8)  # ranges of 256 bins
    rng = np.random.default_rng(6)
    t = items(spark, [(i, i % 4, [float(x) for x in rng.standard_normal(4)]) for i in range(70)])
    found = v.all_pairs(t).points()
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().partition("CartesianProduct")[0]
    got = [tuple(r) for r in found.collect()]
    want = sorted(tuple(r) for r in v.roc(v.pair_scores(t)).collect())
    assert got == sorted(got) and got == [pytest.approx(w, abs=1e-12) for w in want] and found.rdd.getNumPartitions() > 10


def test_gated_pairs_are_scored_with_the_full_ones():
    import numpy as np

    rng = np.random.default_rng(8)
    side = {"item_id": np.arange(50), "persona_id": np.arange(50) % 3, "quality": rng.random(50), "unit": rng.standard_normal((50, 4))}
    side["unit"] /= np.linalg.norm(side["unit"], axis=1)[:, None]
    passed = side["quality"] >= 0.4
    found = {}
    for keys, q, c, below, own in v._gated((0.5,), side, side, passed, passed):
        for key in keys:
            n = found.setdefault(key, [0, 0, 0])
            for _, x, genuine in v._slabs(q, c, below):
                n[0] += len(x)
                n[1] += int(genuine(np.arange(len(x))).sum())
            n[2] += own()
    own = lambda rows: [len(rows) ** 2, sum(int((rows % 3 == k).sum()) ** 2 for k in range(3)), len(rows)]
    assert found == {(0.5, "full"): own(np.arange(50)), (0.5, "gated"): own(np.flatnonzero(passed))}
    parts = [len(q["unit"]) * len(c["unit"]) for _, q, c, _, _ in v._gated((0.5,), side, side, passed, passed)]
    assert sum(parts) == 2500 and v._equal(side, side).tolist() == np.flatnonzero(np.arange(50)[:, None] % 3 == np.arange(50)[None, :] % 3).tolist()


def test_images_are_exchanged_once_and_clean_vectors_come_along(spark):
    from vectrail.plans import experiment

    rows = [(i, i % 2, 2, 2, bytes(range(i, i + 12))) for i in range(6)]
    images = spark.createDataFrame(rows, "item_id long, label int, height int, width int, data binary")
    whole = lambda stack: [[float(x) + 1 for x in image.ravel()] for image in stack]
    vectors = experiment.embedded(images, [("brightness", 0.1), ("clean", 0.0)], whole)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # no copy of the pixels for each condition
    probe, gallery, _ = experiment.aligned(vectors.persist())
    for side in (probe, gallery):
        assert "Join" not in side._jdf.queryExecution().optimizedPlan().toString().partition("InMemoryRelation")[0]
    assert {r.item_id: list(r.emb) for r in gallery.where("ordinal = 0").collect()} == {i: [float(x) + 1 for x in data] for i, _, _, _, data in rows}


def test_a_gate_over_probes_equals_two_sets(spark):
    t = spark.createDataFrame([(i, i % 3, 0.1 * (i % 10), i % 2, [1.0 + i % 7, 2.0 + i % 5, float(i % 4)]) for i in range(60)], "item_id long, persona_id int, quality double, k int, emb array<double>")
    scored = v.probes_and_gallery(t, t, ["k"], 0.5)
    key = lambda r: tuple(sorted((k, round(x, 9) if isinstance(x, float) else x) for k, x in r.asDict().items()))
    for name, side in (("full", t), ("gated", t.where("quality >= 0.5"))):
        alone = v.probes_and_gallery(side, side, ["k"])
        for found in (lambda s: s.totals(), lambda s: s.operating_points([0.1]), lambda s: s.rows()):
            assert sorted(map(key, found(scored).where(f"subset = '{name}'").drop("subset").collect())) == sorted(map(key, found(alone).collect()))


@pytest.mark.parametrize("floor,spread", [(5e-5, 4), (0.2, 4), (0.0, 4), (0.01, 2), (0.3, 3)])
def test_the_plotted_curve_comes_in_order_without_an_exchange(spark, monkeypatch, floor, spread):
    import numpy as np

    from vectrail.sources import results

    monkeypatch.setattr(v, "RANGE_BYTES", 8 << v.FINE_BITS + 8)  # windows of 256 bins
    rng = np.random.default_rng(spread)
    far = np.repeat(np.eye(3)[:, :spread] * 9, 8, axis=0)[:, : min(spread, 3)]  # with 2 and 3: personas apart, so that long stretches hold no impostor
    rows = [[float(x) for x in rng.standard_normal(spread) + (np.pad(far[i], (0, spread - far.shape[1])) if spread < 4 else 0)] for i in range(24)]
    t = items(spark, [(i, i // 8, e) for i, e in enumerate(rows)])
    found = results.plot_ready(v.all_pairs(t), floor)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().partition("CartesianProduct")[0]
    got = [tuple(r) for r in found.collect()]
    want = [tuple(r) for r in results.plot_ready(v.roc(v.pair_scores(t)), floor).collect()]
    assert [g[1:] for g in got] == [pytest.approx(w[1:], abs=1e-12) for w in want]
    assert sorted(got) == [pytest.approx(w, abs=1e-12) for w in sorted(want)]


def test_gate_bars_score_once(spark, monkeypatch):
    from vectrail import queries

    calls = []
    real = v.blocks.cosine_blocks
    monkeypatch.setattr(v.blocks, "cosine_blocks", lambda *a, **b: calls.append(1) or real(*a, **b))
    bars = queries.gate_bars(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1 and len(bars) == 12
    want = {(r.severity, r.subset): r for r in queries.gate_ablation(spark, "/root/testdata/sf0.001").collect()}
    got = {(r.ordinal, r.metric): (r.full, r.gated, r.pass_rate) for r in bars}
    for k, s in enumerate(queries.SEVERITIES, 1):
        full, gated = want[s, "full"], want[s, "gated"]
        assert got[k, "fmr"] == (full.fmr, gated.fmr, gated.pass_rate) and got[k, "fnmr"] == (full.fnmr, gated.fnmr, gated.pass_rate)


@pytest.mark.parametrize("below", [False, True])
def test_pairs_at_a_cut_are_counted_exactly(below):
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.normal(size=(70, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    other = rng.normal(size=(70, 64))
    other -= (other * a).sum(axis=1)[:, None] * a
    other /= np.linalg.norm(other, axis=1)[:, None]
    # cosines of nearly 0.5: by less and by more than half a place of nine digits
    near = 0.5 + rng.choice([0, 3e-10, -3e-10, 8e-10, -8e-10, 1e-7, -1e-7], 70)
    b = near[:, None] * a + np.sqrt(1 - near**2)[:, None] * other
    ids = np.arange(70)
    for many in (b, np.repeat(b[:3], 40, axis=0)):
        q = {"item_id": ids, "persona_id": ids % 3, "unit": a}
        c = {"item_id": np.arange(len(many)) + 20, "persona_id": np.arange(len(many)) % 3, "unit": many}
        scores = np.round(a @ many.T, 9)
        counted = ids[:, None] < c["item_id"][None, :] if below else np.ones(scores.shape, bool)
        genuine = q["persona_id"][:, None] == c["persona_id"][None, :]
        cuts = [0.5, -0.2, 1.0]
        got = v._reaching(q, c, below, [v._at_least(t) for t in cuts])
        want = [[np.count_nonzero(counted & g & (scores >= t)) for t in (*cuts, -2)] for g in (genuine, np.ones(scores.shape, bool))]
        assert got.tolist() == want


def test_image_sweep_packs_blocks_once(spark, monkeypatch):
    from vectrail.plans import experiment

    packed = []
    real = v.blocks.pack
    monkeypatch.setattr(v.blocks, "pack", lambda df, columns, side, n, on: packed.append((side, df, on)) or real(df, columns, side, n, on))
    rows = [(i, i // 2 % 2, 2, 2, bytes(range(i, i + 12))) for i in range(8)]
    images = spark.createDataFrame(rows, "item_id long, label int, height int, width int, data binary")
    # the bright images of odd first pixel have no vector
    some = lambda stack: [None if image[0, 0, 0] > 100 and image[0, 0, 0] % 2 else [float(x) + 1 for x in image.ravel()] for image in stack]
    found, curve = experiment.sweep(images, [("brightness", 0.4)], some)
    got = {r.condition: r for r in found.collect()}
    gallery = [df for side, df, _ in packed if side == "c"][0]
    assert gallery.count() == 8 and not packed[0][2]  # an item is in one block, not in one for each condition
    assert "InMemoryRelation" in found._jdf.queryExecution().optimizedPlan().toString()
    assert (got["clean"].n_scored, got["clean"].n_pairs, got["brightness"].n_scored, got["brightness"].n_pairs, got["brightness"].n_query_dropped) == (8, 64, 4, 16, 4)
    assert {r.ordinal for r in curve.collect()} == {0, 1}


def test_pairs_leave_a_task_in_runs_of_their_scores(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    emb = np.round(rng.standard_normal((90, 3)), 1) + 0.01
    emb[4], emb[5] = [np.nan, 1, 1], [1e-170] * 3  # without a score, and of a length that no double holds
    person = np.arange(90) % 7
    want = emb / np.sqrt((emb * emb).sum(axis=1))[:, None]
    sides = [{"item_id": np.arange(90)[s], "persona_id": person[s], "unit": want[s]} for s in (slice(0, 90, 2), slice(1, 90, 2))]
    want = np.round(want @ want.T, 9)
    for run, item_bits, query_bits in ((1 << 24, 12, 15), (1500, 12, 15), (1 << 24, 3, 5)):
        for name, value in (("RUN", run), ("SLICE", 400), ("ITEM_BITS", item_bits), ("QUERY_BITS", query_bits)):
            monkeypatch.setattr(v, name, value)
        add, finish = v._runs(True)
        found = [x for q, c, below in ((0, 0, True), (1, 0, False), (1, 1, True)) for x in add([("k",)], sides[q], sides[c], below, int)]
        found += finish()
        assert {key for key, *_ in found} == {("k",)} and max(len(i) for _, i, *_ in found) <= 400
        i, j, score, genuine = (np.concatenate([x[n] for x in found]) for n in (1, 2, 3, 4))
        assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(90) for b in range(a + 1, 90)]
        np.testing.assert_array_equal(score, want[i, j])
        np.testing.assert_array_equal(genuine, person[i] == person[j])
        if run > 1500 and item_bits == 12:
            assert np.isnan(score[-89:]).all() and np.isinf(score).any() and (np.diff(score[np.isfinite(score)]) >= 0).all()

    monkeypatch.undo()
    t = items(spark, [(int(k), int(person[k]), [float(x) for x in emb[k]]) for k in range(90) if k not in (4, 5)])
    seen = v.pair_scores(t).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([bool((np.diff(b.column(2).to_numpy()) >= 0).all())]), pa.array([b.num_rows])], ["ordered", "n"]) for b in batches), "ordered boolean, n long").collect()
    assert all(r.ordered for r in seen) and sum(r.n for r in seen) == 88 * 87 // 2


def test_scores_of_pairs_are_rounded_as_all_others(spark):
    from vectrail import queries

    digits = [*range(-1_000_000_000, 1_000_000_001, 7_654_321), *range(-3000, 3001, 125), *[s * (k * 1000 + 500) for k in range(0, 10**6, 997) for s in (-1, 1)]]
    t = spark.createDataFrame([(0, 1, k / 10**9, True) for k in digits] + [(0, 1, x, True) for x in (float("nan"), float("inf"), -0.0)], "i long, j long, score double, is_genuine boolean")
    assert list(map(repr, queries.rounded_scores(t).collect())) == list(map(repr, queries.rounded(t).collect()))


def test_degraded_probes_against_all_items_come_in_the_order_of_scores(spark):
    import numpy as np
    import pyarrow as pa

    emb = np.round(np.random.default_rng(8).standard_normal((70, 4)), 2)
    emb[9] = 0.1  # nothing is left of it
    t = items(spark, [(k, k % 6, [float(x) for x in emb[k]]) for k in range(70)])
    rows = v.condition_pairs(t, [0.5])
    seen = np.floor(emb / 0.5 + 0.5) * 0.5
    left = np.flatnonzero(seen.any(axis=1)).tolist()
    assert 9 not in left
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1))[:, None]
    want = np.round(unit(seen[left]) @ unit(emb[left]).T, 9)
    got = {(r.i, r.j): (r.score, r.is_genuine, r.severity) for r in rows.collect()}
    assert got == {(i, j): (pytest.approx(want[x, y], abs=2e-9), i % 6 == j % 6, 0.5) for x, i in enumerate(left) for y, j in enumerate(left)} and rows.count() == len(left) ** 2
    order = rows.select("score").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([bool((np.diff(b.column(0).to_numpy()) >= 0).all())])], ["ordered"]) for b in batches), "ordered boolean").collect()
    assert order and all(r.ordered for r in order)


def halfway_items():
    """48 vectors of 64 components; those of 2k and 2k + 1 have a cosine that is halfway between two numbers of nine digits, or a last bit beside it."""
    import numpy as np

    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(2, 24, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    near = (rng.integers(-900_000_000, 900_000_000, 24) + 0.5) / 1e9
    near[0] = 0.5 * 1e-9
    b = near[:, None] * a + np.sqrt(1 - near**2)[:, None] * b
    return np.stack([a, b * 3], axis=1).reshape(48, 64)


@pytest.fixture(scope="module")
def halfway_pairs():
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE TABLE items (item_id BIGINT, persona_id INT, emb DOUBLE[])")
    con.executemany("INSERT INTO items VALUES (?, ?, ?)", [(k, k % 5, e.tolist()) for k, e in enumerate(halfway_items())])
    con.sql("CREATE TABLE pairs AS SELECT a.item_id AS i, b.item_id AS j, round(list_cosine_similarity(a.emb, b.emb), 9) AS score, a.persona_id = b.persona_id AS is_genuine FROM items a JOIN items b ON a.item_id < b.item_id")
    return con


def test_scores_halfway_are_rounded_as_by_the_sql(spark, halfway_pairs):
    import numpy as np

    from vectrail import oracles
    from vectrail.sources import results

    emb = halfway_items()
    want = {(i, j): s for i, j, s, _ in halfway_pairs.sql("FROM pairs").fetchall()}
    got = v.blocks.cosines(emb, emb)
    assert {p: got[p] for p in want} == want and (got == got.T).all()
    assert any(np.round(emb[i] @ emb[j] / np.sqrt((emb[i] @ emb[i]) * (emb[j] @ emb[j])), 9) != s for (i, j), s in want.items())

    scored = v.all_pairs(items(spark, [(k, k % 5, e.tolist()) for k, e in enumerate(emb)]))
    assert {(r.i, r.j): r.score for r in scored.rows().collect()} == want
    points = sorted(halfway_pairs.sql(f"WITH {oracles.curve('pairs')} FROM points").fetchall())
    assert sorted(map(tuple, scored.points().collect())) == points
    assert sorted(map(tuple, results.plot_ready(scored, 0.01).collect())) == [(t, max(m, 0.01), max(n, 0.01)) for t, m, n in points]
    assert sorted((r.score, r.gen, r.imp) for r in scored.counts().collect()) == sorted(halfway_pairs.sql("SELECT score, count(*) FILTER (is_genuine), count(*) FILTER (NOT is_genuine) FROM pairs GROUP BY score").fetchall())


def test_cuts_at_scores_halfway(halfway_pairs):
    import numpy as np

    emb, ids = halfway_items(), np.arange(48)
    side = {"item_id": ids, "persona_id": ids % 5, "unit": v.blocks.unit(emb), "emb": emb}
    cuts = [s for i, j, s, _ in halfway_pairs.sql("FROM pairs ORDER BY i").fetchall() if j == i + 1 and i % 2 == 0]
    for below, counted in ((True, "i < j"), (False, "true")):
        got = v._reaching(side, side, below, [v._at_least(t) for t in cuts])
        every = halfway_pairs.sql("SELECT * FROM pairs UNION ALL SELECT j, i, score, is_genuine FROM pairs UNION ALL SELECT item_id, item_id, 1, true FROM items").filter(counted).fetchnumpy()
        want = [[int((every["score"][kind] >= t).sum()) for t in (*cuts, -2)] for kind in (every["is_genuine"].astype(bool), slice(None))]
        assert got.tolist() == want
