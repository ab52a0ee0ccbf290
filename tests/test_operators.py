import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.config import SearchConfig, load_profiles, load_search_config
from vectrail.functions import pixels, records, scoring
from vectrail.functions.scorers import LinearScorer
from vectrail.operators import context, index, neartie, ranking, search, sidecar, verification
from vectrail.operators.ordering import numbered, quantiles
from vectrail.plans import ablation, cli, experiment, scenario, timing
from vectrail.plans.engine import Engine
from vectrail.sources import results, tables
from vectrail.streaming import ingest

ITEM = "item_id long, persona_id int, emb array<double>, ts timestamp, geo string, entities array<string>"


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def pool(spark, rows):
    return spark.createDataFrame([(i, p, at(a), None, g, e) for i, p, a, g, e in rows], ITEM)


def test_tie_pool_and_methods(spark):
    # personas 1 and 2 are nearly tied for query 0; context decides for 1
    t = pool(spark, [(0, 1, 0, "a", ["x"]), (1, 1, 10, "a", ["x"]), (2, 2, 2, "b", ["y"]), (3, 3, 90, "b", ["z"]), (4, 2, 12, "b", ["y"])])
    ev = ranking.evidence(t, t.where("item_id IN (0, 2)"))
    r = ranking.ranked(ev, LinearScorer(0.7, 0.3), 1.0)
    got = {(x.q_id, x.method): x["rank"] for x in ranking.true_ranks(r).collect()}
    assert (got[0, "face"], got[0, "fused"], got[0, "selective"], got[0, "tiebreak"]) == (2, 1, 1, 1)
    m = {x.method: (x.n, x.hit_at_1, x.mrr) for x in ranking.metrics(ranking.true_ranks(r), ["method"]).collect()}
    assert m["fused"][1] >= m["face"][1] and m["face"][0] == 2
    closed = {(x.q_id, x.method): x["rank"] for x in ranking.true_ranks(ranking.ranked(ev, LinearScorer(0.7, 0.3), 1e-6)).collect()}
    assert closed[0, "tiebreak"] == closed[0, "selective"] == closed[0, "face"] == 2
    gap = ranking.gap_summary(ranking.true_ranks(r)).first()
    assert gap.n == 2 and gap.mean_gap == pytest.approx(gap.median_gap)


def test_tiebreak_only_swaps_the_first_two(spark):
    rng = np.random.default_rng(0)
    t = spark.createDataFrame([(i, i % 4, rng.standard_normal(3).tolist(), None, "abc"[int(rng.integers(3))], []) for i in range(30)], ITEM)
    rows = ranking.ranked(ranking.evidence(t), LinearScorer(0.5, 0.5), 0.3).collect()
    assert all(r.tiebreak_rank == r.face_rank or {r.tiebreak_rank, r.face_rank} == {1, 2} for r in rows)


def test_query_without_other_items_is_left_out(spark):
    t = pool(spark, [(0, 1, 0, None, []), (1, 2, 5, None, []), (2, 2, 9, None, [])])
    assert {r.q_id for r in ranking.evidence(t).collect()} == {1, 2}


def test_noise_and_weights(spark):
    t = pool(spark, [(0, 1, 0, "a", ["x"]), (1, 1, 10, "a", ["x"]), (2, 2, 2, "b", ["y"]), (3, 3, 90, "b", ["z"]), (4, 2, 12, "b", ["y"])])
    ev = ranking.evidence(t)
    noisy = ranking.corrupted(ev, t, [0.0, 1.0], ["replace"])
    changed = noisy.where("rate = 1.0").select("q_id", "q_geo", "hit").distinct().collect()
    # every query gets the context of another persona's item
    assert {r.q_id for r in changed} == {0, 1, 2, 4} and all(r.hit for r in changed)
    assert {r.q_id: r.q_geo for r in changed if r.q_id < 2} == {0: "b", 1: "b"}
    found = {r.q_id: r.donor_id for r in ranking.donors(ev, t, [1.0], 0).collect()}
    persona = {0: 1, 1: 1, 2: 2, 3: 3, 4: 2}
    assert found.keys() == {0, 1, 2, 4} and all(persona[q] != persona[d] for q, d in found.items())
    assert noisy.where("rate = 0.0").where("q_id = 0").first().q_geo == "a"
    assert all(not r.q_entities for r in ranking.corrupted(ev, t, [1.0], ["drop"]).collect())


def test_donors_spread_over_all_other_personas(spark):
    # ids ordered by persona, and one persona with most of the items
    t = pool(spark, [(i, 0 if i < 60 else 1 + i // 30, i, "g", []) for i in range(120)])
    found = ranking.donors(ranking.evidence(t), t, [0.25, 0.5, 0.75, 1.0], 5).collect()
    assert len(found) == 4 * 120 and {r.donor_id for r in found if r.q_id < 60} <= set(range(60, 120))
    assert len({r.donor_id for r in found}) > 90


def test_ablations(spark):
    t = pool(spark, [(0, 1, 0, "a", ["x"]), (1, 1, 10, "a", ["x"]), (2, 2, 2, "b", ["y"]), (3, 3, 90, "b", ["z"]), (4, 2, 12, "b", ["y"]), (5, 3, 80, "b", ["z"]), (6, 4, 50, "a", [])])
    out = ablation.ambiguity(t, LinearScorer(0.7, 0.3), [[1, 2]], gap_thresholds=[0.0, 2.0], selective_gap=1.0)
    rows = {(r.scope, r.method): r for r in out.metrics.collect()}
    assert {s for s, _ in rows} == {"overall", "near_tie", "1|2"} and rows["near_tie", "face"].n == 4 and rows["overall", "face"].n == 6
    assert rows["near_tie", "fused"].hit_at_1 == 1.0 > rows["near_tie", "face"].hit_at_1
    assert out.counts.first().asDict() == {"n_queries": 6, "n_skipped": 1}
    assert {(r.gap_le, r.method): r.n for r in out.gap_le.collect()}[0.0, "face"] == 0
    assert {r.scope: r.n for r in out.gaps.collect()} == {"overall": 6, "near_tie": 4}
    some = ablation.ambiguity(t, LinearScorer(0.7, 0.3), [], query_ids=[0, 3])
    assert {(r.scope, r.method): r.n for r in some.metrics.collect()} == {("overall", "face"): 2, ("overall", "fused"): 2, ("near_tie", "face"): 0, ("near_tie", "fused"): 0}
    sweep = ablation.noise(t, LinearScorer(0.7, 0.3), [[1, 2]], [0.0, 1.0], 7, kinds=["replace"])
    assert {r.rate: r.n_corrupted for r in sweep.corrupted.collect()} == {0.0: 0, 1.0: 6}
    assert {r.rate for r in sweep.first_negative.collect()} <= {None, 1.0}
    peak = ablation.weights(t, lambda a, b: LinearScorer(a, b), [(1.0, 0.0), (0.5, 0.5), (0.4, 0.6)], [[1, 2]]).peak.first()
    assert (peak.scope, peak.alpha, peak.hit_at_1) == ("near_tie", 0.5, 1.0)
    for bad in (lambda: ablation.ambiguity(t, object(), []), lambda: ablation.ambiguity(t, LinearScorer(1, 0), [[1, 9]]), lambda: ablation.ambiguity(t, LinearScorer(1, 0), [], query_ids=[77]),
                lambda: ablation.ambiguity(t, LinearScorer(1, 0), [[1]]), lambda: ablation.noise(t, LinearScorer(1, 0), [], [2.0]), lambda: ablation.ambiguity(t, LinearScorer(1, 0), [], k=0),
                lambda: ablation.weights(t, LinearScorer, [(0.0, 0.0)]), lambda: ablation.ambiguity(t.union(t), LinearScorer(1, 0), [])):
        with pytest.raises((ValueError, TypeError)):
            bad()


def test_query_views(spark):
    t = pool(spark, [(0, 1, 0, "a", []), (1, 1, 10, "a", []), (2, 2, 90, "b", []), (3, 2, 80, "b", [])]).withColumn("view", F.when(F.col("item_id") == 0, F.array(F.lit(0.0), F.lit(1.0))))
    out = ablation.ambiguity(t, LinearScorer(0.7, 0.3), [], query_vector="view")
    assert {(r.scope, r.method): r.hit_at_1 for r in out.metrics.collect()}["overall", "face"] == 0.75


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(x)) for k, n in (("a", 1), ("b", 2), ("c", 501)) for x in np.round(rng.exponential(5, n), 1)] + [("d", None)]
    got = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p99": 0.99, "p0": 0.0}).collect()}
    for k in "abc":
        v = [x for key, x in rows if key == k]
        assert (got[k].p50, got[k].p99, got[k].p0) == pytest.approx((np.percentile(v, 50), np.percentile(v, 99), min(v)))
    assert set(got) == set("abc")


def test_numbering(spark):
    for kind, values in (("string", [f"x{i * i}" for i in range(300)]), ("long", [i**3 - 7 for i in range(300)])):
        rows = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5)
        assert [r.v for r in numbered(rows, "v").orderBy("place").collect()] == sorted(values)
        assert numbered(rows.where("false"), "v").count() == 0


def test_search_against_numpy(spark):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.standard_normal((64, 8)))[0]
    x = rng.standard_normal((400, 8)) @ basis.T
    t = spark.createDataFrame([(i * 3 + 5, v.tolist()) for i, v in enumerate(x)], "item_id long, emb array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = t.where("item_id % 60 = 5")
    got = {}
    for r in search.exact_topk(q, t, 10).collect():
        got.setdefault(r.q_id, []).append((r["rank"], r.item_id))
    for qid, rows in got.items():
        i = (qid - 5) // 3
        assert [b for _, b in sorted(rows)] == [int(j) * 3 + 5 for j in np.argsort(-(u @ u[i]), kind="stable")[:10]]
    assert search.exact_topk(q, t, 0).count() == 0
    with pytest.raises(ValueError):
        search.single_topk([0.0] * 64, t, 3)


def test_sidecar(spark):
    schema = "vector_id long, media_id string, ingest_time timestamp"
    t = lambda n: dt.datetime(2024, 1, n)
    stored = spark.createDataFrame([(1, "a", t(1)), (2, "b", t(5))], schema)
    incoming = spark.createDataFrame([(1, "c", t(1)), (2, "d", t(2)), (3, "e", t(3))], schema)
    assert {r.vector_id: r.media_id for r in sidecar.upsert(stored, incoming).collect()} == {1: "c", 2: "b", 3: "e"}
    wanted = spark.createDataFrame([(3, 0), (9, 1), (1, 2)], "vector_id long, pos int")
    assert [r.vector_id for r in sidecar.get_many(incoming, wanted, "vector_id").orderBy("pos").collect()] == [3, 1]
    dup = sidecar.duplicates(spark.createDataFrame([(1,), (7,), (7,), (8,)], "vector_id long"), stored, "vector_id")
    assert {(r.vector_id, r.n_batch, r.stored) for r in dup.collect()} == {(1, 1, True), (7, 2, False)}
    ids = sidecar.allocate_ids(spark.createDataFrame([(x,) for x in (50, -3, 900000, 7)], "item_id long"), "item_id", 10)
    assert [(r.item_id, r.vector_id) for r in ids.orderBy("item_id").collect()] == [(-3, 10), (7, 11), (50, 12), (900000, 13)]
    assert sidecar.max_id(stored.where("false"), "vector_id").first().max_id is None


def test_near_ties(spark):
    step = math.degrees(math.acos(0.7))
    t = spark.createDataFrame([(i, i, at(step * i)) for i in range(6)], "item_id long, persona_id int, emb array<double>")
    pairs = neartie.in_band_pairs(neartie.persona_pairs(neartie.centroids(t)), 0.65, 0.75)
    sets = neartie.near_tie_sets(pairs).collect()
    assert len(sets) == 3 and sorted(x for s in sets for x in s.persona_ids) == list(range(6))
    gram = np.array([[1, 0.7, 0.7], [0.7, 1, 0.7], [0.7, 0.7, 1]])
    trio = np.hstack([np.linalg.cholesky(gram), np.zeros((3, 1))])
    t = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(trio)] + [(3, 3, [0.0, 0.0, 0.0, 1.0])], "item_id long, persona_id int, emb array<double>")
    sets = neartie.near_tie_sets(neartie.in_band_pairs(neartie.persona_pairs(neartie.centroids(t)), 0.65, 0.75)).collect()
    assert [s.persona_ids for s in sets] == [[0, 1, 2]]
    band = neartie.adaptive_band(spark.createDataFrame([(0.1,), (0.2,), (1.0,)], "score double"), 1.0).first()
    assert (band.low, band.high) == (1 - 1e-9, 1.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_tie_rounds_equal_the_greedy_choice(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    pairs = [(i, j, float(np.round(rng.uniform(0.6, 0.8), 2))) for i in range(25) for j in range(i + 1, 25) if rng.random() < 0.2]
    df = spark.createDataFrame(pairs, "i long, j long, score double")
    want = [(r.set_no, r.persona_ids, r.cosines) for r in neartie.near_tie_sets(df).collect()]
    monkeypatch.setattr(neartie, "GREEDY_PAIRS", 5)
    assert [(r.set_no, r.persona_ids, r.cosines) for r in neartie.near_tie_sets(df).collect()] == want
    assert [(r.set_no, r.persona_ids, r.cosines) for r in neartie.near_tie_sets(df, 2).collect()] == want[:2]


def test_percentiles(spark):
    s = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in range(10, 101, 10)], "k string, x double")
    got = {r.k: (r.n, r.mean, r.p50, r.p90, r.p95, r.p99) for r in context.latency_percentiles(s, ["k"], "x").collect()}
    assert got["a"] == pytest.approx((4, 2.5, 2.5, 3.7, 3.85, 3.97)) and got["b"] == pytest.approx((10, 55, 55, 91, 95.5, 99.1))
    ticks = iter(x / 1000 for x in range(100))
    assert timing.percentiles(timing.time_calls(lambda: None, 5, 2, lambda: next(ticks)))["p50"] == pytest.approx(0.001)


def test_pixels():
    image = np.random.default_rng(1234).integers(0, 256, (2, 32, 48, 3), dtype=np.uint8)
    before = image.copy()
    for name, strength, same in (("gaussian_blur", 1.5, 0.0), ("brightness", 0.2, 0.0), ("downsample", 0.5, 1.0), ("off_angle", 30.0, 0.0)):
        fn = pixels.DEGRADATIONS[name]
        out = fn(image, strength)
        assert out.shape == image.shape and out.dtype == np.uint8 and (out != image).any() and (fn(image[1:], strength) == out[1:]).all()
        assert (fn(image, same) == image).all() and (image == before).all()
    flat = np.full((1, 16, 16, 3), 100, np.uint8)
    assert (pixels.gaussian_blur(flat, 2.0) == 100).all() and (pixels.downsample(flat, 0.3) == 100).all()
    assert (pixels.resize(image, 32, 48).round() == image).all()  # the spline passes through the pixels
    for bad in (lambda: pixels.downsample(image, 0), lambda: pixels.brightness(image, 2), lambda: pixels.gaussian_blur(image, -1), lambda: pixels.off_angle(image, 90), lambda: pixels.degraded(image, "other", 1), lambda: pixels.stack_of(image.astype(float))):
        with pytest.raises(ValueError):
            bad()


def test_blur_equals_a_direct_sum():
    image = np.random.default_rng(1).integers(0, 256, (1, 7, 5, 3), dtype=np.uint8)
    radius = 8
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 2.0) ** 2)
    w /= w.sum()
    mirror = lambda p, n: (p % (2 * n)) if p % (2 * n) < n else 2 * n - 1 - p % (2 * n)
    x = image[0].astype(float)
    want = sum(w[a + radius] * w[b + radius] * x[np.ix_([mirror(i + a, 7) for i in range(7)], [mirror(j + b, 5) for j in range(5)])] for a in range(-radius, radius + 1) for b in range(-radius, radius + 1))
    assert np.abs(pixels.gaussian_blur(image, 2.0)[0] - want).max() <= 0.5 + 1e-9


def test_side_view_geometry():
    inset = 40 * (1 - math.cos(math.radians(60))) / 2
    assert np.allclose(pixels.view_corners(40, 30, 60), [(0, 0), (30, inset), (30, 40 - inset), (0, 40)])
    assert np.allclose(pixels.view_corners(40, 30, -60), [(0, inset), (30, 0), (30, 40), (0, 40 - inset)])
    image = np.full((1, 40, 30, 3), 200, np.uint8)
    out = pixels.off_angle(image, 60)[0, :, :, 0]
    # the left edge keeps its length, the right one loses the inset at both ends
    assert (out[:39, 0] == 200).all() and not out[: int(inset) - 1, 28].any() and out[20, 28] == 200 and not out[40 - int(inset) + 1 :, 28].any()
    assert (pixels.off_angle(image, -60)[0, :39, 29 - 28, 0] == 200).sum() < 39
    smooth = (np.add.outer(np.arange(40), np.arange(30)) * 3)[None, :, :, None].repeat(3, 3).astype(np.uint8)
    # at the middle row of the view the projection keeps the row, and a plane stays a plane along it
    mid = pixels.off_angle(smooth, 20)[0, 20, 1:28, 0].astype(float)
    assert (np.diff(mid) > 0).all()


def test_image_quality():
    noise = np.random.default_rng(7).integers(0, 256, (1, 256, 256, 3), dtype=np.uint8)
    flat = np.full((1, 256, 256, 3), 128, np.uint8)
    of = lambda stack, *box: pixels.qualities(stack, np.array([box]))[0]
    box = (10, 10, 210, 210)
    assert of(flat, *box) == pytest.approx(0.25 * (1 - 2 * abs(128 / 255 - 0.5)) + 0.25)
    sharp, blurred = of(noise, *box), of(pixels.gaussian_blur(noise, 3), *box)
    assert 0 <= of(flat, *box) < sharp <= 1 and blurred < sharp and of(noise, 50, 50, 50, 80) == 0
    assert of(flat, -5, -5, 20.5, 500) == pytest.approx(of(flat, 0, 0, 20, 256))
    both = pixels.qualities(np.concatenate([noise, flat]), np.array([box, (0, 0, 40, 90)]))
    assert both == pytest.approx([sharp, of(flat, 0, 0, 40, 90)])


def test_scenario(spark, tmp_path):
    config = scenario.ScenarioConfig()
    people = scenario.identities(spark, config)
    rows = scenario.media(people, config, 120)
    again = scenario.media(people.repartition(7), config, 120)
    assert tables.content_hash(rows) == tables.content_hash(again) and rows.count() == 1000
    absent = rows.where("timestamp IS NULL AND geo_cluster IS NULL AND size(text_entities) = 0").count() / 1000
    assert abs(absent - 0.2) <= 0.05
    tables.write_scenario(str(tmp_path / "s"), people, rows, {"seed": 42})
    back_people, back_rows, manifest = tables.load_scenario(spark, str(tmp_path / "s"))
    assert (back_people.count(), back_rows.count(), manifest["n_media"]) == (50, 1000, 1000)
    back_rows.limit(900).write.mode("overwrite").json(str(tmp_path / "t"))
    (tmp_path / "s" / "media").rename(tmp_path / "old")
    (tmp_path / "t").rename(tmp_path / "s" / "media")
    with pytest.raises(ValueError):
        tables.load_scenario(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        scenario.ScenarioConfig(absent_rate=1.5)


def test_scenario_settings_and_assets(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("n_identities: 6\nmedia_per_identity: 4\narchetypes: [a, b]\nnoise_rate: 1.0\nabsent_rate: 0.0\n")
    config = scenario.load_config(str(tmp_path / "c.yaml"))
    assert (config.n_identities, config.archetypes, config.seed) == (6, ("a", "b"), 42)
    (tmp_path / "bad.yaml").write_text("n_people: 6\n")
    with pytest.raises(ValueError):
        scenario.load_config(str(tmp_path / "bad.yaml"))
    people, rows, manifest = scenario.generate(spark, str(tmp_path / "s"), config, 9)
    assert (people.count(), rows.count(), manifest["n_media"]) == (6, 24, 24) and {r.archetype for r in people.collect()} == {"a", "b"}
    truth = {r.identity_id: {*r.text_aliases, r.home_geo_cluster} for r in people.collect()}
    people_of = {r.identity_id: set(r.known_associates) for r in people.collect()}
    wrong = [r for r in rows.collect() if r.text_entities and not set(r.text_entities) & (truth[r.identity_id] | people_of[r.identity_id])]
    assert 0 < len(wrong) < 24  # a third of the noise replaces entities, with nothing that is true of the identity
    images = spark.createDataFrame([(10 + n, f"l{n // 3}") for n in range(7)], "idx long, label string")
    named = scenario.assign_assets(rows, images).collect()
    group = {f"id-{i:05d}": {10 + n for n in range(7) if n // 3 == i % 3} for i in range(6)}
    assert len(named) == 24 and all(int(r.image_ref[-6:]) in group[r.identity_id] for r in named)
    vectors = spark.createDataFrame([(10, [1.0]), (11, None), (12, [2.0])], "idx long, emb array<double>")
    joined, counts = tables.media_embeddings(scenario.assign_assets(rows, images), vectors)
    assert counts.first().n_media == 24 and joined.count() == 24 - counts.first().n_dropped > 0
    assert scenario.expanded_names(["a", "b"], 4, "geo") == ["a", "b", "geo-extra-0", "geo-extra-1"]


def test_index(spark, tmp_path):
    rng = np.random.default_rng(7)
    basis = np.linalg.qr(rng.standard_normal((64, 32)))[0]
    centres = rng.standard_normal((60, 32))
    x = (centres[rng.integers(0, 60, 2000)] + 0.6 * rng.standard_normal((2000, 32))) @ basis.T
    t = spark.createDataFrame([(int(i) * 2 - 500, v.tolist()) for i, v in enumerate(x)], "item_id long, emb array<double>").repartition(4).persist()
    q = t.where("pmod(item_id, 100) = 0")
    made = index.CellIndex.create(t, str(tmp_path / "i"))
    assert len(made.centres) == 45
    assert search.recall(made.search(q, 10), search.exact_topk(q, t, 10)).first().recall >= 0.9
    assert made.scanned(q).first().share < 0.1
    more = spark.createDataFrame([(1, x[0].tolist()), (3, x[1].tolist())], "item_id long, emb array<double>")
    made.append(more)
    again = index.CellIndex.load(spark, str(tmp_path / "i"), 64)
    assert again.size() == 2002 and again.probes == made.probes and (again.centres == made.centres).all()
    assert [r.item_id for r in again.search(more.where("item_id = 1"), 2).orderBy("rank").collect()] == [-500, 1]
    assert again.search(q, 0).count() == 0
    points = again.points().where("vector_id = 1")
    points.write.json(str(tmp_path / "points"))
    assert index.read_points(spark, str(tmp_path / "points"), 64).first().item_id == 1 and points.first().id == index.point_id(1) != index.point_id(2)
    bad = [lambda: made.append(more), lambda: made.append(spark.createDataFrame([(9, [1.0])], more.schema)), lambda: made.append(spark.createDataFrame([(9, [0.0] * 64)], more.schema)),
           lambda: index.CellIndex.load(spark, str(tmp_path / "i"), 3), lambda: index.CellIndex.load(spark, str(tmp_path / "none")), lambda: index.CellIndex.create(t, str(tmp_path / "i")),
           lambda: index.CellIndex.create(t.union(t), str(tmp_path / "j")), lambda: index.read_points(spark, str(tmp_path / "points"), 2), lambda: SearchConfig(probes=-1)]
    for fn in bad:
        with pytest.raises(ValueError):
            fn()
    (tmp_path / "h.yaml").write_text("cells: 8\nrecall: 0.5\nother: x\n")
    assert load_search_config(str(tmp_path / "h.yaml")) == SearchConfig(cells=8, recall=0.5)


def stripes(spark):
    rows = []
    for i, f in enumerate((4, 4, 6, 6, 8, 8)):
        wave = 128 + 100 * np.sin(np.arange(32) * f / 3 + 0.1 * (i % 2))
        rows.append((i, f"id{f}", 32, 32, np.repeat(np.tile(wave.astype(np.uint8), (32, 1))[:, :, None], 3, 2).tobytes()))
    return spark.createDataFrame(rows, "item_id long, label string, height int, width int, data binary")


def columns_of(stack):
    x = stack.mean(axis=(1, 3))
    x = x - x.mean(axis=1, keepdims=True)
    return [v if np.abs(v).max() > 1 else None for v in x]


def brute_condition(spark, name, severity):
    from vectrail.functions.pixels import degraded

    rows = stripes(spark).orderBy("item_id").collect()
    stack = np.stack([np.frombuffer(r.data, np.uint8).reshape(32, 32, 3) for r in rows])
    clean, seen = columns_of(stack), columns_of(degraded(stack, name, severity))
    kept = [i for i in range(6) if clean[i] is not None and seen[i] is not None]
    cos = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    return [(cos(seen[i], clean[j]), rows[i].label == rows[j].label) for i in kept for j in kept]


def test_image_sweep_equals_brute_force(spark):
    images = stripes(spark)
    conditions = [("gaussian_blur", 2.0), ("brightness", 1.0), ("off_angle", 20.0)]
    found, curve = experiment.sweep(images, conditions, columns_of)
    rows = {r.condition: r for r in found.collect()}
    assert [r.condition for r in found.orderBy("ordinal").collect()] == ["clean", "gaussian_blur", "brightness", "off_angle"]
    for name, severity in (("clean", 0.0), ("gaussian_blur", 2.0), ("off_angle", 20.0)):
        pairs = brute_condition(spark, name, severity)
        r = rows[name]
        assert (r.n_pairs, r.n_genuine, r.n_scored, r.n_query_dropped, r.n_gallery_dropped) == (len(pairs), sum(g for _, g in pairs), 6, 0, 0)
        want = verification.operating_points(verification.roc(spark.createDataFrame(pairs, "score double, is_genuine boolean")), [0.01]).first()
        assert (r.eer, r.fmr_at_fnmr) == pytest.approx((want.eer, want.fmr_at_fnmr_0))
        assert curve.where(F.col("ordinal") == r.ordinal).count() == len({s for s, _ in pairs}) + 1
    white = rows["brightness"]  # every probe is dropped
    assert (white.n_scored, white.n_query_dropped, white.eer, white.n_pairs) == (0, 6, None, None)
    alone, _ = experiment.sweep(images, [("gaussian_blur", 2.0)], columns_of, include_clean=False)
    assert [(r.condition, r.n_pairs) for r in alone.collect()] == [("gaussian_blur", 36)]
    scores = sorted((r.score, r.is_genuine) for r in experiment.degraded_pairs(images, ("gaussian_blur", 2.0), columns_of).collect())
    assert scores == sorted(brute_condition(spark, "gaussian_blur", 2.0))
    with pytest.raises(ValueError):
        experiment.degraded_pairs(images, ("brightness", 1.0), columns_of)


def test_image_gate(spark):
    images = stripes(spark)
    first = lambda stack: [0.9 if v is not None and v[0] < 0 else 0.1 for v in columns_of(stack)]
    rows = {(r.condition, r.subset): r for r in experiment.gated(images, [("brightness", 1.0)], columns_of, lambda s: [0.9] * len(s), 0.5).collect()}
    assert (rows["clean", "gated"].n, rows["clean", "gated"].pass_rate, rows["clean", "gated"].eer) == (6, 1.0, rows["clean", "full"].eer)
    assert (rows["brightness", "full"].n, rows["brightness", "gated"].n, rows["brightness", "gated"].pass_rate, rows["brightness", "full"].fmr, rows["brightness", "full"].n_dropped) == (0, 0, 0.0, None, 6)
    none = {(r.condition, r.subset): r for r in experiment.gated(images, [], columns_of, lambda s: [0.1] * len(s), 0.5).collect()}
    assert (none["clean", "gated"].n, none["clean", "gated"].pass_rate, none["clean", "gated"].fmr) == (0, 0.0, None)
    assert first(np.zeros((1, 4, 4, 3), np.uint8)) == [0.1]
    boxes = lambda image: [{"detection_score": 0.2, "bbox": (0, 0, 2, 2)}, {"detection_score": 0.9, "bbox": (0, 0, 32, 32), "quality": 0.7}] if image[0, 0, 0] else []
    embed = experiment.embedder(boxes, lambda image, o: [o["detection_score"], 1.0])
    stack = np.stack([np.zeros((32, 32, 3), np.uint8), np.ones((32, 32, 3), np.uint8)])
    assert embed(stack) == [None, [0.9, 1.0]] and experiment.detected_quality(boxes)(stack).tolist() == [0.0, 0.7]
    for bad in (lambda: experiment.sweep(images.limit(1), [], columns_of), lambda: experiment.sweep(images, [("clean", 1.0)], columns_of), lambda: experiment.sweep(images, [("mist", 1.0)], columns_of),
                lambda: experiment.sweep(images.withColumn("data", F.lit(b"x")), [], columns_of), lambda: experiment.gated(images, [], columns_of, first, math.nan)):
        with pytest.raises(ValueError):
            bad()


def test_records(spark):
    rows = [(1, "2024-03-01T12:00:00Z", "g", None, '["a", "b"]'), (2, "20240301T120000+02:00", None, None, None), (3, "soon", "g", "p", "[]"), (4, None, None, None, '["a", 1]'), (5, None, None, None, "{}"), (6, None, None, None, None), (7, None, None, "p", "[]"), (8, "2024-03-01", None, None, '["1"]'), (9, None, None, None, "[1")]
    df = spark.createDataFrame(rows, "id int, timestamp string, geo_cluster string, source_platform string, text_entities string")
    got = {r.id: r for r in records.form_context(df).collect()}
    noon = dt.datetime(2024, 3, 1, 12)
    utc = lambda t: t.astimezone(dt.UTC).replace(tzinfo=None)
    assert utc(got[1].context.timestamp) == noon and got[1].context.text_entities == ["a", "b"]
    assert utc(got[2].context.timestamp) == dt.datetime(2024, 3, 1, 10) and got[2].context.text_entities == []
    assert [got[i].problem is not None and got[i].context is None for i in (3, 4, 5, 9)] == [True] * 4
    assert got[6].context is None and got[6].problem is None and got[7].context.source_platform == "p" and got[8].context.text_entities == ["1"]
    found = spark.sql("SELECT array(named_struct('detection_score', 0.5D, 'n', 1), named_struct('detection_score', 0.9D, 'n', 2), named_struct('detection_score', 0.9D, 'n', 3), named_struct('detection_score', CAST(NULL AS DOUBLE), 'n', 4)) AS d, array() AS e")
    assert [x.n for x in found.select(records.sorted_detections(F.col("d")).alias("x")).first().x] == [2, 3, 1, 4]
    assert found.select(records.best_detection(F.col("d")).alias("x")).first().x.n == 2
    stored = spark.createDataFrame([(1, "m", 0.5, "2024-01-02T03:04:05.000000Z", "g", None, None, "2024-01-02T03:04:06Z"), (2, "n", 0.5, None, None, "p", '["a"]', None)], "vector_id long, media_id string, quality_score double, timestamp string, geo_cluster string, source_platform string, text_entities string, ingest_time string")
    typed = records.stored_row(stored).orderBy("vector_id").collect()
    assert utc(typed[0].timestamp) == dt.datetime(2024, 1, 2, 3, 4, 5) and typed[0].text_entities == [] and typed[1].text_entities == ["a"]
    assert records.as_text(records.stored_row(stored)).orderBy("vector_id").first().timestamp == "2024-01-02T03:04:05.000000Z"
    payload = stored.select(records.context(F.when(F.col("vector_id") == 1, F.col("media_id")), F.col("timestamp"), F.col("geo_cluster"), F.col("source_platform"), F.lit(None).cast("array<string>")).alias("c")).collect()
    assert payload[0].c.text_entities == [] and payload[1].c is None
    labels = spark.createDataFrame([(1e-7,), (0.25,), (2.0,), (0.0,), (1234567.0,), (100000.0,), (0.0001,)], "s double").select(scoring.condition_label(F.lit("x"), F.col("s")).alias("l")).collect()
    assert [r.l for r in labels] == [f"x {s:g}" for s in (1e-7, 0.25, 2.0, 0.0, 1234567.0, 100000.0, 0.0001)]


def test_runs_and_command_line(spark, tmp_path):
    t = pool(spark, [(i, i % 4, 17 * i % 90, "ab"[i % 2], ["e"]) for i in range(24)])
    t.write.parquet(str(tmp_path / "items"))
    path = cli.main(["fusion", "--data", str(tmp_path / "items"), "--out", str(tmp_path / "runs"), "--band", "0.5", "1.0", "--rates", "0", "1", "--weights", "1:0", "0.5:0.5", "--selective-gap", "0.1", "--gaps", "0.2"])
    summary = spark.read.option("header", True).csv(f"{path}/summary")
    assert summary.columns == results.FUSION_COLUMNS and {r.row for r in summary.collect()} == {"ablation", "noise"}
    assert spark.read.json(f"{path}/results/weights").count() == 4
    quick = cli.main(["latency", "--out", str(tmp_path / "quick"), "--dims", "4", "--sizes", "30", "--ks", "1", "3", "--repeats", "2", "--kind", "cells"])
    lines = spark.read.option("header", True).csv(f"{quick}/summary")
    assert lines.columns == results.LATENCY_COLUMNS and {(r.k, r.n_samples) for r in lines.collect()} == {("1", "2"), ("3", "2")}
    found, _ = experiment.sweep(stripes(spark), [("gaussian_blur", 2.0)], columns_of)
    results.write_run(spark, str(tmp_path / "runs" / "roc1"), "roc", {"data": "/x/y"}, {"sweep": found}, results.roc_summary(found))
    assert spark.read.option("header", True).csv(str(tmp_path / "runs" / "roc1" / "summary")).columns == results.ROC_COLUMNS
    runs = results.discover_runs(spark, str(tmp_path / "runs"))
    assert sorted(r.kind for r in runs.collect()) == ["fusion", "roc"]
    chosen, unknown = results.resolve_runs(runs, ["roc1", "none"])
    assert [r.kind for r in chosen.collect()] == ["roc"] and unknown == ["none"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        results.discover_runs(spark, str(tmp_path / "empty"))
    assert results.config_hash({"b": 1, "a": 2}, 16) == results.config_hash({"a": 2, "b": 1})[:16] and results.path_basename("C:\\a\\b.x") == "b.x"
    bars = results.eer_bars(found, scoring.condition_label(F.col("condition"), F.col("severity"))).collect()
    assert [b.label for b in bars] == ["clean 0", "gaussian_blur 2"]


def test_image_folders(spark, tmp_path):
    import struct
    import zlib

    def png(path, value):
        raw = b"".join(b"\0" + bytes([value, 0, 0] * 4) for _ in range(4))
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    for label in "abc":
        for n in range(3):
            png(tmp_path / "f" / label / f"{n}.png", 50 * n + 10)
    (tmp_path / "f" / "a" / "._junk.png").write_bytes(b"x")
    root = str(tmp_path / "f")
    read = lambda **k: sorted((r.label, r.origin[-5:]) for r in tables.read_images(spark, root, **k).collect())
    assert len(read()) == 9 and read(per_identity=1, identities=2) == [("a", "0.png"), ("b", "0.png")] and len(read(limit=4)) == 4
    one = experiment.read_images(tables.read_images(spark, root, 1)).first()
    assert (one.height, one.width, one.data[:3]) == (4, 4, bytes([0, 0, 10]))  # blue, green, red
    for bad in (lambda: read(identities=1), lambda: tables.read_images(spark, f"{root}/a")):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "f" / "b" / "bad.png").write_bytes(b"not an image")
    with pytest.raises(Exception, match="not an image"):
        read()


def test_engine_and_snapshot(spark, tmp_path):
    t = pool(spark, [(i, i % 3, 7 * i, "ab"[i % 2], ["e"]) for i in range(12)])
    e = Engine(t.select("item_id", "emb"), t)
    media = spark.createDataFrame([(100, 0.9, at(1)), (101, 0.3, at(2)), (102, 0.1, at(3)), (103, float("nan"), at(4))], "item_id long, quality double, emb array<double>")
    report, accepted = e.ingest(media)
    assert [r.trust for r in report.orderBy("item_id").collect()] == ["full", "low", "reject", "reject"]
    assert [(r.item_id, r.vector_id) for r in accepted.orderBy("item_id").collect()] == [(100, 12), (101, 13)]
    hits = e.search(t.where("item_id = 3"), 4).orderBy("rank").collect()
    assert [r["rank"] for r in hits] == [1, 2, 3, 4] and hits[0].item_id == 3
    with pytest.raises(ValueError):
        e.search(t, 0)
    tables.save_snapshot(t, str(tmp_path / "i"), "exact", 2)
    assert tables.load_snapshot(spark, str(tmp_path / "i"), "exact", 2).count() == 12
    with pytest.raises(ValueError):
        tables.load_snapshot(spark, str(tmp_path / "i"), "exact", 3)


def test_streaming_skips_known_ids(spark, tmp_path):
    schema = "item_id bigint, quality double"
    path = lambda p: str(tmp_path / p)

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path("in"))
        ingest.ingest_stream(spark, path("in"), schema, path("out"), path("state"), quality_min=0.6).awaitTermination()

    feed([(1, 0.9), (2, 0.1), (3, 0.4)])
    feed([(3, 0.9), (4, 0.7)])
    assert sorted((r.item_id, r.trust) for r in spark.read.parquet(path("out")).collect()) == [(1, "full"), (3, "low"), (4, "full")]


def test_profiles_and_results(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("profiles:\n  strict:\n    quality_min: 0.6\n    alpha: 0.8\n    beta: 0.2\n")
    assert load_profiles(str(tmp_path / "p.yaml"))["strict"].alpha == 0.8
    (tmp_path / "e.yaml").write_text("{}")
    with pytest.raises(ValueError):
        load_profiles(str(tmp_path / "e.yaml"))
    df = spark.createDataFrame([("/a/b/c.png", "rel/x", 1)], "p string, q string, n int").withColumn("roc_points", F.array(F.lit(1)))
    assert results.sanitised(df).first().asDict() == {"p": "c.png", "q": "rel/x", "n": 1}
