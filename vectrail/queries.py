"""One registered query per operator group, over the whole tables.

Searches take as queries the items whose id is divisible by 100. Values that both engines compute
in floating point are rounded to 6 digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Profile
from .functions import pixels, records, scoring
from .functions.scorers import LinearScorer
from .operators import context, index, neartie, ranking, search, sidecar, verification
from .plans import ablation, experiment, scenario
from .sources import results, tables
from .sources.tables import scratch
from .streaming import ingest

PROFILE = Profile()
SCORER = LinearScorer.of(PROFILE)
K, GATE, QUALITY_MIN = 10, 0.05, 0.6
SEVERITIES = [0.0, 0.1, 0.25, 0.5, 0.6, 0.75]
THRESHOLDS = [0.0, 0.1, 0.2, 0.3, 0.5]
SETS = [[0, 1], [2, 3, 4]]
GAPS = [0.01, 0.02, 0.05, 0.1]
RATES = [0.5, 0.0, 0.25, 1.0]
SEED = 3
WEIGHTS = [(1.0, 0.0), (0.9, 0.1), (0.7, 0.3), (0.5, 0.5)]
BAND = (0.2, 0.3)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits (no negative zero; never halfway, see oracles)."""
    return df.select(*[(F.round(F.col(c) + 3e-12, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_scores(pairs: DataFrame) -> DataFrame:
    """As rounded, for scores of nine digits from -1 to 1, without a decimal for every pair."""
    return pairs.withColumn("score", F.rint(F.col("score") * 1e6 + 3e-6) / 1e6 + 0.0)


def _queries_of(items: DataFrame) -> DataFrame:
    return items.where("item_id % 100 = 0")


def _ranked(spark, d, extra=None) -> DataFrame:
    items = tables.read_items(spark, d)
    return ranking.ranked(ranking.evidence(items), SCORER, GATE)


def _true(spark, d) -> DataFrame:
    return ranking.scoped(ranking.true_ranks(_ranked(spark, d)), ranking.members_of(spark, SETS))


@query
def knn_exact_topk(spark, d):
    items = tables.read_items(spark, d)
    first = items.orderBy("item_id").select("emb").first().emb
    return rounded(search.single_topk(first, items, K))


@query
def knn_batch_topk(spark, d):
    items = tables.read_items(spark, d)
    return rounded(search.exact_topk(_queries_of(items), items, K))


@query
def fused_topk_search(spark, d):
    items = tables.read_items(spark, d)
    q = _queries_of(items)
    hits = search.exact_topk(q, items, K)
    # metadata of items whose id is divisible by 11 is missing
    return rounded(search.fused_search(hits, q, items.where("item_id % 11 <> 0"), PROFILE.alpha, PROFILE.beta))


@query
def pair_scores(spark, d):
    return rounded_scores(verification.pair_scores(tables.read_items(spark, d)))


@query
def probe_gallery_scores(spark, d):
    return rounded_scores(verification.condition_pairs(tables.read_items(spark, d), [0.5]).select("i", "j", "score", "is_genuine"))


@query
def fmr_fnmr_at_threshold(spark, d):
    return rounded(verification.all_pairs(tables.read_items(spark, d)).rates(THRESHOLDS))


@query
def roc_curve(spark, d):
    return rounded(verification.all_pairs(tables.read_items(spark, d)).points())


@query
def roc_custom_thresholds(spark, d):
    return rounded(verification.all_pairs(tables.read_items(spark, d)).rates([round(-1 + 0.05 * i, 2) for i in range(41)]))


@query
def eer(spark, d):
    return rounded(verification.all_pairs(tables.read_items(spark, d)).operating_points([]))


@query
def fmr_at_fnmr(spark, d):
    targets = [0.01, 0.05, 0.1]
    found = verification.all_pairs(tables.read_items(spark, d)).operating_points(targets)
    return rounded(found.select(F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"fmr_at_fnmr_{n}").alias("fmr_at_fnmr")) for n, t in enumerate(targets)]))))


@query
def condition_sweep(spark, d):
    items = tables.read_items(spark, d)
    return rounded(verification.sweep(items, verification.quantised_pairs(items, SEVERITIES), SEVERITIES))


@query
def gate_ablation(spark, d):
    """Full against gated (degraded quality of both sides' items at least 0.3) at threshold 0.5."""
    return rounded(verification.gate_ablation(tables.read_items(spark, d), SEVERITIES, 0.3, 0.5))


@query
def trust_gate(spark, d):
    return rounded(tables.read_context(spark, d).select("item_id", "quality", scoring.trust(F.col("quality"), QUALITY_MIN).alias("trust")))


@query
def ingest_report(spark, d):
    return sidecar.trust_counts(tables.read_context(spark, d).withColumn("trust", scoring.trust(F.col("quality"), QUALITY_MIN)))


@query
def ingest_ids(spark, d):
    """Ids go on after the index's largest, to the rows that the gate accepts."""
    start = spark.read.parquet(f"{d}/embeddings.parquet").agg(F.max("vec_id")).first()[0]
    rows = tables.read_context(spark, d).where(scoring.trust(F.col("quality"), QUALITY_MIN) != "reject").select("item_id")
    return sidecar.allocate_ids(rows, "item_id", (-1 if start is None else start) + 1)


@query
def sidecar_upsert_latest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("vector_id"), "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ingest_time"))
    return rounded(sidecar.latest(e, "vector_id", "ingest_time", "event_id").drop("ingest_time"))


@query
def sidecar_get_many(spark, d):
    rows = tables.read_context(spark, d).select("item_id", "platform", "quality")
    wanted = tables.read_items(spark, d).where("item_id % 100 = 0").select((F.col("item_id") * 3).alias("item_id"), (-F.col("item_id")).alias("pos"))
    return rounded(sidecar.get_many(rows, wanted, "item_id"))


@query
def sidecar_point_lookup(spark, d):
    return rounded(sidecar.point_lookup(tables.read_context(spark, d).select("item_id", "platform", "quality"), "item_id", 7))


@query
def duplicate_vector_ids(spark, d):
    incoming = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("vec_id"))
    return sidecar.duplicates(incoming, spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id"), "vec_id")


@query
def max_vector_id(spark, d):
    return sidecar.max_id(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id")


@query
def index_size(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").agg(F.count("*").alias("n"))


@query
def vector_validation(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    return v.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count_if(scoring.valid_vector(F.col("embedding"))).alias("n_valid"), F.count_distinct("label").alias("n_identities"))


@query
def normalised_norms(spark, d):
    v = tables.read_items(spark, d).select("item_id", "emb", scoring.norm(F.col("emb")).alias("length"))
    return rounded(v.select("item_id", scoring.norm(scoring.unit(F.col("emb"), F.col("length"))).alias("unit_norm")))


def _against_all(items: DataFrame, q: DataFrame) -> DataFrame:
    """A stated query set against all rows, in blocks: queries in blocks of 256, which each part of the items meets in turn."""
    blocks = q.groupBy(F.pmod(F.xxhash64("q_id"), F.lit(max(1, q.count() // 256))).alias("block")).agg(F.collect_list(F.struct(*q.columns)).alias("asked"))
    met = items.crossJoin(blocks.select("asked")).select(*items.columns, F.inline("asked"))
    return met.where("q_id <> item_id")


@query
def context_score_pairs(spark, d):
    items = tables.read_items(spark, d).select("item_id", "ts", "geo", "entities")
    q = _queries_of(items).select(F.col("item_id").alias("q_id"), *[F.col(c).alias(f"q_{c}") for c in ranking.CONTEXT])
    both = _against_all(items, q)
    score = scoring.context_score({c: F.col(f"q_{c}") for c in ranking.CONTEXT}, {c: F.col(c) for c in ranking.CONTEXT})
    return rounded(both.select("q_id", "item_id", score.alias("context_score")))


@query
def entity_jaccard(spark, d):
    items = tables.read_items(spark, d).select("item_id", "entities")
    q = _queries_of(items).select(F.col("item_id").alias("q_id"), F.col("entities").alias("q_entities"))
    both = _against_all(items.where("size(entities) > 0"), q.where("size(q_entities) > 0"))
    return rounded(both.select("q_id", "item_id", scoring.entity_jaccard(F.col("q_entities"), F.col("entities")).alias("jaccard")))


@query
def ambiguous_band(spark, d):
    return rounded(verification.all_pairs(tables.read_items(spark, d)).in_band(*BAND).select("i", "j", "score"))


def _rank_query(method: str) -> Query:
    def fn(spark, d):
        return rounded(_ranked(spark, d).select("q_id", "persona_id", "face", "fused", F.col(f"{method}_rank").alias("rank")))

    return fn


for _m in ranking.METHODS:
    _QUERIES[f"persona_{_m}_rank"] = _rank_query(_m)


@query
def rank_metrics(spark, d):
    return rounded(ranking.metrics(_true(spark, d), ["method"]))


@query
def rank_metrics_per_set(spark, d):
    return rounded(ranking.metrics(_true(spark, d).where("set_key IS NOT NULL"), ["method", "set_key"]))


def _ambiguity(spark, d) -> ablation.Ablation:
    return ablation.ambiguity(tables.read_items(spark, d), SCORER, SETS, gap_thresholds=GAPS, selective_gap=GATE)


@query
def rank_metrics_scopes(spark, d):
    """overall, near_tie and each set; queries of a near-tie set are ranked among it alone."""
    return rounded(_ambiguity(spark, d).metrics)


@query
def ablation_deltas(spark, d):
    return rounded(_ambiguity(spark, d).deltas)


@query
def ablation_gap_le(spark, d):
    return rounded(_ambiguity(spark, d).gap_le)


@query
def ablation_gaps(spark, d):
    return rounded(_ambiguity(spark, d).gaps)


@query
def ablation_counts(spark, d):
    return _ambiguity(spark, d).counts


@query
def gap_slices(spark, d):
    return rounded(ranking.gap_slices(_true(spark, d), GAPS))


@query
def gap_summary(spark, d):
    return rounded(ranking.gap_summary(_true(spark, d)))


@query
def method_deltas(spark, d):
    return rounded(ranking.deltas(ranking.metrics(_true(spark, d), ["method"]), []))


def _noise(spark, d) -> ablation.NoiseSweep:
    return ablation.noise(tables.read_items(spark, d), SCORER, SETS, RATES, SEED, selective_gap=GATE)


@query
def noise_sweep(spark, d):
    return rounded(_noise(spark, d).deltas)


@query
def noise_corrupted(spark, d):
    return _noise(spark, d).corrupted


@query
def first_negative_rate(spark, d):
    """The first rate in the order given at which a method is worse than face, by scope (null: none)."""
    return _noise(spark, d).first_negative


def _weights(spark, d) -> ablation.WeightSweep:
    return ablation.weights(tables.read_items(spark, d), LinearScorer, WEIGHTS, SETS)


@query
def weight_sweep(spark, d):
    return rounded(_weights(spark, d).rows)


@query
def weight_peak(spark, d):
    return rounded(_weights(spark, d).peak)


@query
def persona_centroids(spark, d):
    c = neartie.centroids(tables.read_items(spark, d))
    return rounded(c.select("persona_id", "n_items", F.posexplode("emb").alias("pos", "x")))


@query
def adaptive_band(spark, d):
    return rounded(neartie.adaptive_band(neartie.persona_pairs(neartie.centroids(tables.read_items(spark, d))), 0.9))


@query
def near_tie_pairs(spark, d):
    pairs = neartie.persona_pairs(neartie.centroids(tables.read_items(spark, d)))
    low = neartie.adaptive_band(pairs, 0.5)
    return rounded(pairs.crossJoin(F.broadcast(low)).where("score BETWEEN low AND high").select("i", "j", "score"))


@query
def near_tie_sets(spark, d):
    return neartie.near_tie_sets(near_tie_pairs(spark, d))


@query
def shared_assets(spark, d):
    e = tables.read_context(spark, d).join(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    return neartie.shared_assets(e.select(F.concat_ws("/", "platform", F.col("geo").cast("string")).alias("asset"), "label"), "asset", "label")


@query
def context_state_mix(spark, d):
    return context.state_mix(tables.read_context(spark, d))


@query
def context_own_vs_rivals(spark, d):
    return rounded(context.own_against_rivals(ranking.evidence(tables.read_items(spark, d))))


@query
def active_period_join(spark, d):
    """Events in the quarter of their place's period: an equi-join on the place, then a range."""
    e = tables.read_context(spark, d).where("ts IS NOT NULL AND geo IS NOT NULL").select("item_id", "ts", "geo")
    first = e.agg(F.min("ts").alias("t0"))
    periods = e.select("geo").distinct().crossJoin(F.broadcast(first)).select("geo", (F.col("t0") + F.expr("make_dt_interval(geo * 2)")).alias("start"), (F.col("t0") + F.expr("make_dt_interval(geo * 2 + 5)")).alias("end"))
    inside = e.join(F.broadcast(periods), "geo").where("ts BETWEEN start AND end")
    return inside.groupBy("geo").agg(F.count("*").alias("n"))


@query
def latency_percentiles(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return rounded(context.latency_percentiles(e, ["event_type"], "value"))


@query
def plot_ready_roc(spark, d):
    return rounded(results.plot_ready(verification.all_pairs(tables.read_items(spark, d))))


def _index(spark, vectors) -> index.CellIndex:
    return index.CellIndex.create(vectors, f"{scratch(spark)}/index-{uuid.uuid4().hex}")


@query
def ann_recall(spark, d):
    """Recall of the approximate index at its own settings, and the share of the vectors that it scans."""
    items = tables.read_items(spark, d).select("item_id", "emb")
    q = _queries_of(items)
    built = _index(spark, items)
    found = search.recall(built.search(q, K), search.exact_topk(q, items, K))
    return rounded(found.crossJoin(built.scanned(q)))


@query
def ann_append(spark, d):
    """Size and largest id of an index that was made from even ids and to which the odd ones were added."""
    items = tables.read_items(spark, d).select("item_id", "emb")
    built = _index(spark, items.where("item_id % 2 = 0"))
    built.append(items.where("item_id % 2 = 1"))
    again = index.CellIndex.load(spark, built.path, built.dim)
    return again.vectors().agg(F.count("*").alias("n"), F.max("item_id").alias("max_id"), F.count_distinct("item_id").alias("n_ids"))


@query
def ann_all_cells(spark, d):
    """The index with every cell probed is an exact search."""
    items = tables.read_items(spark, d).select("item_id", "emb")
    built = _index(spark, items)
    return rounded(built.search(_queries_of(items), K, probes=len(built.centres)))


@query
def scenario_identities(spark, d):
    return scenario.identities(spark, scenario.ScenarioConfig())


@query
def scenario_media(spark, d):
    config = scenario.ScenarioConfig()
    return scenario.media(scenario.identities(spark, config), config, 120)


def _images(spark, d) -> DataFrame:
    """Test images drawn from the vectors: 32 x 32 pixels, a row's brightness following one component."""
    v = tables.read_items(spark, d).select("item_id", "emb")
    row = lambda r: F.repeat(F.substring(F.lpad(F.hex((F.round(F.abs(F.element_at("emb", r)) * 500).cast("int") * 37) % 256), 2, "0"), -2, 2), 96)
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), row), ""))
    return v.select("item_id", F.lit(32).alias("height"), F.lit(32).alias("width"), data.alias("data"))


CONDITIONS = [("gaussian_blur", 1.5), ("brightness", 0.2), ("downsample", 0.5), ("off_angle", 30.0)]


@query
def pixel_degradations(spark, d):
    grid = [("clean", 0.0), *CONDITIONS]
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(s).alias("severity")) for n, s in grid]))
    out = pixels.degrade(_images(spark, d).select("*", each), "item_id")
    return out.select("item_id", "condition", "severity", F.sha2("data", 256).alias("data_sha256"), "quality")


@query
def quality_scores(spark, d):
    out = pixels.degrade(_images(spark, d).withColumn("condition", F.lit("clean")).withColumn("severity", F.lit(0.0)), "item_id")
    return rounded(out.select("item_id", "quality", scoring.trust(F.col("quality"), QUALITY_MIN).alias("trust")))


@query
def brightened_pixels(spark, d):
    """Sum of all bytes of each image as it is and brighter by a fifth."""
    images = _images(spark, d)
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(s).alias("severity")) for n, s in (("clean", 0.0), ("brightness", 0.2))]))
    out = pixels.degrade(images.select("*", each), "item_id")
    total = F.aggregate(F.sequence(F.lit(1), F.length("data")), F.lit(0).cast("long"), lambda acc, i: acc + F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("long"))
    return out.select("item_id", "condition", total.alias("total"))


def _rows_embedding(stack):
    """The mean of every row of pixels, less the image's; images without contrast have none."""
    rows = stack.mean(axis=(2, 3))
    rows = rows - rows.mean(axis=1, keepdims=True)
    return [r if r.any() else None for r in rows]


def _labelled_images(spark, d) -> DataFrame:
    return _images(spark, d).join(tables.read_items(spark, d).select("item_id", F.col("persona_id").alias("label")), "item_id")


@query
def image_sweep(spark, d):
    """Condition sweep from pixels: degrade, embed, align with the clean gallery, score."""
    return rounded(experiment.sweep(_labelled_images(spark, d), CONDITIONS, _rows_embedding)[0])


@query
def image_gate(spark, d):
    return rounded(experiment.gated(_labelled_images(spark, d), CONDITIONS, _rows_embedding, experiment.whole_quality, 0.5))


@query
def form_metadata(spark, d):
    """Context from form strings: some times and lists of entities can't be read."""
    e = tables.read_context(spark, d)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ts = F.when(F.col("item_id") % 10 == 0, "yesterday").otherwise(iso)
    entities = F.when(F.col("item_id") % 15 == 0, "not json").when(F.col("item_id") % 15 == 1, '["a", 1]').when(F.col("item_id") % 15 == 2, F.lit(None)).otherwise(F.to_json("entities"))
    forms = e.select("item_id", ts.alias("timestamp"), F.col("geo").cast("string").alias("geo_cluster"), F.lit(None).cast("string").alias("source_platform"), entities.alias("text_entities"))
    out = records.form_context(forms)
    return out.select("item_id", F.col("problem").isNotNull().alias("rejected"), F.col("context").isNotNull().alias("has_context"), F.size("context.text_entities").cast("long").alias("n_entities"))


@query
def best_detections(spark, d):
    """The best detection of each user's events, and its quality where it brings one along."""
    e = spark.read.parquet(f"{d}/events.parquet")
    quality = F.when(F.col("event_id") % 3 == 0, F.struct(F.lit(0.25).alias("score"), F.lit("given").alias("method")))
    observation = F.struct(F.col("event_id").alias("event_id"), F.col("value").alias("detection_score"), quality.alias("quality"))
    per = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("at"), observation.alias("o")))), lambda x: x["o"]).alias("found"))
    best = per.select("user_id", records.best_detection(F.col("found")).alias("b"))
    return rounded(best.select("user_id", "b.event_id", F.col("b.detection_score").alias("detection_score"), records.assessed(F.col("b.quality"), F.col("b.detection_score") / 100, "assessed")["score"].alias("quality")))


@query
def sanitised_paths(spark, d):
    """Paths of nested results, cut to their last part."""
    e = tables.read_context(spark, d)
    path = F.concat(F.lit("/data/runs/"), F.col("platform"), F.lit("/"), F.col("item_id").cast("string"), F.lit(".json"))
    nested = e.select("item_id", F.struct(path.alias("file"), F.array(path, F.lit("plain")).alias("files"), F.lit("C:\\tmp\\x").alias("roc_points")).alias("config"), F.lit(1).alias("roc_points"))
    return results.sanitised(nested).select("item_id", "config.file", F.array_join("config.files", "|").alias("files"))


@query
def gate_bars(spark, d):
    table = verification.gate_rates(tables.read_items(spark, d), SEVERITIES, 0.3, 0.5).withColumn("ordinal", F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")))
    return rounded(results.gate_bars(table, scoring.condition_label(F.lit("quantised"), F.col("severity"))))


@query
def fusion_bars(spark, d):
    return rounded(results.fusion_bars(_ambiguity(spark, d).metrics).drop("text"))


@query
def stream_ingest(spark, d):
    """Events through the streaming ingest, into a table of the shared scratch folder."""
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    tables.read_context(spark, d).select("item_id", "platform", "quality").write.parquet(f"{base}/in")
    schema = "item_id bigint, platform string, quality double"
    ingest.ingest_stream(spark, f"{base}/in", schema, f"{base}/out", f"{base}/state", quality_min=QUALITY_MIN).awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out").select("item_id", "platform", "quality", "trust"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return fused_topk_search(spark, d)
