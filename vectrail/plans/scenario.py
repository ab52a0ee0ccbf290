"""Deterministic synthetic scenario: identities and their media, from column expressions alone.

Each random draw is a hash of the seed, the row's key and the draw's name, so any row can be made
anywhere, in any order and number of partitions, with the same result.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..sources import tables

VERSION = "1"
ARCHETYPES = ["commuter", "student", "merchant", "traveller"]
PLATFORMS = ["board", "feed", "album"]
DEGRADATION_TYPES = ["gaussian_blur", "brightness", "downsample", "off_angle"]
TOPICS = ["harbour", "market", "station", "museum"]


@dataclasses.dataclass(frozen=True)
class ScenarioConfig:
    """Rates are shares of all media; absent context comes first, then drift, then noise."""

    n_identities: int = 50
    n_geo: int = 3
    n_periods: int = 2
    media_per_identity: int = 20
    absent_rate: float = 0.2
    noise_rate: float = 0.15
    drift_rate: float = 0.2
    clean_rate: float = 0.5
    jitter_days: float = 20.0
    seed: int = 42
    archetypes: tuple[str, ...] = tuple(ARCHETYPES)
    platforms: tuple[str, ...] = tuple(PLATFORMS)
    topics: tuple[str, ...] = tuple(TOPICS)

    def __post_init__(self):
        if min(self.n_identities, self.n_geo, self.n_periods, self.media_per_identity) < 1:
            raise ValueError("counts must be at least 1")
        if not all(0 <= r <= 1 for r in (self.absent_rate, self.noise_rate, self.drift_rate, self.clean_rate)):
            raise ValueError("rates must lie in [0, 1]")
        if not math.isfinite(self.jitter_days) or self.jitter_days < 0:
            raise ValueError("the jitter must be finite and not negative")
        if not all(v and all(isinstance(x, str) and x for x in v) for v in (self.archetypes, self.platforms, self.topics)):
            raise ValueError("vocabularies are lists of names")

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def load_config(path: str) -> ScenarioConfig:
    """Settings of a YAML file; what it doesn't name keeps its default, and unknown names raise."""
    import yaml

    with open(path) as f:
        data = yaml.safe_load(f) or {}
    known = {f.name: f for f in dataclasses.fields(ScenarioConfig)}
    if unknown := sorted(set(data) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return ScenarioConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def expanded_names(vocabulary: list[str], n: int, prefix: str) -> list[str]:
    """n names: the vocabulary's first, then prefix-extra-0, -1, ..."""
    return [*vocabulary[:n], *[f"{prefix}-extra-{k}" for k in range(max(0, n - len(vocabulary)))]]


def subset(values: Column, n: Column, *key: Column) -> Column:
    """n elements of an array without replacement, drawn by the hash of the key and the element, in sorted order."""
    drawn = F.array_sort(F.transform(values, lambda x: F.struct(F.xxhash64(x, *key).alias("h"), x.alias("x"))))
    return F.array_sort(F.transform(F.slice(drawn, F.lit(1), n), lambda s: s["x"]))


def _draw(config: ScenarioConfig, name: str, *keys: Column) -> Column:
    """A uniform number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(config.seed), F.lit(name), *keys), F.lit(1 << 31)) / float(1 << 31)


def _pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def period_start(index: Column) -> Column:
    """First day of a quarter, counted from 2024-01-01."""
    return F.add_months(F.lit("2024-01-01").cast("date"), (index * 3).cast("int"))


def identities(spark: SparkSession, config: ScenarioConfig) -> DataFrame:
    i = F.col("id")
    name = lambda x: F.format_string("id-%05d", x)
    period = i % config.n_periods
    n_associates = F.floor(_draw(config, "associates", i) * 3).cast("int")
    associate = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda k: name(F.pmod(i + k * (1 + F.floor(_draw(config, "associate", i) * 7)), F.lit(config.n_identities))))
    return spark.range(config.n_identities).select(
        name(i).alias("identity_id"), F.format_string("Person %d", i).alias("display_name"), F.lit(True).alias("synthetic"), _pick(config.archetypes, (i % len(config.archetypes)) / len(config.archetypes)).alias("archetype"),
        F.format_string("geo-%d", i % config.n_geo).alias("home_geo_cluster"), F.array(period_start(period).cast("string"), period_start(period + 1).cast("string")).alias("active_period"),
        subset(F.filter(F.array_distinct(associate), lambda x: x != name(i)), n_associates, F.lit(config.seed), i).alias("known_associates"), F.array(F.format_string("alias-%d-a", i), F.format_string("alias-%d-b", i)).alias("text_aliases"),
    )


def asset_groups(images: DataFrame) -> DataFrame:
    """grp, nth, size, idx: the images (idx, label) numbered within their label, the labels in sorted order."""
    labels = numbered(images.select("label").distinct(), "label").withColumnRenamed("place", "grp")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("idx")) - 1
    rows = images.select("idx", "label", nth.alias("nth")).join(images.groupBy("label").agg(F.count("*").alias("size")), "label")
    return rows.join(labels, "label").select("grp", "nth", "size", "idx")


def assign_assets(rows: DataFrame, images: DataFrame) -> DataFrame:
    """media rows whose image_ref names an image of their identity's label: identity i draws from label i modulo the labels, in turn."""
    groups = asset_groups(images)
    labels = groups.groupBy("grp").agg(F.max("size").alias("size"))
    n = labels.count()
    i, j = F.regexp_extract("media_id", r"m-(\d+)-", 1).cast("long"), F.regexp_extract("media_id", r"-(\d+)$", 1).cast("long")
    asked = rows.withColumn("grp", F.pmod(i, F.lit(n))).join(labels, "grp").withColumn("nth", F.pmod(j, F.col("size"))).drop("size")
    named = asked.join(groups.drop("size"), ["grp", "nth"]).withColumn("image_ref", F.format_string("inline/%06d", "idx"))
    return named.select(*rows.columns)


def generate(spark: SparkSession, path: str, config: ScenarioConfig, n_images: int, near_tie_sets: list | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Make a scenario, write it and read it back, checked against its manifest."""
    people = identities(spark, config)
    tables.write_scenario(path, people, media(people, config, n_images), dataclasses.asdict(config), near_tie_sets)
    return tables.load_scenario(spark, path)


def media(people: DataFrame, config: ScenarioConfig, n_images: int) -> DataFrame:
    """Media of all identities; the image is (identity + number) modulo n_images (see assign_assets for labelled images)."""
    rows = people.select("*", F.substring("identity_id", 4, 9).cast("long").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(config.media_per_identity - 1))).alias("j"))
    d = lambda name: _draw(config, name, F.col("i"), F.col("j"))
    absent, drift, noise = d("absent") < config.absent_rate, d("drift") < config.drift_rate, d("noise") < config.noise_rate
    kind = _pick(["entities", "timestamp", "geo"], d("noise-kind"))
    start, end = F.element_at("active_period", 1).cast("date"), F.element_at("active_period", 2).cast("date")
    span = F.datediff(end, start)
    normal = F.sqrt(-2 * F.log(1 - d("jitter-a"))) * F.cos(2 * math.pi * d("jitter-b"))
    centre = span * d("offset") + config.jitter_days * normal
    inside = F.least(F.greatest(centre, F.lit(0.0)), span - F.lit(1.0 / 86400))
    away = F.when(d("stale-sign") < 0.5, -1).otherwise(1) * (180 + 185 * d("stale"))
    noisy_time = noise & (kind == "timestamp")
    seconds = F.floor((inside + F.when(noisy_time, away).otherwise(0.0)) * 86400).cast("long")
    moment = F.timestamp_seconds(F.unix_timestamp(start.cast("timestamp")) + seconds)
    other = F.format_string("geo-%d", F.pmod(F.regexp_extract("home_geo_cluster", r"(\d+)$", 1).cast("int") + 1 + F.floor(d("other-geo") * max(1, config.n_geo - 1)).cast("int"), F.lit(config.n_geo)))
    moved = drift | (noise & (kind == "geo"))
    own_entities = F.filter(F.array(F.element_at("text_aliases", 1), F.get("known_associates", F.lit(0))), lambda x: x.isNotNull())
    # the noise pool: aliases of others, topics, and names of places, without what is true of the identity
    rival = F.pmod(F.col("i") + 1 + F.floor(d("wrong") * max(1, config.n_identities - 1)).cast("long"), F.lit(config.n_identities))
    pool = F.array(F.format_string("alias-%d-a", rival), F.format_string("alias-%d-b", rival), _pick(config.topics, d("topic")), other)
    wrong = subset(F.array_except(pool, F.concat(F.col("text_aliases"), F.array("home_geo_cluster"))), F.lit(1), F.lit(config.seed), F.col("i"), F.col("j"))
    entities = F.when(noise & (kind == "entities"), wrong).otherwise(own_entities)
    clean = d("clean") < config.clean_rate
    nothing = F.array().cast("array<string>")
    return rows.select(
        F.format_string("m-%05d-%04d", "i", "j").alias("media_id"), "identity_id", F.lit(True).alias("synthetic"), F.format_string("inline/%06d", F.pmod(F.col("i") + F.col("j"), F.lit(n_images))).alias("image_ref"),
        F.struct(F.when(clean, "none").otherwise(_pick(DEGRADATION_TYPES, d("type"))).alias("type"), F.when(clean, 0.0).otherwise(F.round(0.1 + 0.8 * d("severity"), 3)).alias("severity")).alias("degradation"),
        F.when(~absent, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"), F.when(~absent, F.when(moved, other).otherwise(F.col("home_geo_cluster"))).alias("geo_cluster"),
        _pick(config.platforms, d("platform")).alias("source_platform"), F.when(absent, nothing).otherwise(entities).alias("text_entities"), F.lit(VERSION).alias("generator_version"), F.lit(config.seed).cast("long").alias("seed"), F.lit(config.hash()).alias("config_hash"),
    )
