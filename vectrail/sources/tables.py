"""Item tables, snapshots, scenario files, image folders and result tables."""

from __future__ import annotations

import hashlib
import json
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

FORMAT_VERSION = 1


def scratch(spark: SparkSession) -> str:
    """A folder for tables of the session: in the shared folder that the cluster names in spark.checkpoint.dir; a folder of our own on a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vectrail-")
    return f"{root.rstrip('/')}/vectrail-tables"


def read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, persona_id, emb (doubles), ts, geo, platform, entities, quality: vectors with the context of the event of equal id."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("label").alias("persona_id"), F.col("embedding").cast("array<double>").alias("emb"))
    return vectors.join(read_context(spark, sf_dir), "item_id")


def read_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, ts, geo, platform, entities, quality of every event; times are UTC."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))
    return e.select(
        F.col("event_id").alias("item_id"), F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 5).alias("geo"),
        F.col("event_type").alias("platform"), F.when(F.col("event_id") % 6 == 0, F.array().cast("array<string>")).otherwise(own).alias("entities"), F.least(F.col("value") / 100, F.lit(1.0)).alias("quality"),
    )


def save_snapshot(items: DataFrame, path: str, kind: str, dim: int) -> None:
    """A vector index as Parquet with a stamp of kind, version, dimension and size."""
    items.write.mode("overwrite").parquet(f"{path}/vectors")
    spark = items.sparkSession
    stamp = [(kind, FORMAT_VERSION, dim, spark.read.parquet(f"{path}/vectors").count())]
    spark.createDataFrame(stamp, "kind string, format_version int, dim int, size bigint").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_snapshot(spark: SparkSession, path: str, kind: str, dim: int) -> DataFrame:
    """The vectors of a snapshot; raises if its stamp doesn't fit."""
    meta = spark.read.schema("kind string, format_version int, dim int, size bigint").json(f"{path}/meta").first()
    items = spark.read.parquet(f"{path}/vectors")
    if meta is None or (meta.kind, meta.format_version, meta.dim) != (kind, FORMAT_VERSION, dim):
        raise ValueError(f"{path} isn't a snapshot of kind {kind} and dimension {dim}: {meta}")
    if items.count() != meta.size:
        raise ValueError(f"{path} is incomplete")
    return items


def read_images(spark: SparkSession, root: str, per_identity: int | None = None, identities: int | None = None, limit: int | None = None, *, labelled: bool = True) -> DataFrame:
    """origin, label, image of <root>/<identity>/*; undecodable files raise, hidden files are skipped by Spark.

    Limits go by label and path. A labelled folder must hold images of at least two identities.
    """
    if identities is not None and identities < 2:
        raise ValueError("at least 2 identities are needed")
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root)
    rows = rows.select(F.col("image.origin").alias("origin"), F.regexp_extract("image.origin", "([^/]+)/[^/]+$", 1).alias("label"), "image")
    rows = rows.withColumn("image", F.when(F.col("image.height") > 0, F.col("image")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), F.col("origin")))))
    if per_identity is not None:
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("origin"))).where(F.col("nth") <= per_identity).drop("nth")
    if identities is not None:
        first = rows.select("label").distinct().orderBy("label").limit(identities)
        rows = rows.join(F.broadcast(first), "label", "left_semi")
    if limit is not None:
        rows = rows.orderBy("label", "origin").limit(limit)
    if labelled and rows.select("label").distinct().limit(2).count() < 2:
        raise ValueError(f"{root} holds images of fewer than 2 identities")
    return rows



def write_scenario(path: str, identities: DataFrame, media: DataFrame, config: dict, near_tie_sets: list | None = None) -> None:
    """identities and media as JSON lines, and a manifest with counts, the config's hash and content hashes."""
    identities.write.mode("overwrite").json(f"{path}/identities")
    media.write.mode("overwrite").json(f"{path}/media")
    text = json.dumps(config, sort_keys=True, separators=(",", ":"))
    manifest = {
        "schema_version": 1, "seed": config.get("seed"), "config": text, "config_hash": hashlib.sha256(text.encode()).hexdigest(), "n_identities": identities.count(), "n_media": media.count(),
        "identities_hash": content_hash(identities), "media_hash": content_hash(media), "images_written": False, "near_tie_sets": json.dumps(near_tie_sets),
    }
    identities.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def content_hash(df: DataFrame) -> str:
    """Order-free hash of the rows: sums of two 64-bit row hashes, and the count (no row leaves its task)."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    r = df.select(F.xxhash64(row).alias("a"), F.xxhash64(row, F.lit(1)).alias("b")).agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(f"{r.n},{r.a},{r.b}".encode()).hexdigest()


def load_scenario(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(identities, media, manifest); raises where a table doesn't match the manifest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    out = []
    for name, schema in (("identities", schemas.IDENTITIES), ("media", schemas.MEDIA)):
        df = spark.read.schema(schema).json(f"{path}/{name}")
        if content_hash(df) != manifest[f"{name}_hash"]:
            raise ValueError(f"{name} doesn't match the manifest")
        out.append(df)
    return out[0], out[1], manifest


def media_embeddings(media: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media with emb, counts): media joined to the vectors (idx, emb) that their inline/NNNNNN references name.

    Media whose reference is another or has no vector are dropped; counts has n_media and n_dropped.
    """
    idx = F.regexp_extract("image_ref", r"^inline/(\d+)$", 1)
    named = media.withColumn("idx", F.when(idx != "", idx.cast("long")))
    joined = named.join(vectors.where(F.col("emb").isNotNull()).select(F.col("idx").cast("long").alias("idx"), "emb"), "idx", "left")
    counts = joined.agg(F.count("*").alias("n_media"), F.count_if(F.col("emb").isNull()).alias("n_dropped"))
    return joined.where(F.col("emb").isNotNull()), counts
