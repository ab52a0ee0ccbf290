"""Records as columns: detections, context from payloads and forms, stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def sorted_detections(detections: Column) -> Column:
    """Detections (array of structs with detection_score) by score, best first; ties keep their order; null scores last."""
    indexed = F.transform(detections, lambda d, i: F.struct(F.coalesce(-d["detection_score"], F.lit(float("inf"))).alias("s"), i.alias("i"), d.alias("d")))
    return F.transform(F.array_sort(indexed), lambda x: x["d"])


def best_detection(detections: Column) -> Column:
    """The detection of largest score, null where there is none."""
    return F.get(sorted_detections(detections), F.lit(0))


def assessed(existing: Column, score: Column, method: str) -> Column:
    """struct<score, method>: the quality that an observation brings along, else the score given."""
    made = F.struct(score.cast("double").alias("score"), F.lit(method).alias("method"))
    return F.coalesce(existing, made)


def context(media_id: Column, ts: Column, geo: Column, platform: Column, entities: Column) -> Column:
    """The context struct of a joined payload; null where there is no payload (no media_id). Entities are never null."""
    fields = F.struct(ts.alias("timestamp"), geo.alias("geo_cluster"), platform.alias("source_platform"), F.coalesce(entities, F.array().cast("array<string>")).alias("text_entities"))
    return F.when(media_id.isNotNull(), fields)


def form_context(rows: DataFrame, ts: str = "timestamp", geo: str = "geo_cluster", platform: str = "source_platform", entities: str = "text_entities") -> DataFrame:
    """rows with ``context`` and ``problem`` from four optional form strings.

    context is null where all four are absent. A timestamp that isn't ISO 8601 and entities that
    aren't a JSON list of strings leave it null too, and problem says which. Times without an offset are UTC.
    """
    moment, listed = F.col(ts), F.col(entities)
    iso = r"^\d{4}-?\d{2}-?\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
    extended = F.regexp_replace(F.regexp_replace(moment, ",", "."), r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")  # the basic format's date, then its time
    extended = F.regexp_replace(F.regexp_replace(extended, r"([T ]\d{2})(\d{2})", "$1:$2"), r"([T ]\d{2}:\d{2})(\d{2})", "$1:$2")
    parsed = F.when(moment.rlike(iso), F.try_to_timestamp(extended))
    # any value that isn't a string makes a list of raw JSON values differ from the list of its strings
    variant = F.try_parse_json(listed)
    values = F.try_variant_get(variant, "$", "array<variant>")
    strings = F.transform(values, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    bad_time = moment.isNotNull() & parsed.isNull()
    bad_list = listed.isNotNull() & F.coalesce(~F.coalesce(F.schema_of_variant(variant), F.lit("")).startswith("ARRAY") | F.exists(strings, lambda s: s.isNull()), F.lit(True))
    absent = moment.isNull() & F.col(geo).isNull() & F.col(platform).isNull() & listed.isNull()
    fields = F.struct(parsed.alias("timestamp"), F.col(geo).alias("geo_cluster"), F.col(platform).alias("source_platform"), F.coalesce(strings, F.array().cast("array<string>")).alias("text_entities"))
    problem = F.when(bad_time, F.concat(F.lit("not an ISO 8601 time: "), moment)).when(bad_list, F.concat(F.lit("not a JSON list of strings: "), listed))
    return rows.withColumn("problem", problem).withColumn("context", F.when(~absent & F.col("problem").isNull(), fields))


def stored_row(rows: DataFrame) -> DataFrame:
    """A sidecar table of texts (ISO times, entities as a JSON list) as the typed columns of schemas.SIDECAR."""
    kinds = {"timestamp": lambda c: F.to_timestamp(c), "ingest_time": lambda c: F.to_timestamp(c), "text_entities": lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))}
    typed = dict(f.split(" ", 1) for f in schemas.SIDECAR.split(", "))
    return rows.select(*[(kinds[n](F.col(n)) if n in kinds else F.col(n).cast(t)).alias(n) for n, t in typed.items()])


def as_text(rows: DataFrame) -> DataFrame:
    """The other way round: times as ISO texts in UTC, entities as JSON."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    kinds = {"timestamp": iso, "array<string>": F.to_json}
    return rows.select(*[kinds[t](F.col(n)).alias(n) if t in kinds else F.col(n) for n, t in rows.dtypes])
