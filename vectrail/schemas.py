"""Schemas of the records, as DDL (usable before there is a session)."""

CONTEXT = "struct<timestamp:timestamp,geo_cluster:string,source_platform:string,text_entities:array<string>>"
SIDECAR = (
    "vector_id bigint, media_id string, quality_score double, timestamp timestamp, geo_cluster string, "
    "source_platform string, text_entities array<string>, ingest_time timestamp"
)
VECTORS = "vector_id bigint, embedding array<float>"
IDENTITIES = (
    "identity_id string, display_name string, synthetic boolean, archetype string, home_geo_cluster string, "
    "active_period array<string>, known_associates array<string>, text_aliases array<string>"
)
MEDIA = (
    "media_id string, identity_id string, synthetic boolean, image_ref string, degradation struct<type:string,severity:double>, "
    "timestamp string, geo_cluster string, source_platform string, text_entities array<string>, generator_version string, seed bigint, config_hash string"
)
