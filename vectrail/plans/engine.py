"""Ingest and search: the batch form of the service."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Profile
from ..functions import scoring
from ..operators import search, sidecar

MAX_K = 100
VERSION = "1"


@dataclasses.dataclass
class Engine:
    """An index (item_id, emb), its metadata (item_id, ts, geo, entities, ...) and a profile.

    Detection and embedding of media are the caller's: any function from media rows to rows with
    emb and quality (for example a mapInPandas over images).
    """

    index: DataFrame
    metadata: DataFrame
    profile: Profile = dataclasses.field(default_factory=Profile)
    extract: Callable[[DataFrame], DataFrame] | None = None
    model_id: str = "none"

    def ingest(self, media: DataFrame, order: str = "item_id") -> tuple[DataFrame, DataFrame]:
        """(report, accepted): trust of every row, and the accepted rows with ids that continue the index."""
        rows = self.extract(media) if self.extract else media
        report = rows.withColumn("trust", scoring.trust(F.col("quality"), self.profile.quality_min))
        last = self.index.agg(F.max("item_id")).first()[0]
        accepted = report.where("trust <> 'reject'")
        return report, sidecar.allocate_ids(accepted, order, 0 if last is None else last + 1)

    def search(self, queries: DataFrame, k: int, *, fused: bool = True) -> DataFrame:
        """Ranked candidates of each query: similarity first, then (fused) a new order within those k only."""
        if k < 1:
            raise ValueError("k must be at least 1")
        hits = search.exact_topk(queries, self.index, min(k, MAX_K))
        if not fused:
            return hits
        return search.fused_search(hits, queries, self.metadata, self.profile.alpha, self.profile.beta)

    def info(self) -> dict:
        """What a health check reports."""
        return {"status": "ok", "version": VERSION, "model_id": self.model_id, "index_size": self.index.count(), "profile": self.profile.name}
