"""The scorer seam: how context is scored and fused with similarity, as column expressions."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Profile
from . import scoring


class Scorer(Protocol):
    """Any object with these two methods; q and c map ts, geo and entities to columns. A pandas UDF may stand behind them."""

    def context_score(self, q: dict[str, Column], c: dict[str, Column]) -> Column: ...

    def fuse(self, similarity: Column, context: Column) -> Column: ...


@dataclasses.dataclass(frozen=True)
class LinearScorer:
    """alpha * similarity + beta * context, clipped to [0, 1]; the weights may be columns."""

    alpha: object
    beta: object

    @classmethod
    def of(cls, profile: Profile) -> "LinearScorer":
        return cls(profile.alpha, profile.beta)

    def context_score(self, q: dict[str, Column], c: dict[str, Column]) -> Column:
        return scoring.context_score(q, c)

    def fuse(self, similarity: Column, context: Column) -> Column:
        return scoring.fuse(similarity, context, self.alpha, self.beta)

    def in_ambiguous_band(self, similarity: Column, profile: Profile) -> Column:
        return scoring.in_band(similarity, profile.ambiguous_low, profile.ambiguous_high)


def checked(scorer: object) -> Scorer:
    if not all(callable(getattr(scorer, name, None)) for name in ("context_score", "fuse")):
        raise TypeError("a scorer has context_score() and fuse()")
    return scorer


def build(factory: type | Callable[[float, float], Scorer], alpha: float, beta: float) -> Scorer:
    """The scorer of a class (made from a profile, or by its method ``of``) or of a factory of two weights."""
    if isinstance(factory, type):
        profile = Profile(name="weights", alpha=alpha, beta=beta)
        return checked(factory.of(profile) if hasattr(factory, "of") else factory(profile))
    if not callable(factory):
        raise TypeError("a scorer class or a factory is needed")
    return checked(factory(alpha, beta))


def rounded_context(scorer: Scorer, q: dict[str, Column], c: dict[str, Column]) -> Column:
    return F.round(scorer.context_score(q, c), 9)
