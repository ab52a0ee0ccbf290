"""Settings: threshold profiles and neighbour-search parameters, from YAML or as given here."""

from __future__ import annotations

import dataclasses
import math


@dataclasses.dataclass(frozen=True)
class Profile:
    """A named threshold profile; alpha weighs similarity, beta context."""

    name: str = "default"
    quality_min: float = 0.5
    ambiguous_low: float = 0.65
    ambiguous_high: float = 0.75
    alpha: float = 0.7
    beta: float = 0.3

    def __post_init__(self):
        weights = (self.alpha, self.beta)
        if not all(math.isfinite(w) and w >= 0 for w in weights) or not any(weights):
            raise ValueError("alpha and beta must be finite, not negative, and not both 0")
        if not 0 <= self.ambiguous_low <= self.ambiguous_high <= 1:
            raise ValueError("the ambiguous band must lie in order within [0, 1]")


@dataclasses.dataclass(frozen=True)
class SearchConfig:
    """Approximate search. cells: of the coarse partition (0: the square root of the table's size, at most
    most_cells); probes: cells that a query visits (0: as many as the recall target needs on a sample);
    sample: vectors that the partition is fitted on."""

    cells: int = 0
    most_cells: int = 4096
    probes: int = 0
    recall: float = 0.96
    sample: int = 20_000
    seed: int = 1

    def __post_init__(self):
        if min(self.cells, self.probes) < 0 or min(self.most_cells, self.sample) < 1 or not 0 < self.recall <= 1:
            raise ValueError("search settings are out of range")


def load_profiles(path: str) -> dict[str, Profile]:
    """Profiles of a YAML file (a mapping of names to fields, under 'profiles' or at the top)."""
    import yaml

    with open(path) as f:
        data = yaml.safe_load(f) or {}
    data = data.get("profiles", data)
    if not data:
        raise ValueError(f"{path} has no profile")
    known = {f.name for f in dataclasses.fields(Profile)} - {"name"}
    return {name: Profile(name=name, **{k: float(v) for k, v in (fields or {}).items() if k in known}) for name, fields in data.items()}


def load_search_config(path: str) -> SearchConfig:
    import yaml

    with open(path) as f:
        data = yaml.safe_load(f) or {}
    kinds = {f.name: type(f.default) for f in dataclasses.fields(SearchConfig)}
    return SearchConfig(**{k: kinds[k](v) for k, v in data.items() if k in kinds})
