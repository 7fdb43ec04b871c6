"""Schemas and parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace

CONTINUOUS, CATEGORICAL, IGNORED = 0, 1, -1
_SUFFIX = {"$": CATEGORICAL, "#": IGNORED}


@dataclass(frozen=True)
class FeatureSpec:
    """A feature's name as in the header and its kind."""

    name: str
    kind: int = CONTINUOUS

    @classmethod
    def parse(cls, name: str) -> FeatureSpec:
        """The last character tells the kind: ``$`` categorical, ``#`` ignored."""
        return cls(name, _SUFFIX.get(name[-1:], CONTINUOUS))

    @property
    def stem(self) -> str:
        """The name without its suffix, as used in file names."""
        return self.name.removesuffix("$")


def parse_header(lines: list[str]) -> tuple[str, list[FeatureSpec]]:
    """Label name and features; a header has one name per line, the label first."""
    names = [x.strip() for x in lines if x.strip()]
    if not names:
        raise ValueError("the header is empty")
    return names[0], [FeatureSpec.parse(x) for x in names[1:]]


def default_header(n_features: int) -> tuple[str, list[FeatureSpec]]:
    """Names for data without a header: all features continuous."""
    return "label", [FeatureSpec(f"F_{i}") for i in range(n_features)]


@dataclass(frozen=True)
class TreeParams:
    """Defaults are those of the tree trainer's command line."""

    loss: str = "square"
    max_depth: int = 5
    min_gain_fraction: float = 0.01
    min_local_gain_fraction: float = 1.0
    min_count: int = 2
    min_weight: float = 2.0
    max_quantiles: int = 1000
    max_quantile_samples: int = 100_000
    batch_size: int = 128
    use_global_quantiles: bool = True
    histograms_method: str = "array-aggregate"
    seed: int = 42

    #: All names give the same histograms: Catalyst picks how to aggregate.
    METHODS = ("map-reduce", "mapreduce", "aggregate", "array-aggregate", "parts-aggregate")

    def __post_init__(self):
        if self.loss not in ("square", "entropy"):
            raise ValueError(f"unknown loss: {self.loss}")
        if self.histograms_method not in self.METHODS:
            raise ValueError(f"unknown histograms method: {self.histograms_method}")


@dataclass(frozen=True)
class ForestParams:
    tree: TreeParams = replace(TreeParams(), max_depth=4)
    num_trees: int = 5
    shrinkage: float = 0.8
    persist_interval: int = 5
