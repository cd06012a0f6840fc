"""Configuration in JSON: camel-case keys, a warning for unknown ones, checked before any work (S1)."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import MISSING, dataclass, field, fields, replace
from typing import Any

from pyspark.sql import SparkSession

from .functions.text import STOPWORDS
from .operators.selection import Settings


class ConfigError(ValueError):
    """A configuration that cannot be used."""


def _snake(key: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", key).lower()


def build(kind: type, data: Mapping[str, Any]):
    """A settings object of given keys; keys it does not know are left out with a warning, required ones must be there."""
    check(isinstance(data, Mapping), f"{kind.__name__} needs an object, not {data!r}")
    given = {_snake(k): v for k, v in data.items()}
    known = {f.name: f for f in fields(kind)}
    if missing := [n for n, f in known.items() if n not in given and f.default is MISSING and f.default_factory is MISSING]:
        raise ConfigError(f"{kind.__name__} needs {missing}")
    if unknown := sorted(k for k in data if _snake(k) not in known):
        warnings.warn(f"{kind.__name__} does not know {unknown}", stacklevel=2)
    return kind(**{n: v for n, v in given.items() if n in known})


def check(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class Source:
    file_name: str
    id_col: str | int = 0
    source_col: str | None = None
    traits: Sequence[Mapping[str, Any]] = ()
    name: str | None = None
    has_header: bool = True

    @property
    def keys(self) -> list[str]:
        return [k for t in self.traits for k in t.get("keys", ())]


@dataclass(frozen=True)
class PairMapping:
    file_name: str
    left_id_col: str | int = 0
    right_id_col: str | int = 1
    left_source_col: str | int | None = None
    right_source_col: str | int | None = None
    has_header: bool = True


@dataclass(frozen=True)
class ClusterMapping:
    file_name: str
    id_col: str = "id"
    source_col: str | None = "source"
    label_col: str = "cluster_id"
    has_header: bool = True


@dataclass(frozen=True)
class DatasetConfig:
    directory: str
    sources: Sequence[Source]
    pairwise_mapping: PairMapping
    cluster_mapping: ClusterMapping | None = None
    name: str | None = None
    type: str = "csv"

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("sources", tuple(s if isinstance(s, Source) else build(Source, s) for s in self.sources))
        if isinstance(self.pairwise_mapping, Mapping):
            put("pairwise_mapping", build(PairMapping, self.pairwise_mapping))
        if isinstance(self.cluster_mapping, Mapping):
            put("cluster_mapping", build(ClusterMapping, self.cluster_mapping))
        check(bool(self.sources), "a dataset needs a source")
        put("name", self.name or self.directory.rstrip("/").rpartition("/")[2])


@dataclass(frozen=True)
class ProfilingConfig:
    negative_similarity: bool = False
    surface_baseline: bool = False
    synthetic_detectability: bool = False
    seed: int = 42
    cv_folds: int = 5
    neg_pos_ratio: float = 4.0
    split_ratio: Sequence[float] = (3, 1, 1)

    def __post_init__(self) -> None:
        check(self.cv_folds >= 2, "cvFolds must be at least 2")
        check(self.neg_pos_ratio > 0, "negPosRatio must be positive")
        check(len(self.split_ratio) == 3 and all(x > 0 for x in self.split_ratio), "splitRatio needs three positive parts")

    @property
    def enabled(self) -> list[str]:
        return [n for n in ("negative_similarity", "surface_baseline", "synthetic_detectability") if getattr(self, n)]


@dataclass(frozen=True)
class SelectionConfig:
    """How an alpha is chosen from a sweep: one criterion or several, and their bounds."""

    criterion: str | Sequence[str] = "smallest"
    min_separability: float = 0.2
    max_auc: float = 0.9
    target_resolvable: float = 0.5
    max_detect_auc: float = 0.7

    def __post_init__(self) -> None:
        check(0.5 < self.max_auc <= 1, "maxAuc must lie above 0.5, at most at 1")
        check(0 <= self.min_separability <= 2 * self.max_auc - 1, "minSeparability and maxAuc leave no band")
        check(0 <= self.target_resolvable <= 1, "targetResolvable must lie in [0, 1]")
        check(0.5 <= self.max_detect_auc <= 1, "maxDetectAuc must lie in [0.5, 1]")
        self.settings  # noqa: B018  (unknown criteria fail here)

    @property
    def settings(self) -> Settings:
        names = (self.criterion,) if isinstance(self.criterion, str) else tuple(self.criterion)
        try:
            return Settings(names, self.min_separability, self.max_auc, self.target_resolvable, self.max_detect_auc)
        except ValueError as e:
            raise ConfigError(str(e)) from e


@dataclass(frozen=True)
class ThresholdConfig:
    """The sweep of thresholds (around the fitted one where not given) and the fit."""

    start_value: float | None = None
    step_count: int | None = None
    step_size: float | None = None
    gmm_restarts: int = 50

    def __post_init__(self) -> None:
        check(self.step_count is None or self.step_count >= 1, "stepCount must be at least 1")
        check(self.step_size is None or self.step_size >= 0.1, "stepSize must be at least 0.1")
        check(self.gmm_restarts >= 1, "gmmRestarts must be at least 1")


def nested(settings: Any, **kinds: type) -> None:
    """Turn a settings object's given blocks into their kinds."""
    for name, kind in kinds.items():
        if getattr(settings, name) is not None and not isinstance(getattr(settings, name), kind):
            object.__setattr__(settings, name, build(kind, getattr(settings, name)))


@dataclass(frozen=True)
class AnalysisConfig:
    """What only ``analyse`` reads."""

    selection: SelectionConfig = field(default_factory=SelectionConfig)
    threshold: ThresholdConfig = field(default_factory=ThresholdConfig)

    def __post_init__(self) -> None:
        nested(self, selection=SelectionConfig, threshold=ThresholdConfig)


@dataclass(frozen=True)
class PairingConfig:
    strategy: str = "greedy-cluster-reps"
    neighbours: int = 1
    scope: str = "any"
    max_block_size: int = 100

    def __post_init__(self) -> None:
        check(self.strategy in ("greedy-cluster-reps", "simple-pairs"), f"unknown pairing strategy {self.strategy!r}")
        check(self.scope in ("any", "mutual"), f"unknown pairing scope {self.scope!r}")
        check(self.neighbours >= 1, "pairingNeighbours must be at least 1")
        check(self.max_block_size >= 2, "pairingMaxBlockSize must be at least 2")

    def links(self, asked: int) -> int:
        """G5. One link a pair where records are paired directly."""
        return 1 if self.strategy == "simple-pairs" else asked


@dataclass(frozen=True)
class InputConfig:
    dataset: DatasetConfig
    alphas: Sequence[float]
    ambiguity_targets: Sequence[str] | None = None
    secondary_features: Sequence[str] | None = None
    min_ambiguity: float | str | None = None
    target_floor: float = 0.0
    target_links: int = 1
    max_length_ratio: float | None = None
    pairing: Mapping[str, Any] | None = None
    analysis: AnalysisConfig | None = None

    def __post_init__(self) -> None:
        nested(self, dataset=DatasetConfig, analysis=AnalysisConfig)
        object.__setattr__(self, "alphas", tuple(sorted(set(self.alphas))))
        for name in ("ambiguity_targets", "secondary_features"):
            object.__setattr__(self, name, tuple(getattr(self, name) or ()))
        check(bool(self.alphas) and all(0 < a < 1 for a in self.alphas), "alphas must lie between 0 and 1")
        check(0 <= self.target_floor <= 1, "targetFloor must lie in [0, 1]")
        check(self.target_links >= 1, "targetLinks must be at least 1")
        check(self.max_length_ratio is None or self.max_length_ratio >= 1, "maxLengthRatio must be at least 1")
        check(self.min_ambiguity is None or self.min_ambiguity == "auto" or isinstance(self.min_ambiguity, (int, float)), "minAmbiguity is a number, auto or nothing")


@dataclass(frozen=True)
class AmbiguityConfig:
    input_data: Sequence[InputConfig]
    profiling: ProfilingConfig = field(default_factory=ProfilingConfig)
    analysis: AnalysisConfig = field(default_factory=AnalysisConfig)
    pairing_strategy: str = "greedy-cluster-reps"
    pairing_neighbours: int = 1
    pairing_scope: str = "any"
    pairing_max_block_size: int = 100
    stop_words: Sequence[str] = STOPWORDS

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("input_data", tuple(i if isinstance(i, InputConfig) else build(InputConfig, i) for i in self.input_data))
        put("stop_words", tuple(w.lower() for w in self.stop_words))
        nested(self, profiling=ProfilingConfig, analysis=AnalysisConfig)
        check(bool(self.input_data), "inputData must not be empty")
        for entry in self.input_data:
            self.pairing_of(entry)

    def pairing_of(self, entry: InputConfig) -> PairingConfig:
        """The common settings with those of the entry laid over them, key by key."""
        base = PairingConfig(self.pairing_strategy, self.pairing_neighbours, self.pairing_scope, self.pairing_max_block_size)
        given = {_snake(k).removeprefix("pairing_"): v for k, v in (entry.pairing or {}).items() if v is not None}
        known = {f.name for f in fields(PairingConfig)}
        if unknown := sorted(set(given) - known):
            warnings.warn(f"pairing does not know {unknown}", stacklevel=2)
        return replace(base, **{k: v for k, v in given.items() if k in known})

    def analysis_of(self, entry: InputConfig) -> AnalysisConfig:
        """The entry's own settings, as a whole, or the common ones."""
        return entry.analysis or self.analysis


@dataclass(frozen=True)
class SpaceConfig:
    file_name: str
    sample_count: int | None = None
    neg_pos_ratio: float = 4.0
    match_bridge_ratio: float = 2.0
    bridge_source: str | None = None
    has_header: bool = True
    left_id_col: str | int = 0
    left_source_col: str | int | None = None
    right_id_col: str | int = 1
    right_source_col: str | int | None = None
    excluded_files: Sequence[str] = ()


@dataclass(frozen=True)
class BenchmarkConfig:
    dataset: DatasetConfig
    comparison_space: SpaceConfig
    clusters_file_name: str | None = None
    dataset_alias: str | None = None

    def __post_init__(self) -> None:
        nested(self, dataset=DatasetConfig, comparison_space=SpaceConfig)

    @property
    def name(self) -> str:
        return self.dataset_alias or self.dataset.name


@dataclass(frozen=True)
class MatcherConfig:
    name: str
    type: str = "coverage"
    path: str | None = None
    match: float = 0.5
    one_way: float = 0.8

    def path_for(self, dataset: str) -> str:
        """F28. The model's path, with the dataset's name in place of ``{dataset_name}``."""
        check(bool(self.path), f"matcher {self.name} needs a path")
        return self.path.replace("{dataset_name}", dataset)


@dataclass(frozen=True)
class EvaluationConfig:
    benchmark_data: Sequence[BenchmarkConfig]
    matching: Sequence[MatcherConfig] = ()
    clustering: Mapping[str, Any] = field(default_factory=dict)
    seed: int = 42

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("benchmark_data", tuple(b if isinstance(b, BenchmarkConfig) else build(BenchmarkConfig, b) for b in self.benchmark_data))
        put("matching", tuple(m if isinstance(m, MatcherConfig) else build(MatcherConfig, m) for m in self.matching or ()))
        check(bool(self.benchmark_data), "benchmarkData must not be empty")

    @property
    def algorithms(self) -> list[str]:
        return list((self.clustering or {}).get("algorithms", ()))


def load(spark: SparkSession, path: str, kind: type):
    """A configuration file, from any path Spark reads."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"{path} is no JSON: {e}") from e
    return build(kind, data)
