"""Typed configuration from dictionaries or YAML, checked when it is made."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

from wavelattice.operators.recurrence import METRICS
from wavelattice.operators.series import AGGREGATES
from wavelattice.operators.transition import SYMBOLISERS
from wavelattice.operators.visibility import TIE_RULES, WEIGHTS


def _one_of(name: str, value: object, allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}; got {value!r}")


@dataclass
class Dataset:
    name: str
    path: str
    id_col: str | None = None
    time_col: str = "timestamp"
    value_col: str = "value"
    start: str | None = None
    end: str | None = None
    tz: str | None = None


@dataclass
class Sampling:
    frequency: str | None = None
    agg: str = "mean"

    def __post_init__(self) -> None:
        _one_of("sampling.agg", self.agg, AGGREGATES)


@dataclass
class Visibility:
    enabled: bool = False
    limit: int | None = None
    tie_rule: str = "stack"
    weight_mode: str | None = None
    directed: bool = False
    max_edges: int | None = None
    max_edges_per_node: int | None = None

    def __post_init__(self) -> None:
        _one_of("tie_rule", self.tie_rule, TIE_RULES)
        if self.weight_mode is not None:
            _one_of("weight_mode", self.weight_mode, WEIGHTS)


@dataclass
class Recurrence:
    enabled: bool = False
    rule: str = "knn"
    k: int = 5
    epsilon: float = 0.1
    m: int = 1
    tau: int = 1
    metric: str = "euclidean"
    theiler: int = 0

    def __post_init__(self) -> None:
        _one_of("recurrence.rule", self.rule, ("knn", "epsilon", "radius"))
        _one_of("recurrence.metric", self.metric, METRICS)


@dataclass
class Transition:
    enabled: bool = False
    symbolizer: str = "ordinal"
    order: int = 3
    delay: int = 1
    bins: int = 5
    memory: int = 1

    def __post_init__(self) -> None:
        _one_of("transition.symbolizer", self.symbolizer, SYMBOLISERS)


@dataclass
class Graphs:
    hvg: Visibility = field(default_factory=Visibility)
    nvg: Visibility = field(default_factory=Visibility)
    recurrence: Recurrence = field(default_factory=Recurrence)
    transition: Transition = field(default_factory=Transition)


@dataclass
class Windows:
    enabled: bool = False
    size: int = 100
    step: int = 50

    def __post_init__(self) -> None:
        if self.size < 2 or self.step < 1:
            raise ValueError("windows.size must be 2 or more and windows.step positive")


@dataclass
class Structural:
    enabled: bool = False
    trend: bool = False
    period: int = 0


@dataclass
class Output:
    path: str
    format: str = "parquet"
    overwrite: bool = False

    def __post_init__(self) -> None:
        _one_of("output.format", self.format, ("parquet", "json", "csv"))


@dataclass
class Pipeline:
    dataset: Dataset
    output: Output
    graphs: Graphs = field(default_factory=Graphs)
    sampling: Sampling = field(default_factory=Sampling)
    windows: Windows = field(default_factory=Windows)
    structural: Structural = field(default_factory=Structural)

    @staticmethod
    def from_dict(raw: dict) -> Pipeline:
        """A checked configuration; missing sections and unknown keys raise ValueError."""
        for section in ("dataset", "graphs", "output"):
            if section not in raw:
                raise ValueError(f"section {section} is missing")
        return _build(Pipeline, raw, "config")

    @staticmethod
    def from_yaml(path: str) -> Pipeline:
        import yaml

        with open(path, encoding="utf-8") as f:
            return Pipeline.from_dict(yaml.safe_load(f) or {})

    def to_dict(self) -> dict:
        return asdict(self)


_NESTED = {
    "dataset": Dataset, "output": Output, "graphs": Graphs, "sampling": Sampling, "windows": Windows, "structural": Structural,
    "hvg": Visibility, "nvg": Visibility, "recurrence": Recurrence, "transition": Transition,
}


def _build(kind: type, raw: dict, where: str):
    known = {f.name for f in fields(kind)}
    unknown = sorted(set(raw) - known)
    if unknown:
        raise ValueError(f"{where}: unknown key {', '.join(unknown)}")
    return kind(**{k: _build(_NESTED[k], v or {}, f"{where}.{k}") if k in _NESTED and not isinstance(v, bool) else v for k, v in raw.items()})
