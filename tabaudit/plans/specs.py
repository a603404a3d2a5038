"""Declarations: what to compare and how, and the expansion of parameter grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from tabaudit.operators.metrics import METRICS, Metric, custom
from tabaudit.operators.models import ESTIMATORS, check_params
from tabaudit.operators.prep import PrepSpec

DEFAULT_METRIC = "f1"
REDUCERS = ("pca",)
SAMPLERS = ("under", "over", "smote")


@dataclass(frozen=True)
class ModelSpec:
    """One chain: preparation, optional reduction and sampler, and an estimator with its grid."""

    name: str
    estimator: str
    params: Mapping[str, Any] = field(default_factory=dict)
    prep: PrepSpec = PrepSpec()
    reduction: str | None = None
    reduction_params: Mapping[str, Any] = field(default_factory=dict)
    sampler: str | None = None

    def __post_init__(self) -> None:
        if self.estimator not in ESTIMATORS:
            raise ValueError(f"no such estimator: {self.estimator}")
        check_params(self.estimator, self.params)
        if self.sampler is not None and self.sampler not in SAMPLERS:
            raise ValueError(f"no such sampler: {self.sampler}")

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any]) -> ModelSpec:
        """Read ``{name, steps: {preprocess, feature_selection, reduction, sampler, estimator}}``.

        Absent steps are skipped, an unknown reduction type as well.
        """
        steps = spec.get("steps") or {}
        before = steps.get("preprocess") or {}
        selection = steps.get("feature_selection") or {}
        reduction = steps.get("reduction") or {}
        estimator = steps.get("estimator") or {}
        kind = reduction.get("type")
        if kind == "umap":
            raise ValueError("umap is not supported")
        return cls(
            name=spec.get("name"),
            estimator=estimator.get("type"),
            params=estimator.get("params") or {},
            prep=PrepSpec(
                imputer=before.get("imputer") if before.get("imputer") == "simple" else None,
                scaler=before.get("scaler") if before.get("scaler") == "standard" else None,
                **{k: selection.get(k) for k in ("variance_threshold", "select_k_best", "select_percentile")},
            ),
            reduction=kind if kind in REDUCERS else None,
            reduction_params=(reduction.get("params") or {}) if kind in REDUCERS else {},
            sampler=(steps.get("sampler") or {}).get("type"),
        )

    def grid(self) -> dict[str, list[Any]]:
        """Parameter lists by ``step__name``; a scalar is a list of one."""
        named = {f"reduction__{k}": v for k, v in self.reduction_params.items()}
        named |= {f"estimator__{k}": v for k, v in self.params.items()}
        return {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in named.items()}

    def candidates(self) -> list[Candidate]:
        return expand_grid(self.grid())


# Libraries whose settings an automated entry may carry, and the entry's defaults.
AUTO_LIBRARIES = ("tpot",)
AUTO_GENERATIONS, AUTO_POPULATION, AUTO_FOLDS = 5, 50, 5


@dataclass(frozen=True)
class AutoSpec:
    """An entry that leaves the choice of a chain to the budgeted search.

    The settings of an evolutionary search are read as a budget: generations times population is the number of candidates.
    """

    name: str
    max_candidates: int = AUTO_GENERATIONS * AUTO_POPULATION
    max_seconds: float | None = None
    metric: str = DEFAULT_METRIC
    folds: int = AUTO_FOLDS
    seed: int | None = None
    export_path: str | None = None

    def __post_init__(self) -> None:
        _metric(self.metric)
        if self.max_candidates < 1 or self.folds < 2:
            raise ValueError(f"{self.name} needs a candidate and two folds at least")

    @classmethod
    def from_dict(cls, entry: Mapping[str, Any]) -> AutoSpec:
        """Read ``{library, name, <library>: {generations, population_size, max_time_mins, scoring, cv, ...}}``."""
        library = entry.get("library")
        if library not in AUTO_LIBRARIES:
            raise ValueError(f"no search stands for the library {library!r}")
        settings = entry.get(library) or {}
        minutes, seed = settings.get("max_time_mins"), settings.get("random_state")
        generations = int(settings.get("generations") or AUTO_GENERATIONS)
        return cls(
            name=entry.get("name") or library,
            max_candidates=generations * int(settings.get("population_size") or AUTO_POPULATION),
            max_seconds=None if minutes is None else 60.0 * float(minutes),
            metric=settings.get("scoring") or DEFAULT_METRIC,
            folds=int(settings.get("cv") or AUTO_FOLDS),
            seed=None if seed is None else int(seed),
            export_path=settings.get("export_path") if settings.get("export_best_pipeline") else None,
        )


def spec_from_dict(spec: Mapping[str, Any]) -> ModelSpec | AutoSpec:
    """A declared chain, or the search that an ``automl`` entry asks for."""
    if spec.get("automl"):
        return AutoSpec.from_dict({"name": spec.get("name"), **spec["automl"]})
    return ModelSpec.from_dict(spec)


@dataclass(frozen=True)
class Candidate:
    cand_id: int
    params: Mapping[str, Any]

    def step(self, name: str) -> dict[str, Any]:
        """Parameters of one step, without the step's prefix."""
        start = f"{name}__"
        return {k[len(start) :]: v for k, v in self.params.items() if k.startswith(start)}

    def as_text(self) -> dict[str, str]:
        return {k: "null" if v is None else str(v) for k, v in self.params.items()}


def expand_grid(grid: Mapping[str, Sequence[Any]]) -> list[Candidate]:
    """All combinations, keys sorted, the last key changing fastest."""
    names = sorted(grid)
    return [
        Candidate(i, dict(zip(names, values)))
        for i, values in enumerate(product(*[grid[n] for n in names]))
    ]


@dataclass(frozen=True)
class CvPlan:
    """Folds, metrics and the metric that picks the best candidate."""

    folds: int = 5
    metrics: Mapping[str, Metric] = field(default_factory=lambda: {DEFAULT_METRIC: METRICS[DEFAULT_METRIC]})
    refit: str = DEFAULT_METRIC
    seed: int = 42

    @classmethod
    def from_dict(cls, config: Mapping[str, Any], seed: int = 42) -> CvPlan:
        """Read ``{cv_folds, scoring, refit}``; scoring is a name, a list, or name -> scorer."""
        scoring, folds = config.get("scoring"), int(config.get("cv_folds", 5))
        if scoring is None:
            names: Mapping[str, Any] = {DEFAULT_METRIC: DEFAULT_METRIC}
        elif isinstance(scoring, str):
            return cls(folds, {scoring: _metric(scoring)}, scoring, seed)
        elif isinstance(scoring, (list, tuple)):
            names = {m: m for m in scoring}
        elif isinstance(scoring, Mapping):
            names = scoring
        else:
            raise ValueError(f"scoring must be a name, a list or a mapping, not {type(scoring).__name__}")
        refit = (config.get("refit") if scoring is not None else None) or next(iter(names))
        if refit not in names:
            raise ValueError(f"refit metric {refit} is not scored")
        return cls(folds, {n: _metric(m) for n, m in names.items()}, refit, seed)


def _metric(metric: Any) -> Metric:
    """A metric by name, or a scorer made into one."""
    if isinstance(metric, str):
        if metric not in METRICS:
            raise ValueError(f"Unknown metric {metric}")
        return METRICS[metric]
    return custom(metric)


# The comparison that runs when none is declared.
DEFAULT_CV = {"cv_folds": 5, "scoring": ["f1", "balanced_accuracy", "average_precision"]}
DEFAULT_SPECS = (
    ModelSpec(
        name="linear_pca_svc",
        prep=PrepSpec(imputer="simple", scaler="standard", select_k_best=100),
        reduction="pca",
        reduction_params={"n_components": [0.8, 0.9, 0.95]},
        estimator="svc",
        params={"kernel": ["linear"], "C": [0.1, 1, 10]},
    ),
    ModelSpec(
        name="tree_no_reduction",
        prep=PrepSpec(imputer="simple"),
        estimator="random_forest",
        params={"n_estimators": [200, 500], "max_depth": [None, 10, 20]},
    ),
)
