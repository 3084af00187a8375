"""Study configuration. Frozen dataclasses; ``as_row`` gives the JSON form that is stored next to results."""

from __future__ import annotations

import json
from dataclasses import KW_ONLY, asdict, dataclass, field
from datetime import datetime, timezone

# Ids of samples that never enter a study, and the id of the internal-standard feature.
EXCLUDED_SAMPLE_IDS = ("02338", "02347")
INTERNAL_STANDARD_ID = 9500

# The six comparisons of the standard study, negative class first.
STANDARD_PAIRS = (
    ("control", "activated"),
    ("control", "incident"),
    ("control", "prevalent"),
    ("activated", "incident"),
    ("activated", "prevalent"),
    ("incident", "prevalent"),
)


def check_limits(max_iter: int | None, tol: float | None) -> None:
    """Raise unless step limit and tolerance are positive numbers or left to the model."""
    if max_iter is not None and (isinstance(max_iter, bool) or int(max_iter) != max_iter or max_iter < 1):
        raise ValueError(f"max_iter must be a whole number of at least 1, not {max_iter!r}")
    if tol is not None and (isinstance(tol, bool) or not tol > 0):
        raise ValueError(f"tol must be a number above 0, not {tol!r}")


@dataclass(frozen=True, kw_only=True)
class Preprocess:
    fallback_eps: float = 1e-3
    internal_standard_id: int = INTERNAL_STANDARD_ID
    drop_internal_standard: bool = True
    noise_scale: float = 0.001
    nan_threshold: float = 0.5
    k_neighbors: int = 4
    seed: int = 42
    scale: bool = True
    with_mean: bool = True
    with_std: bool = True


@dataclass(frozen=True)
class MissingnessFilter:
    min_prop: float | None = 0.6
    _: KW_ONLY
    min_group_n: int = 3
    require_all: bool = False
    group_cols: tuple[str, ...] | None = None  # None: the label column


@dataclass(frozen=True)
class Resampling:
    under_sample: bool = False
    _: KW_ONLY
    target_ratio: float | None = 5.0
    under_sample_strategy: str | float | dict = "auto"
    smote: bool = False
    smote_strategy: str | float | dict = "auto"
    smote_k: int = 5
    smote_m: int = 10


@dataclass(frozen=True)
class SparseModel:
    """Sparse selector: ``l1_svm`` (L1-penalised squared hinge) or ``elastic_net`` (logistic)."""

    kind: str = "l1_svm"
    _: KW_ONLY
    lam: float = 1e-3
    C: float = 0.1
    l1_ratio: float = 0.9
    fit_intercept: bool = True
    max_iter: int = 20_000
    tol: float = 1e-6
    step_size: float | None = None
    accelerate: bool = True  # False: plain proximal steps of 1 / (2 R^2) unless step_size is given
    weight_tol: float = 1e-6

    def __post_init__(self):
        check_limits(self.max_iter, self.tol)

    @property
    def evaluator(self) -> str:
        """The classifier family that scores the selected features."""
        return "svc" if self.kind == "l1_svm" else "logistic"


@dataclass(frozen=True)
class Study:
    """What every run needs: where the star schema lies and which comparisons to make."""

    db_root: str
    pairs: tuple[tuple[str, str], ...] = STANDARD_PAIRS
    _: KW_ONLY
    label_col: str = "condition"
    preprocess: Preprocess = field(default_factory=Preprocess)
    n_folds: int = 5
    seed: int = 42
    out_dir: str | None = None
    run_id: str | None = None
    notes: str = ""

    def resolved_run_id(self) -> str:
        return self.run_id or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")


@dataclass(frozen=True)
class UnionSelection:
    study: Study
    model: SparseModel = field(default_factory=SparseModel)
    missingness: MissingnessFilter = field(default_factory=MissingnessFilter)
    resampling: Resampling = field(default_factory=Resampling)
    _: KW_ONLY
    eval_C: float = 1.0
    threshold: float = 0.6
    max_iterations: int = 10


@dataclass(frozen=True)
class UnionFinal:
    study: Study
    classifier: str = "svc"  # or "logistic"
    _: KW_ONLY
    balanced: bool = True
    C_grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    max_iter: int | None = None  # None: the default of the classifier
    tol: float | None = None
    missingness: MissingnessFilter = field(default_factory=MissingnessFilter)
    resampling: Resampling = field(default_factory=Resampling)

    def __post_init__(self):
        check_limits(self.max_iter, self.tol)


@dataclass(frozen=True)
class BootstrapSelection:
    study: Study
    model: SparseModel = field(default_factory=SparseModel)
    missingness: MissingnessFilter = field(default_factory=MissingnessFilter)
    resampling: Resampling = field(default_factory=Resampling)
    _: KW_ONLY
    replicates: int = 100
    eval_C: float = 1.0


@dataclass(frozen=True)
class BootstrapFinal:
    study: Study
    classifier: str = "svc"
    C_grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)
    _: KW_ONLY
    max_iter: int | None = None
    tol: float | None = None
    fit_final: bool = True

    def __post_init__(self):
        check_limits(self.max_iter, self.tol)


def as_row(config) -> dict:
    """One row per run: the kind of run, its id and the whole configuration as JSON text."""
    study = config.study
    return {
        "run_id": study.resolved_run_id(),
        "stage": type(config).__name__,
        "config": json.dumps(asdict(config), sort_keys=True),
    }
