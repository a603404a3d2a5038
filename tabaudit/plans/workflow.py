"""The end-to-end run: take in, prepare, audit, compare and report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tabaudit.dataset import Dataset, from_rows, infer_target, split_target
from tabaudit.functions.storage import materialize
from tabaudit.operators.audit import CATEGORICAL_RATIO, analyze_raw, dataset_metadata, eda_summary
from tabaudit.operators.clean import MIN_SAMPLES, clean, outlier_flags, validate
from tabaudit.operators.profile import full_profile
from tabaudit.operators.report import report_table
from tabaudit.operators.search import SearchResult, compare, leaderboard
from tabaudit.plans.specs import DEFAULT_CV, DEFAULT_SPECS, AutoSpec, CvPlan, ModelSpec
from tabaudit.sources.runs import append_run
from tabaudit.sources.tables import (
    INPUT_EXTENSIONS,
    STAMP_FORMAT,
    archive,
    pick_input,
    read_table,
    write_artifact,
)


@dataclass(frozen=True)
class DataPlan:
    """How raw rows become a dataset."""

    enabled: bool = True
    target_column: str | None = None
    auto_detect_target: bool = True
    drop_columns: Sequence[str] = ()
    missing_strategy: str = "auto"
    categorical_threshold: float = CATEGORICAL_RATIO
    min_samples_threshold: int = MIN_SAMPLES
    outlier_detection: bool = False


@dataclass(frozen=True)
class IntakePlan:
    """Where inputs are found and whether they are archived."""

    in_dir: str
    out_dir: str
    enabled: bool = True
    extensions: Sequence[str] = INPUT_EXTENSIONS
    save_input_file: bool = True
    save_input_file_compression: bool = True


@dataclass(frozen=True)
class RunPlan:
    """All settings of a run; every stage can be switched off."""

    project: str = "default"
    output_dir: str | None = None
    seed: int = 42
    intake: IntakePlan | None = None
    data: DataPlan = DataPlan()
    audit: bool = True
    profile_minimal: bool = False
    compare: bool = True
    report: bool = True
    specs: Sequence[ModelSpec | AutoSpec] = DEFAULT_SPECS
    cv: Mapping[str, Any] = field(default_factory=lambda: dict(DEFAULT_CV))


@dataclass
class RunOutcome:
    """What each stage left behind, and the table of stages."""

    status: list[tuple[str, bool, str | None]] = field(default_factory=list)
    dataset: Dataset | None = None
    analysis: DataFrame | None = None
    metadata: DataFrame | None = None
    summary: DataFrame | None = None
    profile: dict[str, DataFrame] = field(default_factory=dict)
    results: list[SearchResult] = field(default_factory=list)
    profile_path: str | None = None
    report: DataFrame | None = None
    artifacts: list[str] = field(default_factory=list)

    def status_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.status, "stage string, ok boolean, error string")


def prepare(spark: SparkSession, raw: Any, plan: DataPlan = DataPlan(), key: str | None = None) -> Dataset:
    """Load, clean, split and validate."""
    cleaned = clean(from_rows(spark, raw), plan.missing_strategy, plan.drop_columns)
    if plan.outlier_detection:
        # Flags come after the fill and are no features.
        cleaned = materialize(cleaned, "cleaned")
    target = infer_target(cleaned, plan.target_column, plan.auto_detect_target)
    data = split_target(cleaned, target, key)
    if plan.outlier_detection:
        flagged = outlier_flags(cleaned, list(data.features))
        data = Dataset(flagged, data.features, data.target, data.key)
    validate(data.df, plan.min_samples_threshold)
    return data


def _attempt(outcome: RunOutcome, stage: str, work: Callable[[], None]) -> bool:
    """Run one stage; a failure is recorded and does not stop the others."""
    try:
        work()
    except Exception as error:  # noqa: BLE001
        outcome.status.append((stage, False, f"{type(error).__name__}: {error}"))
        return False
    outcome.status.append((stage, True, None))
    return True


def take_in(spark: SparkSession, plan: IntakePlan, now: datetime | None = None) -> tuple[DataFrame | None, list[str]]:
    """The first input as a frame, archived if asked, and the archived copies."""
    path = pick_input(spark, plan.in_dir, plan.extensions)
    if path is None:
        return None, []
    copies = []
    if plan.save_input_file:
        copies.append(archive(spark, path, plan.out_dir, plan.save_input_file_compression, now))
    return read_table(spark, path), copies


def run_all(
    spark: SparkSession,
    plan: RunPlan,
    data: Dataset | None = None,
    raw: Any = None,
    now: datetime | None = None,
) -> RunOutcome:
    """Run all stages on ``data`` as it is, on ``raw`` rows, or on the first input file.

    Given data skips the cleaning, so its nulls and duplicates reach the audit.
    Models are compared only with a target.
    """
    outcome = RunOutcome()
    now = now or datetime.now()
    root = None if plan.output_dir is None else f"{plan.output_dir.rstrip('/')}/{plan.project}"

    if data is None and raw is None and plan.intake is not None and plan.intake.enabled:
        frames: list[DataFrame | None] = []

        def intake() -> None:
            frame, copies = take_in(spark, plan.intake, now)
            frames.append(frame)
            outcome.artifacts += copies

        if not _attempt(outcome, "intake", intake) or frames[0] is None:
            return outcome
        raw = frames[0]

    if data is None:
        if raw is None:
            raise ValueError("no data, no raw rows and no enabled intake")
        prepared: list[Dataset] = []

        def preparation() -> None:
            frame = from_rows(spark, raw)
            if plan.data.enabled:
                target = infer_target(frame, plan.data.target_column, plan.data.auto_detect_target)
                outcome.analysis = analyze_raw(frame, plan.data.categorical_threshold, target)
                ready = prepare(spark, frame, plan.data)
            else:
                ready = split_target(frame, None)
            # Written once: the audit and the comparison read it many times.
            prepared.append(Dataset(materialize(ready.df, "prepared"), ready.features, ready.target, ready.key))

        if not _attempt(outcome, "data", preparation):
            return outcome
        data = prepared[0]

    outcome.dataset, outcome.metadata = data, dataset_metadata(data)

    if plan.audit:

        def audit() -> None:
            outcome.summary = materialize(eda_summary(data), "summary")
            outcome.profile = full_profile(data.df.select(*_audited(data)), plan.profile_minimal)
            if root is not None:
                outcome.artifacts.append(write_artifact(outcome.summary, f"{root}/audit", "eda_summary", ".json", now))
                for name, part in outcome.profile.items():
                    outcome.artifacts.append(write_artifact(part, f"{root}/audit", f"profile_{name}", ".json", now))
                outcome.profile_path = f"{root}/audit"

        _attempt(outcome, "audit", audit)

    if plan.compare and data.target is not None:

        def comparison() -> None:
            out_dir = None if root is None else f"{root}/models"
            outcome.results = compare(data, plan.specs, CvPlan.from_dict(plan.cv, plan.seed), out_dir=out_dir, now=now)
            outcome.artifacts += [r.cv_results_path for r in outcome.results if r.cv_results_path is not None]

        _attempt(outcome, "compare", comparison)

    if plan.report:

        def report() -> None:
            board = leaderboard(outcome.results, spark) if outcome.results else None
            outcome.report = report_table(spark, outcome.summary, board, outcome.profile_path)

        _attempt(outcome, "report", report)

    if plan.output_dir is not None:
        _attempt(outcome, "artifacts", lambda: _write_artifacts(spark, plan, outcome, now))
    return outcome


def _audited(data: Dataset) -> list[str]:
    names = [*data.features, *([data.target] if data.target else [])]
    return ["`" + n.replace("`", "``") + "`" for n in names]


def _write_artifacts(spark: SparkSession, plan: RunPlan, outcome: RunOutcome, now: datetime) -> None:
    """The report below ``<output>/<project>/reports`` and one row in the run index."""
    root = f"{plan.output_dir.rstrip('/')}/{plan.project}"
    if outcome.report is not None:
        outcome.artifacts.append(write_artifact(outcome.report, f"{root}/reports", "report", ".json", now))
    index = f"{plan.output_dir.rstrip('/')}/runs"
    append_run(spark, index, plan.project, now.strftime(STAMP_FORMAT), now, outcome.artifacts)
