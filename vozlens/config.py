"""Validated configuration, read from YAML, and the gates that must hold before a run."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class WindowsConfig:
    min_duration_s: float = 30.0
    max_duration_s: float = 60.0
    min_segments: int = 8
    max_segments: int = 15
    gap_tolerance_s: float = 2.0
    n_windows_per_speaker: int = 10
    interviewer_turn: str = "close_window"
    allow_fewer_windows: bool = True
    seed: int = 20260918

    def __post_init__(self) -> None:
        if not 0 < self.min_duration_s <= self.max_duration_s or not 0 < self.min_segments <= self.max_segments:
            raise ValueError("the bounds of durations and segments must be positive and ordered")
        if self.interviewer_turn not in ("close_window", "ignore"):
            raise ValueError("interviewer_turn is close_window or ignore")
        if self.gap_tolerance_s < 0 or self.n_windows_per_speaker < 1:
            raise ValueError("the gap can't be negative, and at least one window is drawn")


@dataclass(frozen=True)
class ModelSpec:
    key: str
    provider: str
    model_id: str
    role: str
    version: str = ""
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.role not in ("text_qa", "audio_qa", "asr"):
            raise ValueError(f"unknown role {self.role!r}")


@dataclass(frozen=True)
class ItemsConfig:
    generator: str = ""
    n_context_windows: int = 3
    require_provenance: bool = True
    n_runs: int = 3
    discard_if_correct_at_least: int = 2
    any_model_discards: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.discard_if_correct_at_least <= self.n_runs:
            raise ValueError("an item is discarded at 1 to n_runs correct runs")


@dataclass(frozen=True)
class EvalConfig:
    conditions: tuple = ("asr", "reference", "audio")
    max_concurrency: int = 4
    max_retries: int = 6
    shuffle_alternatives: bool = True
    require_contamination_check: bool = True


@dataclass(frozen=True)
class AnalysisConfig:
    covariates: tuple = ("region", "age", "speaker_gender")
    age_range: tuple = (20, 69)
    n_resamples: int = 2000
    seed: int = 20260918
    ci_level: float = 0.95
    ceiling: float = 1.0
    items_grid: tuple = (3, 5, 8, 10)
    duration_bins: tuple = (30, 40, 50, 60)

    def __post_init__(self) -> None:
        if "region" not in self.covariates:
            raise ValueError("region must be a covariate")
        if not 0 < self.ci_level < 1 or not 0 <= self.ceiling <= 1:
            raise ValueError("ci_level lies within 0 and 1, the ceiling from 0 to 1")


def from_mapping(kind: type, values: dict[str, Any]) -> Any:
    """A config object; unknown keys are an error, lists become tuples."""
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"{kind.__name__} doesn't know {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(kind: type, path: str) -> Any:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(kind, yaml.safe_load(f) or {})


def assert_contamination_checked(checked: bool, config: EvalConfig) -> None:
    if config.require_contamination_check and not checked:
        raise ValueError("the recogniser's training data hasn't been checked for contamination")


def assert_no_placeholders(specs: list[ModelSpec]) -> None:
    bad = [s.key for s in specs if not s.model_id or s.model_id.startswith(("TODO", "<"))]
    if bad:
        raise ValueError(f"models without an id: {bad}")


def assert_generator_not_evaluated(items: ItemsConfig, specs: list[ModelSpec]) -> None:
    if items.generator in {s.model_id for s in specs}:
        raise ValueError("the generator is among the evaluated models")
