"""Thresholds of the jobs, all overridable."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    short_answer_words: int = 6
    max_attempts: int = 3
    context_window: int = 8192
    violation_flag: float = 0.08
    violation_strong: float = 0.5
    toxicity: float = 0.5
    scoring_batch: int = 16
    min_cluster_points: int = 8
    min_cluster_percent: float = 1.0
    outlier_similarity: float = 0.30
    near_duplicate: float = 0.80
    carry_min: float = 0.50
    split_min: float = 0.20
    quiet_minutes: int = 30
    max_wait_minutes: int = 360
    answers_per_field: int = 20
    naming_examples: int = 12
    title_length: int = 255
    knn: int = 5
    growth_fractions: tuple[float, ...] = (0.15, 0.30, 0.50, 0.75, 1.0)
    folds: int = 5
    seed: int = 42
    label_set_size: int = 200
    repeats: int = 20
    repeat_gap: int = 100
    agreement_threshold: float = 0.75
    answer_length: int = 5000


DEFAULTS = Params()
