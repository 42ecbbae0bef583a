"""Scalar gates: margins out of peak ratios, certainty, routing to a costly stretch, values that override a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def margin_of_ratio(score: Column, ratio: Column) -> Column:
    """score * (1 - 1 / ratio), 0 for ratios up to 1."""
    return F.when(ratio > 1, score * (1 - 1 / ratio)).otherwise(0.0)


def high_margin(margin: Column, confidence: Column, least_margin: float = 0.12, least_confidence: float = 0.45) -> Column:
    return (margin >= least_margin) & (confidence >= least_confidence)


def uncertain(margin: Column, confidence: Column) -> Column:
    return (confidence < 0.20) | (margin < 0.05)


def needs_stretch(n_in: Column, n_out: Column, rate: float) -> Column:
    """Lengths in frames differ by more than 20 ms (2 frames at least) and by more than 2 %."""
    return (F.abs(n_in - n_out) > max(2.0, 0.02 * rate)) & (F.abs(n_in / F.when(n_out > 0, n_out) - 1) > 0.02)


def explicit(value: Column, stock: Column) -> Column:
    """value unless it is the default within 1e-6, then null: a default overrides nothing."""
    return F.when(F.abs(value - stock) > 1e-6, value)
