"""Scores of retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_score(similarity: Column, confidence: Column, salience: Column) -> Column:
    """Similarity weighed by confidence and salience, neither of which takes away more than two fifths."""
    half = lambda c: F.coalesce(c, F.lit(0.5))
    return similarity * (0.6 + 0.4 * half(confidence)) * (0.6 + 0.4 * half(salience))


def superseded(valid_to: Column, as_of: Column) -> Column:
    """True once the validity has ended; an end in the future does not count."""
    return F.coalesce(valid_to <= as_of, F.lit(False))


def validity(valid_to: Column, as_of: Column) -> Column:
    return F.when(superseded(valid_to, as_of), 0.7).otherwise(1.0)


def entity_bonus(shared: Column) -> Column:
    return F.least(F.lit(0.3), shared * 0.1)


def ratio(part: Column, whole: Column, empty: float | None = 1.0) -> Column:
    """part / whole to four places; ``empty`` where there is nothing to divide by."""
    return F.round(F.when(whole == 0, F.lit(empty)).otherwise(part / whole), 4)


def f1(precision: Column, recall: Column) -> Column:
    return F.round(F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall)), 4)
