"""Extension point: a further detector as column expressions, with its own weight in the composite risk."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewall import fixed


class Registered(NamedTuple):
    rules: fixed.Detector
    labels: Callable[[Column], Column]  # text column -> ARRAY<STRING> of labels


def register_detector(
    name: str,
    labels: Callable[[Column], Column],
    severity: str = "MEDIUM",
    default_weight: str = "0.50",
    weights: dict[str, str] | None = None,
) -> Registered:
    """A detector for `screen(..., extra=(...,))`.

    ``labels`` builds the label array from built-in functions, so the detector runs inside the same stage as the
    others.  A detector without a listed weight weighs 0.15 in the composite risk.
    """
    key = name.lower().replace(" ", "_")
    return Registered(fixed.Detector(key, name, name, severity, default_weight, weights or {}), labels)


def pattern_labels(**patterns: str) -> Callable[[Column], Column]:
    """Label builder from label=pattern pairs (Java regex syntax)."""
    return lambda text: F.array_compact(
        F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(label)) for label, p in patterns.items()])
    )
