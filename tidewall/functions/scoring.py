"""Detector scores in exact integer arithmetic.

Scores are carried as whole ten-thousandths (``bp``) and confidences as whole hundredths (``pct``), rounded half up.
That keeps every score exact, stays in generated code, and converts to DECIMAL(5,4) only at the edge.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.plan import map_literal, text_literal
from tidewall.functions.text import matched_tokens, squash


def bp(value: str) -> int:
    """'0.865' -> 8650."""
    scaled = Decimal(value) * 10000
    assert scaled == int(scaled)
    return int(scaled)


def as_score(points: Column) -> Column:
    """Ten-thousandths -> DECIMAL(5,4)."""
    return (points.cast("decimal(6,0)") * F.lit(Decimal("0.0001"))).cast("decimal(5,4)")


def as_confidence(percent: Column) -> Column:
    """Hundredths -> DECIMAL(5,4)."""
    return (percent.cast("decimal(4,0)") * F.lit(Decimal("0.01"))).cast("decimal(5,4)")


def places(value: Column, n: int) -> Column:
    """Text of a number with n decimal places, rounded half up."""
    return value.cast("decimal(28,8)").cast(f"decimal(28,{n})").cast("string")


def clean_sql(stats: str) -> tuple[str, str]:
    """(bp, pct) of a detector without labels."""
    raw = (
        f"1000L + least(2000L, {stats}.symbols * 200) + least(2000L, {stats}.chars * 5) + ({stats}.sum_raw % 11) * 100"
    )
    return f"((least(19000L, {raw}) + 5) div 10)", f"(88L + {stats}.sum_raw % 10)"


def weight_sql(labels: str, detector: fixed.Detector) -> str:
    """Largest label weight; labels without an own weight take the detector's default."""
    default = bp(detector.default_weight)
    if not detector.weights:
        return str(default)
    table = map_literal({k: bp(w) for k, w in detector.weights.items()})
    return f"array_max(transform({labels}, x -> coalesce(try_element_at({table}, x), {default})))"


def hit_sql(stats: str, labels: str, detector: fixed.Detector) -> tuple[str, str]:
    """(bp, pct) of a detector with labels, before fixed scores of very short payloads."""
    percent = f"(85L + least(8, size({labels}) * 2) + {stats}.sum_low % 7)"
    points = " + ".join(
        [
            f"{weight_sql(labels, detector)} * 6 div 10",
            str(bp(fixed.SEVERITY_VALUE[detector.severity]) * 4 // 10),
            f"least(400L, {stats}.symbols * 30)",
            f"least(400L, {stats}.chars)",
            percent,
            f"({stats}.sum_low % 100) * 2",
            f"least(600, (size({labels}) - 1) * 200)",
        ]
    )
    return f"(((greatest(0L, least(10000L, {points})) + 50) div 100) * 100)", percent


OVERRIDE_REACH = max(limit for _, limit, _, _ in fixed.SCORE_OVERRIDES)


def squash_if_short(text: Column, stats: Column) -> Column:
    """Squashed text where a fixed score is possible at all, else NULL: long texts are not rewritten."""
    return F.when(stats["solid"] < OVERRIDE_REACH, squash(text))


def override_exact(squashed: str, solid: str) -> Column:
    """STRUCT<bp, pct> of the fixed score of a very short payload, NULL where there is none.

    The first entry whose text occurs decides, even where the payload is too long for it: then there is none.
    """
    rows = []
    for texts, limit, score, confidence in fixed.SCORE_OVERRIDES:
        found = " OR ".join(f"contains({squashed}, {text_literal(t)})" for t in texts)
        value = f"named_struct('bp', {bp(score)}L, 'pct', {bp(confidence) // 100}L)"
        rows.append(f"WHEN {found} THEN CASE WHEN {solid} < {limit} THEN {value} END")
    return F.expr(f"CASE WHEN {squashed} IS NOT NULL THEN CASE {' '.join(rows)} END END")


def with_override(df: DataFrame, text: str, stats: str, name: str = "_fix") -> DataFrame:
    """Add the fixed score struct of a text; it is the same for every detector of that text."""
    return df.withColumn(f"{name}_squash", squash_if_short(F.col(text), F.col(stats))).withColumn(
        name, override_exact(f"{name}_squash", f"{stats}.solid")
    )


def score_detector(
    stats: str, labels: str, detector: fixed.Detector, fix: str, clean_is_zero: bool = False
) -> tuple[Column, Column]:
    """(bp, pct) from column names: an empty text or a scanner with nothing to report is 0 / 100."""
    clean = ("0L", "100L") if clean_is_zero else clean_sql(stats)
    hit = hit_sql(stats, labels, detector)
    return tuple(
        F.expr(
            f"CASE WHEN {stats}.chars = 0 THEN {nothing} WHEN size({labels}) > 0 THEN coalesce({fix}.{part}, {hit[n]}) "
            f"ELSE {clean[n]} END"
        )
        for n, (part, nothing) in enumerate((("bp", "0L"), ("pct", "100L")))
    )


def label_texts_sql(labels: str) -> str:
    """Distinct human texts of labels, in first-seen order; a keyword suffix after ``:`` is dropped."""
    name = "substring_index(x, ':', 1)"
    return (
        f"array_distinct(transform({labels}, x -> coalesce(try_element_at({map_literal(fixed.LABEL_TEXT)}, {name}), "
        f"concat('Signature match (', {name}, ')'))))"
    )


def explain(text: str, labels: str, detector: fixed.Detector) -> Column:
    """STRUCT of rule, tokens, evidence and reason of a detector that has labels; takes column names."""
    tokens, listed = matched_tokens(text), F.col(labels)
    return F.struct(
        F.try_element_at(listed, F.lit(1)).alias("matched_rule"),
        F.when(F.size(tokens) > 0, F.array_join(tokens, ", ")).otherwise("None").alias("matched_tokens"),
        F.array_join(listed, ", ").alias("evidence"),
        reason(labels, detector).alias("reason"),
    )


# Reason formats
EMPTY_REASON = "Empty prompt."
CLEAN_REASONS = {
    "sensitive": "No sensitive data elements detected.",
    "malware": "File magic bytes and signature checks scanned clean.",
    "sandbox": "File sandbox check clean.",
}


def reason(labels: str, detector: fixed.Detector) -> Column:
    """Reason text of a label column."""
    clean = CLEAN_REASONS.get(detector.key, f"No threat signatures triggered for {detector.title}.")
    start = text_literal(f"Detected {detector.title} indicators: ")
    return F.expr(
        f"CASE WHEN size({labels}) > 0 THEN concat({start}, array_join({label_texts_sql(labels)}, ', '), '.') "
        f"ELSE {text_literal(clean)} END"
    )
