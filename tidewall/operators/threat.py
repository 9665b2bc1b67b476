"""Rule classifier: threat type, severity and risk of a text, and the override by a signature match."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.plan import pinned
from tidewall.functions.scoring import places
from tidewall.operators.detect import GATES, hit_sql, seen, seen_sql, with_text_forms

# necessary literals of the classifier's own patterns, as in `detect.GATES`
_CLASSIFIER_GATES = {
    "REVERSE_SHELL_PAYLOAD": GATES["REVERSE_SHELL_PAYLOAD"][:10],
    "COMMAND_INJECTION_TRIGGER": ((("-",),), (("sudo",),)) + GATES["COMMAND_INJECTION_TRIGGER"],
    "SQL_INJECTION": (
        (("union",), ("select",)),
        (("select",), ("users",)),
        (("=",), ("'",)),
        (("=",), ('"',)),
    ),
}


def _hit_count(finding: str, patterns: tuple[str, ...], literals: tuple[str, ...], gates) -> Column:
    """How often a group reports: once per pattern, or once if any literal occurs."""
    if literals:
        return seen("lower", literals).cast("int")
    # the statement group is matched on lower-cased text as it is, the others ignore case
    mode = "lower_raw" if finding == "SQL_INJECTION" else "any"
    hits = [hit_sql(p, groups, mode, "") for p, groups in zip(patterns, gates[finding], strict=True)]
    if finding == "REVERSE_SHELL_PAYLOAD":
        literal = seen_sql("lower", (fixed.REVERSE_SHELL_LITERAL,))
        hits = [f"({literal} OR {h})" for h in hits]
    return F.expr(" + ".join(f"cast(coalesce({h}, false) AS int)" for h in hits))


def classify_threat(df: DataFrame, text: str) -> DataFrame:
    """Add `threat`: STRUCT<is_injection, risk_score, threat_type, severity, findings, explanation>.

    Groups are read in order.  A group that always replaces the type wins over all before it; the others only replace
    the types they name.
    """
    keep = df.columns
    out = with_text_forms(df, text, _CLASSIFIER_GATES)
    for n, (finding, patterns, literals, *_rest) in enumerate(fixed.CLASSIFIER):
        out = out.withColumn(f"_n{n}", _hit_count(finding, patterns, literals, _CLASSIFIER_GATES))
    start_risk, start_type, start_severity = fixed.CLASSIFIER_START
    risk = [F.lit(Decimal(start_risk)).cast("decimal(3,2)")]
    kind, severity, found = F.lit(start_type), F.lit(start_severity), []
    for n, (finding, _p, _l, group_risk, group_kind, group_severity, replaces) in enumerate(fixed.CLASSIFIER):
        out = out.withColumn(f"_k{n}", kind).withColumn(f"_s{n}", severity)
        hit = F.col(f"_n{n}") > 0
        takes = hit & F.col(f"_k{n}").isin(*replaces) if replaces else hit
        kind = F.when(takes, F.lit(group_kind)).otherwise(F.col(f"_k{n}"))
        severity = F.when(takes, F.lit(group_severity)).otherwise(F.col(f"_s{n}"))
        risk.append(F.when(hit, F.lit(Decimal(group_risk)).cast("decimal(3,2)")))
        found.append(F.array_repeat(F.lit(finding), F.col(f"_n{n}")))
    out = out.withColumn("_found", F.concat(*found))
    before, after = fixed.CLASSIFIER_TEXT.split("%s")
    listed = F.when(F.size("_found") > 0, F.array_join("_found", ", ")).otherwise("None")
    return out.select(
        *keep,
        pinned(F.struct(
            (F.size("_found") > 0).alias("is_injection"),
            F.greatest(*risk).alias("risk_score"),
            kind.alias("threat_type"),
            severity.alias("severity"),
            F.col("_found").alias("findings"),
            F.concat(F.lit(before), listed, F.lit(after)).alias("explanation"),
        )).alias("threat"),
    )


def hybrid_override(df: DataFrame, threat: str = "threat", similarity: str = "similarity", pattern: str = "pattern") -> DataFrame:
    """Raise `threat` where a signature is more similar than the limit; adds the match to the struct."""
    limit, least_risk, severity, kind, finding = fixed.VECTOR_OVERRIDE
    t, close = F.col(threat), F.coalesce(F.col(similarity) > float(limit), F.lit(False))
    before, after = fixed.VECTOR_TEXT.split("%s")
    return df.withColumn(
        threat,
        F.struct(
            (t["is_injection"] | close).alias("is_injection"),
            F.when(close, F.greatest(t["risk_score"], F.lit(Decimal(least_risk)).cast("decimal(3,2)")))
            .otherwise(t["risk_score"])
            .alias("risk_score"),
            F.when(close, F.lit(kind)).otherwise(t["threat_type"]).alias("threat_type"),
            F.when(close, F.lit(severity)).otherwise(t["severity"]).alias("severity"),
            F.when(close, F.concat(t["findings"], F.array(F.lit(finding)))).otherwise(t["findings"]).alias("findings"),
            F.when(
                close,
                F.concat(F.lit(before), places(F.col(similarity), 4), F.lit(after), t["explanation"]),
            )
            .otherwise(t["explanation"])
            .alias("explanation"),
            F.when(close, F.col(similarity)).alias("pattern_match_distance"),
            F.when(close, F.col(pattern)).alias("matched_pattern"),
        ),
    )
