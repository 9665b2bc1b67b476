"""Composite risk, verdict, and the screening of a table of prompts.

Screening is one narrow stage: every column of the result is computed from its own row, nothing is shuffled and
nothing is exploded.  Scores travel as whole ten-thousandths until the last projection.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.plan import pinned
from tidewall.functions.scoring import (
    EMPTY_REASON,
    as_confidence,
    as_score,
    bp,
    reason,
    score_detector,
    with_override,
)
from tidewall.functions.text import short_text_stats
from tidewall.operators.detect import with_labels, with_profile, with_text_forms
from tidewall.operators.files import byte_marks, file_caption, malware_labels, sandbox_labels, sandbox_text
from tidewall.operators.redact import choose_sanitized, redact

RESULT_TYPE = "struct<detector:string,score:decimal(5,4),confidence:decimal(5,4),matched:array<string>,reason:string>"
TRIGGERED_BP = 1000  # fixed value: a detector counts as triggered above 0.10


def _plus(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def composite_risk_bp(points: dict[str, Column], labels: dict[str, Column]) -> Column:
    """Composite risk in ten-thousandths from the scores and labels of any number of detectors.

    highest score + (1 - highest) * weighted mean * boost + 0.0002 per label of a triggered detector, in integers.
    """
    highest = F.greatest(*points.values())
    weight = {name: bp(fixed.RISK_WEIGHTS.get(name, fixed.OTHER_RISK_WEIGHT)) // 100 for name in points}
    total = sum(weight.values())
    weighted = _plus([points[n] * weight[n] for n in points])  # 1e-6
    triggered = _plus([(points[n] > TRIGGERED_BP).cast("long") for n in points])
    found = _plus([F.when(points[n] > TRIGGERED_BP, F.size(labels[n]).cast("long")).otherwise(0) for n in points])
    boost = F.when(triggered > 0, F.lit(20)).otherwise(18)
    # (1e4 - highest) * weighted * boost / total: at most 1e4 * 1e6 * 20, exact in a long
    extra = (F.lit(10000) - highest) * weighted * boost
    scaled = highest * (total * 10000 * 100) + extra + (found % 100) * 2 * (total * 10000 * 100)
    unit = total * 10000 * 100
    rounded = F.expr("0").cast("long") + F.floor((scaled + unit // 2) / F.lit(unit)).cast("long")
    return F.when(highest > 0, F.least(F.lit(10000).cast("long"), rounded)).otherwise(F.lit(0).cast("long"))


def _by_threshold(risk_bp: Column, which: int) -> Column:
    chain = None
    for row in fixed.VERDICTS[:-1]:
        test = risk_bp >= bp(row[0])
        chain = F.when(test, F.lit(row[which])) if chain is None else chain.when(test, F.lit(row[which]))
    return chain.otherwise(F.lit(fixed.VERDICTS[-1][which]))


def verdict(risk_bp: Column) -> tuple[Column, Column, Column]:
    """(policy action, severity, reasoning text) of a composite risk."""
    shown = as_score(risk_bp).cast("decimal(5,2)").cast("string")
    return _by_threshold(risk_bp, 1), _by_threshold(risk_bp, 2), F.replace(_by_threshold(risk_bp, 3), F.lit("%s"), shown)


def findings(points: dict[str, Column], labels: dict[str, Column]) -> Column:
    """Distinct labels of all triggered detectors, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(
        F.array_distinct(F.concat(*[F.when(points[n] > TRIGGERED_BP, labels[n]).otherwise(none) for n in points]))
    )


def scan_content(df: DataFrame, prompt: str = "prompt", file_name: str | None = None, extracted: str | None = None) -> Column:
    """What the text detectors read: the prompt, followed by the text of an attachment where it has any."""
    text = F.coalesce(F.col(prompt), F.lit(""))
    if extracted is None:
        return text
    name = F.coalesce(F.nullif(F.col(file_name), F.lit("")), F.lit("document"))
    return F.when(
        F.length(F.coalesce(F.col(extracted), F.lit(""))) > 0,
        F.concat(text, F.lit("\n\n[Attached File: "), name, F.lit("]\n"), F.col(extracted)),
    ).otherwise(text)


def with_scores(
    df: DataFrame,
    prompt: str = "prompt",
    content: str | None = None,
    file_name: str | None = None,
    extracted: str | None = None,
    extra: tuple = (),
) -> DataFrame:
    """Screen a prompt column (and attachments), adding per detector `labels_*`, `bp_*`, `pct_*`, and
    `scanned` (the text that was read) and `masked` (that text with personal data and secrets masked).

    ``content`` names a BINARY column, ``extracted`` a text column with the text of formats that need a parser.
    ``extra`` holds registered detectors, see `tidewall.operators.registry`.
    """
    keep = df.columns
    out = df
    if content is not None:
        out = out.withColumn("_file_text", sandbox_text(content, file_name, extracted))
    out = out.withColumn(
        "scanned", scan_content(out, prompt, file_name, "_file_text" if content is not None else None)
    )
    out = with_profile(out, "scanned")
    out = with_override(out, "scanned", "_profile")
    out = with_labels(with_text_forms(out, "scanned"), "scanned")
    out = redact(out, "scanned").withColumnsRenamed({"sanitized": "masked", "entities": "labels_sensitive"})
    none = F.array().cast("array<string>")
    if content is not None:
        out = out.withColumn("_marks", pinned(byte_marks(content)))
        out = out.withColumns(
            {
                "labels_malware": malware_labels(content, file_name, "_marks"),
                "labels_sandbox": sandbox_labels(content, file_name, "_marks"),
            }
        )
        for key, unnamed in (("malware", "unnamed"), ("sandbox", "document")):
            found = F.size(f"labels_{key}") > 0
            # captions are short; clean files need no statistics at all
            out = out.withColumn(f"_caption_{key}", F.when(found, file_caption(content, file_name, unnamed)))
            out = out.withColumn(f"_stats_{key}", F.when(found, short_text_stats(f"_caption_{key}")))
            out = with_override(out, f"_caption_{key}", f"_stats_{key}", f"_fix_{key}")
    else:
        out = out.withColumns({"labels_malware": none, "labels_sandbox": none})
    for detector in extra:
        out = out.withColumn(f"labels_{detector.rules.key}", detector.labels(F.col("scanned")))

    scored: dict[str, Column] = {}
    for d in fixed.DETECTORS + tuple(e.rules for e in extra):
        labels = f"labels_{d.key}"
        if d in (fixed.MALWARE, fixed.SANDBOX):
            if content is None:
                points, percent = F.lit(0).cast("long"), F.lit(100).cast("long")
            else:
                points, percent = score_detector(
                    f"_stats_{d.key}", labels, d, f"_fix_{d.key}", clean_is_zero=True
                )
                nothing = F.size(labels) == 0
                points, percent = F.when(nothing, F.lit(0)).otherwise(points), F.when(nothing, F.lit(100)).otherwise(percent)
        else:
            points, percent = score_detector(
                "_profile", labels, d, "_fix", clean_is_zero=d is fixed.SENSITIVE
            )
        scored[f"bp_{d.key}"], scored[f"pct_{d.key}"] = points.cast("long"), percent.cast("long")
    out = out.withColumns(scored)
    detectors = fixed.DETECTORS + tuple(e.rules for e in extra)
    return out.select(
        *keep, "scanned", "masked",
        *[pinned(c).alias(c) for d in detectors for c in (f"labels_{d.key}", f"bp_{d.key}", f"pct_{d.key}")],
    )


def screen(
    df: DataFrame,
    prompt: str = "prompt",
    content: str | None = None,
    file_name: str | None = None,
    extracted: str | None = None,
    extra: tuple = (),
    keep_text: bool = False,
) -> DataFrame:
    """Screen prompts: adds `risk`, `action`, `severity`, `reasoning`, `findings`, `sanitized_input` and `results`
    (one struct per detector).  Columns nobody reads are pruned by the optimizer together with what feeds them.
    """
    keep = df.columns
    detectors = fixed.DETECTORS + tuple(e.rules for e in extra)
    out = with_scores(df, prompt, content, file_name, extracted, extra)
    points = {d.display: F.col(f"bp_{d.key}") for d in detectors}
    labels = {d.display: F.col(f"labels_{d.key}") for d in detectors}
    out = out.withColumn("_risk", composite_risk_bp(points, labels))
    action, severity, reasoning = verdict(F.col("_risk"))
    out = out.withColumn("action", action)
    empty = F.length("scanned") == 0
    results = F.array(
        *[
            F.struct(
                F.lit(d.display).alias("detector"),
                as_score(F.col(f"bp_{d.key}")).alias("score"),
                as_confidence(F.col(f"pct_{d.key}")).alias("confidence"),
                F.col(f"labels_{d.key}").alias("matched"),
                (
                    reason(f"labels_{d.key}", d)
                    if d in (fixed.MALWARE, fixed.SANDBOX)
                    else F.when(empty, F.lit(EMPTY_REASON)).otherwise(reason(f"labels_{d.key}", d))
                ).alias("reason"),
            )
            for d in detectors
        ]
    )
    return out.select(
        *keep,
        *(["scanned", "masked"] if keep_text else []),
        pinned(as_score(F.col("_risk"))).alias("risk"),
        pinned("action").alias("action"),
        pinned(severity).alias("severity"),
        pinned(reasoning).alias("reasoning"),
        pinned(findings(points, labels)).alias("findings"),
        pinned(
            choose_sanitized(F.col("action"), as_score(F.col("bp_sensitive")), F.col("masked"), F.col("scanned"))
        ).alias("sanitized_input"),
        pinned(results).alias("results"),
    )


def detector_details(screened: DataFrame, key: str) -> DataFrame:
    """Long table: one row per prompt and detector."""
    return screened.select(key, F.inline("results")).select(
        key,
        F.col("detector").alias("detector_name"),
        "score",
        "confidence",
        F.when(F.size("matched") > 0, F.array_join("matched", ", ")).otherwise("None").alias("matched_evidence"),
        F.col("reason").alias("explanation"),
    )


def event_severity(score: Column) -> Column:
    chain = None
    for above, name in fixed.EVENT_SEVERITIES:
        test = score > F.lit(Decimal(above))
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(F.lit("LOW"))


def _named(table: dict[str, object], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), name)


_EVENT_SOURCE = {display: source for display, source, _ in fixed.EVENT_TYPES}
_EVENT_TYPE = {display: f"{kind} ({display})" for display, _, kind in fixed.EVENT_TYPES}
_EVENT_POSITION = {display: n for n, (display, _, _) in enumerate(fixed.EVENT_TYPES)}
DETAILS_TYPE = "struct<score:decimal(5,4),confidence:decimal(5,4),reason:string,matched:array<string>>"


def security_events(screened: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per triggered detector."""
    row = screened.select(key, ts, F.inline("results")).filter(F.col("score") > F.lit(Decimal("0.10")))
    return row.select(
        F.col(key).alias("log_id"),
        F.col(ts).alias("ts"),
        F.coalesce(_named(_EVENT_POSITION, F.col("detector")), F.lit(len(_EVENT_POSITION))).alias("position"),
        F.coalesce(_named(_EVENT_SOURCE, F.col("detector")), F.lit("INJECTION")).alias("agent_source"),
        F.coalesce(_named(_EVENT_TYPE, F.col("detector")), F.col("detector")).alias("trigger_type"),
        event_severity(F.col("score")).alias("severity_level"),
        F.struct("score", "confidence", "reason", "matched").alias("details"),
    )


def policy_events(screened: DataFrame, key: str, ts: str) -> DataFrame:
    """One extra row per prompt that was not simply allowed."""
    source, kind = fixed.POLICY_EVENT
    return screened.filter(F.col("action") != "ALLOW").select(
        F.col(key).alias("log_id"),
        F.col(ts).alias("ts"),
        F.lit(len(fixed.EVENT_TYPES) + 1).alias("position"),
        F.lit(source).alias("agent_source"),
        F.lit(kind).alias("trigger_type"),
        F.col("severity").alias("severity_level"),
        F.struct(
            F.lit(None).cast("decimal(5,4)").alias("score"),
            F.lit(None).cast("decimal(5,4)").alias("confidence"),
            F.col("reasoning").alias("reason"),
            F.col("findings").alias("matched"),
        ).alias("details"),
    )


def all_events(screened: DataFrame, key: str, ts: str) -> DataFrame:
    """Detector and policy events in one pass over the screened rows.

    The union of `security_events` and `policy_events` would screen every prompt twice; here the policy row is one
    more element of the array that is unrolled.
    """
    return screened.select(F.col(key).alias("log_id"), F.col(ts).alias("ts"), F.inline(event_array()))


def event_array() -> Column:
    """The events of a screened row as an array of structs (`position`, `agent_source`, ..., `details`)."""
    source, kind = fixed.POLICY_EVENT
    none = F.lit(None).cast("decimal(5,4)")
    policy = F.when(
        F.col("action") != "ALLOW",
        F.array(
            F.struct(
                F.lit(kind).alias("detector"), none.alias("score"), none.alias("confidence"),
                F.col("findings").alias("matched"), F.col("reasoning").alias("reason"),
            )
        ),
    ).otherwise(F.array().cast(f"array<{RESULT_TYPE}>"))
    raised = F.filter(F.col("results"), lambda r: r["score"] > F.lit(Decimal("0.10")))

    def event(r: Column) -> Column:
        is_policy, detector = r["score"].isNull(), r["detector"]
        return F.struct(
            F.when(is_policy, F.lit(len(fixed.EVENT_TYPES) + 1))
            .otherwise(F.coalesce(_named(_EVENT_POSITION, detector), F.lit(len(_EVENT_POSITION))))
            .alias("position"),
            F.when(is_policy, F.lit(source)).otherwise(F.coalesce(_named(_EVENT_SOURCE, detector), F.lit("INJECTION"))).alias("agent_source"),
            F.when(is_policy, F.lit(kind)).otherwise(F.coalesce(_named(_EVENT_TYPE, detector), detector)).alias("trigger_type"),
            F.when(is_policy, F.col("severity")).otherwise(event_severity(r["score"])).alias("severity_level"),
            F.struct(*(r[c].alias(c) for c in ("score", "confidence", "reason", "matched"))).alias("details"),
        )

    return F.transform(F.concat(raised, policy), event)


def review_tickets(screened: DataFrame, key: str, ts: str) -> DataFrame:
    """One pending ticket per held prompt."""
    return screened.filter(F.col("action") == "HUMAN_REVIEW").select(
        F.col(key).alias("approval_id"),
        F.col(key).alias("log_id"),
        F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("reviewer_id"),
        F.lit(None).cast("string").alias("review_notes"),
        F.col(ts).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
    )


def triggered_summary(screened: DataFrame, key: str) -> DataFrame:
    """Per prompt, the detectors above 0.30 with index, confidence and evidence."""
    strong = F.filter(F.col("results"), lambda r: r["score"] > F.lit(Decimal("0.30")))
    lines = F.transform(
        strong,
        lambda r: F.concat(
            r["detector"], F.lit(" (Threat Index: "), r["score"].cast("decimal(5,2)").cast("string"),
            F.lit(", Confidence: "), (r["confidence"] * 100).cast("int").cast("string"), F.lit("%) Evidence: "),
            F.when(F.size(r["matched"]) > 0, F.array_join(r["matched"], ", ")).otherwise("None"),
        ),
    )
    return screened.select(
        key,
        F.size(strong).cast("long").alias("n_triggered"),
        F.when(F.size(strong) > 0, F.array_join(lines, "\n"))
        .otherwise("All security modules scanned clean. No threat indicators triggered.")
        .alias("summary"),
    )


def routing(screened: DataFrame, key: str, prompt: str) -> DataFrame:
    """Where a prompt goes next and with which text."""
    act = F.col("action")
    return screened.select(
        key,
        F.when(act.isin("ALLOW", "ALLOW_WITH_WARNING", "REDACTED"), F.lit("FORWARD"))
        .when(act == "BLOCK", F.lit("INTERCEPT"))
        .otherwise("HOLD")
        .alias("route"),
        F.when(act.isin("ALLOW", "ALLOW_WITH_WARNING"), F.coalesce(F.col(prompt), F.lit("")))
        .when(act == "REDACTED", F.col("sanitized_input"))
        .alias("outbound_text"),
        F.when(act == "BLOCK", F.lit(fixed.INTERCEPTED_TEXT)).alias("notice"),
    )


# Display bands, (limit, label) from the top; gauge and badge include their limit, the feed does not
GAUGE_BANDS = (("0.75", "CRITICAL"), ("0.35", "MODERATE"))
GAUGE_REST = "SECURE"
BADGE_LIMITS = ("0.75", "0.30")
FEED_LIMITS = ("0.75", "0.40")


def risk_band(score: Column, kind: str = "gauge") -> Column:
    """Display band of a score: gauge, badge (per detector) or feed."""
    if kind == "gauge":
        (top, a), (mid, b), rest = *GAUGE_BANDS, GAUGE_REST
    else:
        (top, mid), (a, b, rest) = {"badge": BADGE_LIMITS, "feed": FEED_LIMITS}[kind], ("negative", "warning", "positive")
    top, mid = F.lit(Decimal(top)), F.lit(Decimal(mid))
    if kind == "feed":
        return F.when(score > top, a).when(score > mid, b).otherwise(rest)
    return F.when(score >= top, a).when(score >= mid, b).otherwise(rest)
