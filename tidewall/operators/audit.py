"""Audit log, review queue and report queries.

Tables: logs(log_id, session_id, ts, raw_input, sanitized_input, risk, action), events(log_id, ts, position,
agent_source, trigger_type, severity_level, details), tickets(approval_id, log_id, status, reviewer_id, review_notes,
created_at, reviewed_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.scoring import places
from tidewall.functions.text import preview, short_hash

# Labels and texts
NO_REVIEW = "N/A (Auto)"
HELD_TEXT = "Transaction held by gateway policy for manual review."


def search_logs(
    logs: DataFrame, session_id: str | None = None, action: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """Newest first, with optional equality filters."""
    out = logs
    if session_id:
        out = out.filter(F.col("session_id") == session_id)
    if action:
        out = out.filter(F.col("action") == action)
    return out.orderBy(F.col("ts").desc(), F.col("log_id")).offset(offset).limit(limit)


def get_log(logs: DataFrame, log_id) -> DataFrame:
    return logs.filter(F.col("log_id") == log_id)


#: Decisions of one ticket from which on they are dealt out, and among how many.
HOT_TICKET = 10_000
SALTS = 16
EVENT_FIELDS = ("position", "agent_source", "trigger_type", "severity_level", "details")
TICKET_FIELDS = ("approval_id", "status", "reviewer_id", "review_notes", "created_at", "reviewed_at")


def _children(rows: DataFrame, fields: tuple[str, ...], name: str) -> DataFrame:
    return rows.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def logs_with_children(logs: DataFrame, events: DataFrame, tickets: DataFrame) -> DataFrame:
    """Logs with their events and tickets nested; a log has at most one event per detector and one policy event, so
    the lists are short.  Logs without children keep empty lists."""
    e, t = _children(events, EVENT_FIELDS, "events"), _children(tickets, TICKET_FIELDS, "approvals")
    out = logs.join(e, "log_id", "left").join(t, "log_id", "left")
    return out.withColumn("events", F.coalesce("events", F.array().cast(e.schema["events"].dataType))).withColumn(
        "approvals", F.coalesce("approvals", F.array().cast(t.schema["approvals"].dataType))
    )


def feed(
    logs: DataFrame,
    events: DataFrame,
    tickets: DataFrame,
    date=None,
    action: str = "ALL",
    detector: str | None = None,
    min_risk: float = 0.0,
    user: str = "",
    text: str = "",
    limit: int = 15,
) -> DataFrame:
    """The newest logs that pass all filters, with their events and tickets nested.

    Logs are filtered and the newest taken before anything is nested; what is asked of events is answered by the log
    ids of matching events.
    """
    out = logs
    if date is not None:
        day = F.lit(date).cast("date")
        out = out.filter((F.col("ts") >= day) & (F.col("ts") < F.date_add(day, 1)))
    if action != "ALL":
        out = out.filter(F.col("action") == action)
    if min_risk > 0:
        out = out.filter(F.col("risk") >= min_risk)
    if user:
        out = out.filter(F.contains(F.lower("session_id"), F.lit(user.lower())))
    if detector:
        named = F.contains("trigger_type", F.lit(detector)) | (F.col("agent_source") == detector)
        out = out.join(events.filter(named).select("log_id"), "log_id", "left_semi")
    if text:
        needle = F.lit(text.lower())
        described = F.contains(F.lower(F.concat_ws(" ", "agent_source", "trigger_type")), needle)
        marked = events.filter(described).groupBy("log_id").agg(F.lit(True).alias("_described"))
        out = out.join(marked, "log_id", "left").filter(
            F.contains(F.lower("raw_input"), needle) | F.contains(F.lower("session_id"), needle) | F.coalesce("_described", F.lit(False))
        ).drop("_described")
    out = out.select(*logs.columns).orderBy(F.col("ts").desc(), F.col("log_id")).limit(limit)
    ids = out.select("log_id")
    own_events, own_tickets = (rows.join(ids, "log_id", "left_semi") for rows in (events, tickets))
    return logs_with_children(out, own_events, own_tickets).orderBy(F.col("ts").desc(), F.col("log_id"))


def transaction_id(ts: Column | str) -> Column:
    return F.concat(F.lit("TX-"), F.date_format(ts, "yyyyMMdd-HHmmss"))


def _joined(values: Column) -> Column:
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) > 0, F.array_join(distinct, ", ")).otherwise("None")


def feed_columns(nested: DataFrame) -> DataFrame:
    """Display row of each nested log."""
    return nested.select(
        "log_id",
        transaction_id("ts").alias("tx_id"),
        short_hash("raw_input").alias("prompt_hash"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("time"),
        F.col("action").alias("verdict"),
        F.col("risk").alias("risk"),
        _joined(F.col("events.agent_source")).alias("sources"),
        _joined(F.flatten(F.transform("events", lambda e: F.coalesce(e["details"]["matched"], F.array().cast("array<string>"))))).alias("evidence"),
        F.coalesce(F.try_element_at(F.col("approvals.status"), F.lit(1)), F.lit(NO_REVIEW)).alias("analyst_action"),
        F.col("session_id").alias("user"),
        preview("raw_input").alias("preview"),
    )


def pending_queue(tickets: DataFrame) -> DataFrame:
    """Pending tickets, oldest first."""
    return tickets.filter(F.col("status") == "PENDING").orderBy("created_at", "approval_id")


def _valid(decisions: DataFrame) -> Column:
    return F.upper("status").isin("APPROVED", "REJECTED") & F.length("reviewer_id").between(1, 100)


def apply_decisions(tickets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tickets after their first valid decision.

    decisions: decision_id, approval_id, status, reviewer_id, review_notes, ts.  The first decision is a minimum, so
    it is combined before the shuffle and a ticket with very many decisions is no hot group.
    """
    first = (
        decisions.filter(_valid(decisions))
        .groupBy("approval_id")
        .agg(F.min(F.struct("ts", "decision_id", F.upper("status").alias("status"), "reviewer_id", "review_notes")).alias("d"))
    )
    pending = F.col("status") == "PENDING"
    decided = pending & F.col("d").isNotNull()
    out = tickets.join(first, "approval_id", "left")
    return out.select(
        "approval_id", "log_id",
        F.when(decided, F.col("d.status")).otherwise(F.col("status")).alias("status"),
        F.when(decided, F.col("d.reviewer_id")).otherwise(F.col("reviewer_id")).alias("reviewer_id"),
        F.when(decided, F.col("d.review_notes")).otherwise(F.col("review_notes")).alias("review_notes"),
        "created_at",
        F.when(decided, F.col("d.ts")).otherwise(F.col("reviewed_at")).alias("reviewed_at"),
    )


def rejected_decisions(tickets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that change nothing, with the reason: bad input, unknown ticket, or ticket already decided.

    A decision that repeats the winner's time, id and status is the winner delivered again; one that only has its id is not.
    """
    valid = F.coalesce(_valid(decisions), F.lit(False))
    first = decisions.groupBy("approval_id").agg(
        F.min(F.when(valid, F.struct("ts", "decision_id", F.upper("status").alias("status")))).alias("d"), F.count(F.lit(1)).alias("_n")
    )
    pending = F.col("status") == "PENDING"
    hot = F.coalesce(F.col("_n") > HOT_TICKET, F.lit(False))
    known = tickets.select("approval_id", "status").join(first, "approval_id").select(
        "approval_id",
        F.when(pending, F.col("d")).alias("_winner"),
        F.when(pending, F.col("d.status")).otherwise(F.col("status")).alias("_verdict"),
        F.lit(True).alias("_known"),
        # a ticket with very many decisions stands under several salts, and its decisions are dealt out among them
        F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"),
    )
    crowded = first.where(F.col("_n") > HOT_TICKET).select("approval_id", F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("decision_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    mark = F.struct("ts", "decision_id", F.upper("status").alias("status"))
    checked = decisions.select("decision_id", "approval_id", valid.alias("_valid"), mark.alias("_mark")).join(crowded, "approval_id", "left")
    checked = checked.withColumn("_salt", salt).join(known, ["approval_id", "_salt"], "left")
    processed = F.concat(F.lit(fixed.PROCESSED[0]), F.col("_verdict"), F.lit(fixed.PROCESSED[1]))
    error = (
        F.when(~F.col("_valid"), F.lit(fixed.BAD_DECISION))
        .when(F.col("_known").isNull(), F.lit(fixed.NO_TICKET))
        .when(F.col("_winner").isNull() | ~F.col("_mark").eqNullSafe(F.col("_winner")), processed)
    )
    return checked.select("decision_id", "approval_id", error.alias("error")).filter(F.col("error").isNotNull())


def sync_verdict(logs: DataFrame, tickets: DataFrame) -> DataFrame:
    """Logs with the verdict of their decided ticket; of several the one that was decided (else created) last."""
    at = [F.col(c) for c in ("reviewed_at", "created_at", "approval_id") if c in tickets.columns]
    verdict = F.when(F.col("status") == "APPROVED", F.lit("ALLOW")).otherwise("BLOCK")
    latest = F.max(F.struct(*at, verdict.alias("_final")))
    decided = tickets.filter(F.col("status").isin("APPROVED", "REJECTED")).groupBy("log_id").agg(latest.alias("_l"))
    decided = decided.select("log_id", F.col("_l._final").alias("_final"))
    return logs.join(decided, "log_id", "left").withColumn("action", F.coalesce("_final", "action")).drop("_final")


def primary_events(events: DataFrame) -> DataFrame:
    """One event per log: the first HIGH or CRITICAL one, else the first.  A minimum, not a window: it is combined
    before the shuffle."""
    rank = F.struct(
        F.when(F.col("severity_level").isin("CRITICAL", "HIGH"), 0).otherwise(1).alias("low"), F.col("position")
    )
    return events.groupBy("log_id").agg(
        F.min_by(F.struct("trigger_type", "agent_source", "severity_level", "details"), rank).alias("primary")
    )


def ticket_view(tickets: DataFrame, logs: DataFrame, events: DataFrame) -> DataFrame:
    """Review console rows: ticket, its log, and the primary event.  Only events of logs with a ticket are ranked."""
    events = events.join(tickets.select("log_id"), "log_id", "left_semi")
    out = tickets.join(logs.select("log_id", "session_id", "risk"), "log_id", "left").join(
        primary_events(events), "log_id", "left"
    )
    p, has = F.col("primary"), F.col("primary").isNotNull()
    return out.select(
        "approval_id", "log_id", "status",
        transaction_id("created_at").alias("tx_id"),
        F.coalesce("session_id", F.lit("Unknown User")).alias("user"),
        F.coalesce("risk", F.lit(0.0)).alias("composite_risk"),
        F.when(has, F.coalesce(p["trigger_type"], F.lit("Violation Triggered"))).otherwise("Verification Hold").alias("threat_type"),
        F.when(has, F.coalesce(p["agent_source"], F.lit("Gateway Interceptor"))).otherwise("N/A").alias("detector"),
        F.when(has, F.coalesce(p["details"]["confidence"].cast("double"), F.lit(0.92))).otherwise(0.90).alias("confidence"),
        F.regexp_replace(
            F.when(has, F.coalesce(p["details"]["reason"], F.lit("Anomalous patterns flagged."))).otherwise(HELD_TEXT),
            "<[^>]*>", " ",
        ).alias("reason"),
    )


def cascade_delete(logs: DataFrame, events: DataFrame, tickets: DataFrame, doomed: DataFrame):
    """(logs, events, tickets) without the given log ids."""
    ids = doomed.select("log_id").distinct()
    return tuple(t.join(ids, "log_id", "left_anti") for t in (logs, events, tickets))


def registry_table(logs: DataFrame) -> DataFrame:
    return logs.select(
        "log_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("timestamp"),
        F.col("action").alias("verdict"),
        places(F.col("risk"), 3).alias("risk_score"),
        "session_id",
    )


def report_text(session: Column, action: Column, risk: Column, reasoning: Column, findings: Column) -> Column:
    """The text a compliance report is judged by."""
    found = F.when(F.size(findings) > 0, F.array_join(findings, ", ")).otherwise("None")
    return F.concat(
        F.lit("\nSession ID: "), session, F.lit("\nFinal Action: "), action, F.lit("\nComposite Risk Score: "),
        risk.cast("double").cast("string"), F.lit("\nThreat Explanation: "), reasoning,
        F.lit("\nFindings Checklist: "), found, F.lit("\n        "),
    )


def compliance_report(df: DataFrame, text: str) -> DataFrame:
    """Compliance flags of a report text: it fails where the text itself says block or human_review."""
    lowered = F.lower(F.col(text))
    blocked, held = F.contains(lowered, F.lit("block")), F.contains(lowered, F.lit("human_review"))
    passed = ~(blocked | held)
    return df.withColumns(
        {
            "compliance_passed": passed,
            "status_label": F.when(blocked, "BLOCKED").when(held, "HELD FOR REVIEW").otherwise("APPROVED"),
            "alert_triggered": blocked | held | F.contains(lowered, F.lit("pii")),
            "safe_execution": passed,
        }
    )
