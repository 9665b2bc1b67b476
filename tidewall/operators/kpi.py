"""Key figures, trends and distributions over logs and events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewall.functions.scoring import places


def parse_ts(text: Column | str) -> tuple[Column, Column]:
    """(wall-clock timestamp, parsed flag) of ISO text with an optional Z; bad text gives NULL and a false flag.

    The time is the one the text shows, whatever the session's time zone.
    """
    t = F.col(text) if isinstance(text, str) else text
    value = F.regexp_replace(t, "Z$", "").try_cast("timestamp_ntz")
    return value, value.isNotNull()


def flatten_events(nested: DataFrame) -> DataFrame:
    """One row per event of nested logs, with defaults for missing parts."""
    return nested.select("log_id", "ts", F.explode("events").alias("e")).select(
        "log_id", "ts",
        F.coalesce("e.agent_source", F.lit("UNKNOWN")).alias("agent_source"),
        F.coalesce("e.severity_level", F.lit("INFO")).alias("severity"),
        F.coalesce("e.trigger_type", F.lit("")).alias("trigger_type"),
    )


SOURCES = ("INJECTION", "PII", "FILE")


def _facts(logs: DataFrame, events: DataFrame, early_log: Column | None = None, early_event: Column | None = None) -> DataFrame:
    """Logs and events as one relation of small facts, so that all figures come from one aggregate and no join."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    logs = logs.select(
        (early_log if early_log is not None else F.lit(True)).alias("early"),
        one.alias("request"),
        (F.col("action") == "BLOCK").cast("long").alias("block"),
        F.col("risk").cast("double").alias("risk"),
        *[zero.alias(s) for s in SOURCES],
    )
    events = events.select(
        (early_event if early_event is not None else F.lit(True)).alias("early"),
        zero.alias("request"), zero.alias("block"), F.lit(None).cast("double").alias("risk"),
        *[(F.col("agent_source") == s).cast("long").alias(s) for s in SOURCES],
    )
    return logs.unionByName(events)


def kpi_totals(logs: DataFrame, events: DataFrame) -> DataFrame:
    return _facts(logs, events).agg(
        F.coalesce(F.sum("request"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.sum("block"), F.lit(0)).alias("blocked"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"{s.lower()}_events") for s in SOURCES],
        F.coalesce(F.avg("risk"), F.lit(0.0)).alias("avg_risk"),
    )


def kth_smallest(df: DataFrame, key: Column, k: int, buckets: int = 4096) -> int | None:
    """Exact k-th smallest (from 0) of a whole-number column, by narrowing histograms.

    Each pass counts rows per bucket of the remaining range and keeps the bucket that holds rank k: a few scans that
    return at most ``buckets`` counts each, instead of a sort of everything through one task.
    """
    values = df.select(key.cast("long").alias("v")).filter("v IS NOT NULL")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if n is None or k >= n:
        return None
    while low < high:
        width = max(1, -(-(high - low + 1) // buckets))
        counts = (
            values.filter(F.col("v").between(low, high))
            .groupBy(F.floor((F.col("v") - low) / F.lit(width)).cast("long").alias("b"))
            .count()
            .orderBy("b")
            .collect()
        )
        for bucket, rows in counts:
            if k < rows:
                low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
                break
            k -= rows
    return low


def _pct(now: Column, before: Column) -> Column:
    change = (now - before) / before * 100
    shown = places(change, 1)
    return F.when(
        before == 0, F.when(now > 0, F.concat(F.lit("+"), now.cast("string"), F.lit(" pts"))).otherwise("Stable")
    ).otherwise(F.concat(F.when(change >= 0, "+").otherwise(""), shown, F.lit("%")))


def trend_label(now: Column, before: Column, more: str, less: str) -> Column:
    return F.when(now == before, "neutral").when(now > before, F.lit(more)).otherwise(F.lit(less))


# Fixed values: (figure, word for more, word for less)
TRENDS = (
    ("total_requests", "request", "positive", "negative"),
    ("blocked", "block", "warning", "positive"),
    ("injection_events", "INJECTION", "warning", "positive"),
    ("pii_events", "PII", "positive", "positive"),
    ("file_events", "FILE", "warning", "positive"),
)


def kth_text(df: DataFrame, key: str, k: int, step: int = 3) -> str:
    """Exact k-th smallest (from 0) of a text column, by counting longer and longer beginnings."""
    prefix = ""
    while True:
        n = len(prefix)
        rows = df.select(F.col(key).cast("string").alias("v")).filter(F.startswith("v", F.lit(prefix)))
        counts = rows.groupBy(F.substring("v", n + 1, step).alias("next")).count().collect()
        for row in sorted(counts, key=lambda r: r["next"].encode()):
            if k < row["count"]:
                break
            k -= row["count"]
        prefix += row["next"]
        if len(row["next"]) < step:
            return prefix


def _cut(logs: DataFrame) -> tuple[int, Column, Column]:
    """Number of logs, and conditions for the earlier half of logs and of events.

    One aggregate by day tells which day the middle lies in; only that day's rows are read again, by a range of `ts`.
    """
    kind = logs.schema["ts"].dataType.simpleString()
    # wall-clock times stay wall-clock times: the session's zone has no part in their order
    stamp = F.unix_micros(F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp") if kind == "timestamp_ntz" else F.col("ts"))
    days = sorted((r["day"], r["count"]) for r in logs.filter("ts IS NOT NULL").groupBy(F.to_date("ts").alias("day")).count().collect())
    n = sum(count for _, count in days)
    if n <= 1:
        return n, F.lit(True), F.lit(True)
    k = n // 2 - 1
    for day, count in days:
        if k < count:
            break
        k -= count
    ts, start = F.col("ts"), F.lit(day.isoformat()).cast(kind)
    inside = logs.filter((ts >= start) & (ts < F.lit((day + timedelta(days=1)).isoformat()).cast(kind)))
    micros = kth_smallest(inside, stamp, k)
    cut = F.timestamp_micros(F.lit(micros))
    if kind == "timestamp_ntz":
        cut = F.lit((datetime(1970, 1, 1) + timedelta(microseconds=micros)).isoformat(sep=" ")).cast(kind)
    before = inside.filter(ts < cut).count()
    tied, rank = inside.filter(ts == cut), k - before
    if isinstance(logs.schema["log_id"].dataType, T.IntegralType):
        last = F.lit(kth_smallest(tied, F.col("log_id"), rank))
    else:
        last = F.lit(kth_text(tied, "log_id", rank))
    return n, (ts < cut) | ((ts == cut) & (F.col("log_id") <= last)), ts <= cut


def kpi_trend(logs: DataFrame, events: DataFrame) -> DataFrame:
    """Figures of the later half of the log against the earlier half: kpi, earlier, later, trend, direction.

    Logs are halved by row in (ts, log_id) order; events by whether their log's timestamp occurs in the earlier half.
    Log ids are whole numbers or texts.
    """
    n, early_log, early_event = _cut(logs)
    halves = _facts(logs, events, early_log, early_event).groupBy("early").agg(
        *[F.sum(c).alias(c) for c in ("request", "block", *SOURCES)], F.avg("risk").alias("risk")
    )
    # two rows at most: fold them into one
    row = halves.groupBy().agg(
        *[
            F.coalesce(F.max(F.when(side, F.col(c))), F.lit(0)).alias(f"{c}_{name}")
            for c in ("request", "block", *SOURCES, "risk")
            for name, side in (("p1", F.col("early")), ("p2", ~F.col("early")))
        ]
    )
    lines = []
    for kpi, c, more, less in TRENDS:
        now, was = F.col(f"{c}_p2"), F.col(f"{c}_p1")
        lines.append((kpi, was.cast("double"), now.cast("double"), _pct(now, was), trend_label(now, was, more, less)))
    diff = F.col("risk_p2") - F.col("risk_p1")
    lines.append(
        (
            "avg_risk", F.col("risk_p1"), F.col("risk_p2"),
            F.concat(F.when(diff >= 0, "+").otherwise(""), places(diff, 3)),
            F.when(F.abs(diff) < 0.005, "neutral").when(diff > 0, "negative").otherwise("positive"),
        )
    )
    stable = F.lit(n <= 1)
    made = F.array(
        *[
            F.struct(
                F.lit(kpi).alias("kpi"), was.alias("earlier"), now.alias("later"),
                F.when(stable, "Stable").otherwise(trend).alias("trend"),
                F.when(stable, "neutral").otherwise(direction).alias("direction"),
            )
            for kpi, was, now, trend, direction in lines
        ]
    )
    return row.select(F.inline(made))


def verdict_distribution(logs: DataFrame) -> DataFrame:
    return logs.groupBy("action").agg(F.count("*").alias("volume")).orderBy(F.desc("volume"), "action")


SEVERITY_ORDER = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_distribution(events: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity_level"))
    return events.groupBy("severity_level").agg(F.count("*").alias("n_events")).orderBy(order)


def risk_by_day(logs: DataFrame) -> DataFrame:
    return (
        logs.groupBy(F.to_date("ts").alias("day"))
        .agg(F.avg(F.col("risk").cast("double")).alias("mean_risk"), F.count("*").alias("n"))
        .orderBy("day")
    )


def risk_bands(logs: DataFrame, band: Column) -> DataFrame:
    return logs.groupBy(band.alias("band")).agg(F.count("*").alias("n")).orderBy("band")


# Verdict -> (title, text)
TIMELINE = {
    "BLOCK": ("Execution Intercepted", "Jailbreak attempt blocked. Risk: %s."),
    "REDACTED": ("PII Data Redacted", "Leak of private data prevented. Risk: %s."),
    "HUMAN_REVIEW": ("Human Review Trigger", "Escalated file parsing check. Risk: %s."),
}


def threat_timeline(logs: DataFrame, events: DataFrame, limit: int = 5) -> DataFrame:
    """Newest stopped requests with title, text and the type of their first event."""
    newest = logs.filter(F.col("action").isin(*TIMELINE)).orderBy(F.col("ts").desc(), F.col("log_id")).limit(limit)
    first = events.join(newest.select("log_id"), "log_id", "left_semi").groupBy("log_id").agg(
        F.min_by("trigger_type", "position").alias("first_type")
    )
    title = text = None
    for action, (heading, body) in TIMELINE.items():
        test = F.col("action") == action
        title = F.when(test, heading) if title is None else title.when(test, heading)
        text = F.when(test, body) if text is None else text.when(test, body)
    described = F.concat(
        F.replace(text, F.lit("%s"), places(F.col("risk"), 2)),
        F.coalesce(F.concat(F.lit(" Reason: "), F.col("first_type")), F.lit("")),
    )
    return (
        newest.join(first, "log_id", "left")
        .select("log_id", "ts", F.date_format("ts", "MMM dd, HH:mm").alias("time"), title.alias("title"), described.alias("text"))
        .orderBy(F.col("ts").desc(), "log_id")
        .drop("ts")
    )
