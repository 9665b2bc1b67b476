"""Audit tables on shared storage: logs, events and tickets of screened prompts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.crypto import encrypt_col
from tidewall.operators.risk import event_array, screen


def log_rows(screened: DataFrame, key: str, session: str, ts: str, prompt: str, secret: str | None = None) -> DataFrame:
    """One log row per prompt; the raw prompt is encrypted where a secret is given."""
    raw = F.coalesce(F.col(prompt), F.lit(""))
    return screened.select(
        F.col(key).alias("log_id"),
        F.col(session).alias("session_id"),
        F.col(ts).alias("ts"),
        (encrypt_col(raw, secret) if secret else raw).alias("raw_input"),
        "sanitized_input",
        F.col("risk").cast("double").alias("risk"),
        "action",
    )


def write_audit(
    prompts: DataFrame,
    path: str,
    run_id: str,
    batch_id: int,
    key: str = "prompt_id",
    session: str = "session_id",
    ts: str = "ts",
    prompt: str = "prompt",
    secret: str | None = None,
    **screening,
) -> None:
    """Screen prompts and store them with their events and tickets: one row a prompt, one job and one commit a batch.

    A batch is named by its run and its number in the run; it replaces what the same batch of the same run has stored,
    so one that is run again after a failure changes nothing, and no batch touches what another one stored.  A row
    holds its events and its ticket, so a job that dies at any point leaves no log without them, and `read_audit`
    leaves out a batch whose commit has not ended.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError("a run is named by letters, digits and _ . -")
    screened = screen(prompts, prompt, **screening)
    rows = request_rows(screened, key, session, ts, prompt, secret).withColumn("day", F.to_date("ts"))
    # The batch has a folder of its own, which is replaced as a whole.  A task writes one file in order of the days, whose
    # statistics skip pages: a folder for each day would be a file for each task and day, of a few rows where days are many.
    rows.sortWithinPartitions("day").write.mode("overwrite").parquet(f"{path}/requests/run={run_id}/batch={batch_id}")


def request_rows(screened: DataFrame, key: str, session: str, ts: str, prompt: str, secret: str | None = None) -> DataFrame:
    """One row per prompt: its log, with `events` (an array) and `ticket` (a struct, null where none is opened)."""
    raw = F.coalesce(F.col(prompt), F.lit(""))
    ticket = F.struct(
        F.col(key).alias("approval_id"), F.col(key).alias("log_id"), F.lit(fixed.PENDING).alias("status"),
        F.lit(None).cast("string").alias("reviewer_id"), F.lit(None).cast("string").alias("review_notes"),
        F.col(ts).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
    )
    return screened.select(
        F.col(key).alias("log_id"), F.col(session).alias("session_id"), F.col(ts).alias("ts"),
        (encrypt_col(raw, secret) if secret else raw).alias("raw_input"), "sanitized_input",
        F.col("risk").cast("double").alias("risk"), "action", event_array().alias("events"),
        F.when(F.col("action") == "HUMAN_REVIEW", ticket).alias("ticket"),
    )


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches whose commit has ended: the committer marks each with a file when all rows are there."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/requests/run=*/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(status.getPath().getParent().toString() for status in found or [])


def read_audit(
    spark: SparkSession, path: str, key: str = "bigint", session: str = "string", ts: str = "timestamp_ntz"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(logs, events, tickets) of all runs, three views of one table; empty where nothing has been written.

    `key`, `session` and `ts` are the types that the prompts had.
    """
    one = spark.createDataFrame([], f"prompt_id {key}, session_id {session}, ts {ts}, prompt string")
    schema = request_rows(screen(one, "prompt"), "prompt_id", "session_id", "ts", "prompt").schema
    folders = committed(spark, path)
    if folders:
        # files at any depth: older batches have a folder for each day
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)
    else:
        rows = spark.createDataFrame([], schema)
    return (
        rows.drop("events", "ticket"),
        rows.select("log_id", "ts", F.inline("events")),
        rows.where(F.col("ticket").isNotNull()).select("ticket.*"),
    )
