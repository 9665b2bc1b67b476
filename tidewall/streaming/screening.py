"""Streaming forms: screening, audit sink, daily risk and review decisions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewall.operators.risk import screen
from tidewall.sources.audit_store import write_audit


def screen_stream(prompts: DataFrame, prompt: str = "prompt", **screening) -> DataFrame:
    """Screening keeps no state: the batch plan runs on a stream unchanged."""
    assert prompts.isStreaming
    return screen(prompts, prompt, **screening)


def run_of(checkpoint: str) -> str:
    """A stream's stable name: that of its checkpoint, whose batches are numbered from 0."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:32]


def audit_sink(prompts: DataFrame, path: str, checkpoint: str, **audit) -> DataStreamWriter:
    """Writer that stores logs, events and tickets of each micro-batch.

    A batch that is replayed overwrites itself; another checkpoint is another run and overwrites nothing of this one.
    """
    run = run_of(checkpoint)

    def store(rows: DataFrame, batch_id: int) -> None:
        write_audit(rows, path, run, batch_id, **audit)

    return prompts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def risk_by_day_stream(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """Mean risk per UTC day; rows later than the watermark are dropped."""
    return (
        logs.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.avg(F.col("risk").cast("double")).alias("mean_risk"), F.count("*").alias("n"))
        .select(F.to_date(F.to_utc_timestamp("w.start", F.current_timezone())).alias("day"), "mean_risk", "n")
    )


def decisions_sink(decisions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that keeps the first valid decision per ticket.

    Within a micro-batch the earliest decision wins, across batches and runs the one that came first.  A batch writes
    only its own folder and leaves it out when it looks for earlier decisions, so a replayed batch gives the same result.
    """
    run = run_of(checkpoint)

    def store(rows: DataFrame, batch_id: int) -> None:
        spark, first = rows.sparkSession, first_decisions(rows)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            stored = spark.read.schema(DECIDED_SCHEMA).parquet(path)
            # not this batch's own rows, nor those that this run stored after it
            earlier = stored.filter((F.col("run") != run) | (F.col("batch") < batch_id))
            first = first.join(earlier.select("approval_id"), "approval_id", "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    return decisions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


DECIDED_SCHEMA = (
    "approval_id bigint, decision_id bigint, status string, reviewer_id string, review_notes string, "
    "ts timestamp, run string, batch int"
)


def first_decisions(decisions: DataFrame) -> DataFrame:
    """Earliest valid decision of each ticket; a minimum, so hot tickets are combined before the shuffle."""
    valid = F.upper("status").isin("APPROVED", "REJECTED") & F.length("reviewer_id").between(1, 100)
    row = F.struct("ts", "decision_id", F.upper("status").alias("status"), "reviewer_id", "review_notes")
    return decisions.filter(valid).groupBy("approval_id").agg(F.min(row).alias("d")).select(
        "approval_id", "d.decision_id", "d.status", "d.reviewer_id", "d.review_notes", "d.ts"
    )
