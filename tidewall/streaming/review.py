"""Review decisions against tickets as a stream with keyed state.

The state of a ticket is its status, and the decision that gave it; it lives in the stream's checkpoint, so a batch costs
what comes in with it, whatever has been decided before: only the tickets that decisions name are read and written.  The first valid decision that reaches a pending ticket wins, of
several in one batch the earliest by (`ts`, `decision_id`, `status`).  Every other decision comes out with the reason why it
changes nothing; only a repetition of the winning decision (same `ts`, id and status) is silent, as a source may deliver
twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidewall import fixed
from tidewall.operators.audit import sync_verdict
from tidewall.streaming.screening import run_of

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcome_schema(tickets: DataFrame) -> str:
    """Type of an outcome: a decided ticket (`error` null), or a decision that changes nothing."""
    kinds = dict(tickets.dtypes)
    return (
        f"approval_id {kinds['approval_id']}, decision_id bigint, log_id {kinds['log_id']}, status string, reviewer_id string, "
        "review_notes string, ts timestamp, error string"
    )


class _Review(StatefulProcessor):
    """The tickets of one bucket, a map by their number: times are microseconds, and a number that is not there has no ticket."""

    def __init__(self, key_type: str, log_type: str):
        self._key_type, self._log_type = key_type, log_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._tickets = handle.getMapState(
            "tickets", f"approval_id {self._key_type}", f"status string, log_id {self._log_type}, decision_id bigint, ts bigint"
        )

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._tickets.updateValue((initialState.approval_id,), (initialState.status, initialState.log_id, None, None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tickets, best, others = {}, {}, {}
        for row in rows:
            number = row.approval_id
            verdict = row.status.upper() if row.status is not None else None
            given = row.reviewer_id is not None and 1 <= len(row.reviewer_id) <= 100
            mark = (row.ts, row.decision_id, verdict)
            if verdict not in fixed.REVIEW_VERDICTS or not given:
                yield self._error(number, mark, fixed.BAD_DECISION)
                continue
            if number not in tickets:
                found = self._tickets.getValue((number,))
                tickets[number] = None if found is None else tuple(found)
            ticket = tickets[number]
            if ticket is None:
                yield self._error(number, mark, fixed.NO_TICKET)
            elif ticket[0] != fixed.PENDING:
                yield from self._late(number, mark, (ticket[3], ticket[2], ticket[0]))
            else:
                # What loses can only be reported when the winner is known: marks are kept, and only in the one
                # batch that decides a ticket.
                full = (mark, row.reviewer_id, row.review_notes)
                if number not in best:
                    best[number] = full
                    continue
                if _order(mark) < _order(best[number][0]):
                    best[number], full = full, best[number]
                others.setdefault(number, []).append(full[0])
        for number, ((ts, decision, verdict), reviewer, notes) in best.items():
            log_id = tickets[number][1]
            self._tickets.updateValue((number,), (verdict, log_id, decision, ts))
            yield _OUTCOME(number, decision, log_id, verdict, reviewer, notes, ts, None)
            for mark in others.get(number, ()):
                yield from self._late(number, mark, (ts, decision, verdict))

    def _error(self, number, mark, text: str) -> Row:
        return _OUTCOME(number, mark[1], None, None, None, None, mark[0], text)

    def _late(self, number, mark, winner) -> list[Row]:
        return [] if mark == winner else [self._error(number, mark, fixed.PROCESSED[0] + winner[2] + fixed.PROCESSED[1])]

    def close(self) -> None:
        pass


_OUTCOME = Row("approval_id", "decision_id", "log_id", "status", "reviewer_id", "review_notes", "ts", "error")
#: Fixed for the life of a checkpoint.  Tickets are dealt to buckets, each with a map from ticket to status: Spark calls
#: Python once for a bucket with rows, as calls and Arrow batches for every single ticket take most of the time.
BUCKETS = 4096


def _order(mark: tuple) -> tuple:
    return tuple((x is not None, x) if x is not None else (False,) for x in mark)


def review_stream(decisions: DataFrame, tickets: DataFrame) -> DataFrame:
    """Outcomes of a stream of decisions; `tickets` (a table) is the state that a new checkpoint starts from.

    Needs the RocksDB state store, which `start_review` sets for its stream.
    """
    kinds = dict(tickets.dtypes)
    number = F.col("approval_id").cast(kinds["approval_id"])
    bucket = F.pmod(F.xxhash64(number), F.lit(BUCKETS)).cast("int").alias("_bucket")
    rows = decisions.select(
        bucket, number.alias("approval_id"), F.col("decision_id").cast("bigint").alias("decision_id"), "status", "reviewer_id",
        "review_notes", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
    )
    initial = tickets.select(bucket, number.alias("approval_id"), "status", "log_id").groupBy("_bucket")
    schema = outcome_schema(tickets)
    out = rows.groupBy("_bucket").transformWithState(
        _Review(kinds["approval_id"], kinds["log_id"]), schema.replace("ts timestamp", "ts bigint"), "Append", "None", initial
    )
    return out.withColumn("ts", F.timestamp_micros("ts"))


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Settings that a stream takes over when it starts; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_review(
    decisions: DataFrame, tickets: DataFrame, path: str, checkpoint: str, *, partitions: int | None = None, **trigger
) -> StreamingQuery:
    """Starts the stream; outcomes of each batch go to a folder of their own, which a replayed batch replaces.

    A new checkpoint starts from `tickets` as earlier runs have left them (`current_tickets`), so the first decision stays
    the first.  `partitions` of the state stay what they are for the life of the checkpoint.
    """
    spark, run = decisions.sparkSession, run_of(checkpoint)
    out = review_stream(decisions, current_tickets(tickets, path))

    def store(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    settings = {"spark.sql.streaming.stateStore.providerClass": _STORE}
    if partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    with _settings(spark, **settings):
        return out.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def outcomes(spark: SparkSession, tickets: DataFrame, path: str) -> DataFrame:
    """All outcomes stored below `path`, of all runs."""
    folder, schema = spark._jvm.org.apache.hadoop.fs.Path(path), outcome_schema(tickets)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([], schema).columns
    return spark.read.schema(schema).parquet(path).select(*names)


def current_tickets(tickets: DataFrame, path: str) -> DataFrame:
    """Tickets with the decisions stored below `path`; `reviewed_at` is when they were made."""
    decided = outcomes(tickets.sparkSession, tickets, path).where("error IS NULL").select(
        "approval_id", F.struct("status", "reviewer_id", "review_notes", "ts").alias("_d")
    )
    joined = tickets.join(decided, "approval_id", "left")
    new = {"status": "status", "reviewer_id": "reviewer_id", "review_notes": "review_notes", "reviewed_at": "ts"}
    return joined.select(*(
        F.when(F.col("_d").isNotNull(), F.col(f"_d.{new[c]}").cast(tickets.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in new else F.col(c) for c in tickets.columns
    ))


def current_logs(logs: DataFrame, tickets: DataFrame, path: str) -> DataFrame:
    """Logs with the verdicts of the tickets decided below `path`."""
    return sync_verdict(logs, current_tickets(tickets, path))
