"""Registered queries: name -> (Spark query, SQL for DuckDB or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.scoring import as_score
from tidewall.operators.detect import detect
from tidewall.operators.redact import pii_summary, redact
from tidewall.operators.risk import screen
from tidewall.plans import inputs, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        assert name not in QUERIES
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _detector_query(detector, source):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = detect(source(spark, sf_dir), "prompt", detector)
        return out.select(
            "prompt_id",
            F.array_join("labels", "|").alias("labels"),
            F.size("labels").cast("long").alias("n_labels"),
            F.col("score").cast("double").alias("score"),
            F.col("confidence").cast("double").alias("confidence"),
        )

    return run


NAMES = {
    "injection": "prompt_injection", "jailbreak": "jailbreak", "command": "command_injection", "sql": "sql_injection",
    "xss": "cross_site_scripting", "leakage": "prompt_leakage", "code": "code_execution",
}
for _d in fixed.TEXT_RULE_DETECTORS:
    query(f"detect_{NAMES[_d.key]}", oracle.detector_query(_d))(_detector_query(_d, inputs.prompts))
for _d in (fixed.SQL, fixed.CODE, fixed.INJECTION):
    query(f"short_payload_{NAMES[_d.key]}", oracle.detector_query(_d, oracle.SHORT_PROMPTS))(
        _detector_query(_d, inputs.short_prompts)
    )
query("detect_sensitive_data", oracle.sensitive_query())(_detector_query(fixed.SENSITIVE, inputs.prompts))


@query(
    "redact_default",
    f"""WITH {oracle.PROMPTS}, {oracle.redaction('prompts', 'prompt', fixed.REDACTION, 'prompt_id')}
SELECT prompt_id, masked AS sanitized, array_to_string(entities, '|') AS entities FROM redacted""",
)
def redact_default(spark, sf_dir):
    out = redact(inputs.prompts(spark, sf_dir), "prompt")
    return out.select("prompt_id", "sanitized", F.array_join("entities", "|").alias("entities"))


@query(
    "redact_strict_summary",
    f"""WITH {oracle.PROMPTS}, {oracle.redaction('prompts', 'prompt', fixed.REDACTION_STRICT, 'prompt_id')},
named AS (SELECT *, list_filter(entities, lambda x, i: list_position(entities, x) = i) AS labels FROM redacted)
SELECT prompt_id, masked AS sanitized, array_to_string(labels, '|') AS entities, len(labels) > 0 AS has_pii,
       replace({oracle.q(fixed.STRICT_SUMMARY)}, '%s',
               CASE WHEN len(labels) > 0 THEN array_to_string(labels, ', ') ELSE 'None' END) AS explanation
FROM named""",
)
def redact_strict_summary(spark, sf_dir):
    out = pii_summary(inputs.prompts(spark, sf_dir), "prompt")
    return out.select("prompt_id", "sanitized", F.array_join("entities", "|").alias("entities"), "has_pii", "explanation")


@query(
    "screen_prompts",
    f"""WITH {oracle.screened()}
SELECT prompt_id, CAST(risk AS DOUBLE) AS risk, action, severity, reasoning, array_to_string(findings, '|') AS findings,
       CASE WHEN action = 'BLOCK' THEN NULL WHEN s_sensitive > 0.30 THEN masked ELSE prompt END AS sanitized_input
FROM screened""",
)
def screen_prompts(spark, sf_dir):
    return screen(inputs.prompts(spark, sf_dir)).select(
        "prompt_id", F.col("risk").cast("double").alias("risk"), "action", "severity", "reasoning",
        F.array_join("findings", "|").alias("findings"), "sanitized_input",
    )
