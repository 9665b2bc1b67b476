"""Registered queries over screened prompts: features, explanations, events, tickets, routing, audit rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.crypto import decrypt_col, encrypt_col
from tidewall.functions.scoring import explain
from tidewall.functions.shared import shared_folder
from tidewall.functions.text import (
    char_sum, complexity, matched_tokens, preview, prompt_hash, short_hash, squash, text_profile,
)
from tidewall.operators import audit, kpi, risk
from tidewall.operators.detect import detect
from tidewall.operators.registry import pattern_labels, register_detector
from tidewall.operators.threat import classify_threat
from tidewall.plans import inputs, oracle
from tidewall.plans.catalog import query
from tidewall.plans.oracle import q
from tidewall.sources.audit_store import log_rows, read_audit, write_audit
from tidewall.sources.prompts import accept, decode_attachment, load_prompts
from tidewall.streaming.screening import audit_sink

D = "double"


def _screened(spark, sf_dir, **kw):
    return risk.screen(inputs.prompts(spark, sf_dir), **kw)


@query(
    "text_features",
    f"""WITH {oracle.PROMPTS}, {oracle.features('prompts')}
SELECT prompt_id, sum_raw, sum_low, CAST(symbols AS BIGINT) AS symbols, CAST(chars AS BIGINT) AS chars,
       CAST(length(squashed) AS BIGINT) AS solid FROM feat""",
)
def text_features(spark, sf_dir):
    p = inputs.prompts(spark, sf_dir).select("prompt_id", text_profile("prompt").alias("f"))
    return p.select("prompt_id", "f.sum_raw", "f.sum_low", "f.symbols", "f.chars", "f.solid")


@query(
    "text_features_built_in",
    f"""WITH {oracle.SHORT_PROMPTS}, {oracle.features('prompts')}
SELECT prompt_id, sum_raw AS char_sum, CAST(symbols AS BIGINT) AS complexity, squashed AS squash FROM feat""",
)
def text_features_built_in(spark, sf_dir):
    return inputs.short_prompts(spark, sf_dir).select(
        "prompt_id", char_sum("prompt").alias("char_sum"), complexity("prompt").alias("complexity"),
        squash("prompt").alias("squash"),
    )


_WORDS = oracle.sql_list([w for w in fixed.TRIGGER_WORDS])
_TOKENS = f"""toks AS (SELECT *, list_concat(
    list_filter(regexp_extract_all(plain_low, '\\w+'), lambda w: list_contains({_WORDS}, w)),
    list_filter([CASE WHEN contains(replace(prompt, ' ', ''), '1=1') THEN '1=1' END, CASE WHEN contains(prompt, '--') THEN '--' END],
                lambda x: x IS NOT NULL)) AS raw FROM feat),
tokens AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i)[1:6] AS found FROM toks)"""


@query(
    "matched_tokens",
    f"""WITH {oracle.PROMPTS}, {oracle.features('prompts')}, {_TOKENS}
SELECT prompt_id, array_to_string(found, ',') AS tokens FROM tokens""",
)
def matched_tokens_query(spark, sf_dir):
    return inputs.prompts(spark, sf_dir).select("prompt_id", F.array_join(matched_tokens("prompt"), ",").alias("tokens"))


@query(
    "prompt_hash_and_preview",
    f"""WITH {oracle.PROMPTS}
SELECT prompt_id, sha256(prompt) AS hash, left(sha256(prompt), 16) AS short_hash,
       CASE WHEN length(prompt) > 95 THEN left(prompt, 95) || '...' ELSE prompt END AS preview FROM prompts""",
)
def prompt_hash_and_preview(spark, sf_dir):
    return inputs.prompts(spark, sf_dir).select(
        "prompt_id", prompt_hash("prompt").alias("hash"), short_hash("prompt").alias("short_hash"),
        preview("prompt").alias("preview"),
    )


@query(
    "explain_matches",
    f"""WITH {oracle.PROMPTS}, {oracle.features('prompts')}, {_TOKENS},
hits AS (SELECT *, {oracle.label_list(fixed.JAILBREAK)} AS lab FROM tokens),
said AS (SELECT *, {oracle.described('lab')} AS texts FROM hits)
SELECT prompt_id, lab[1] AS matched_rule, CASE WHEN len(found) > 0 THEN array_to_string(found, ', ') ELSE 'None' END AS matched_tokens,
       array_to_string(lab, ', ') AS evidence, {oracle.reason_text('texts', fixed.JAILBREAK)} AS reason
FROM said WHERE len(lab) > 0""",
)
def explain_matches(spark, sf_dir):
    hits = detect(inputs.prompts(spark, sf_dir), "prompt", fixed.JAILBREAK).filter(F.size("labels") > 0)
    return hits.select("prompt_id", explain("prompt", "labels", fixed.JAILBREAK).alias("x")).select(
        "prompt_id", "x.*"
    )


@query(
    "detector_details",
    f"""WITH {oracle.screened(reasons=True)}, long AS (SELECT prompt_id, unnest(results) AS r FROM screened)
SELECT prompt_id, r.detector AS detector_name, CAST(r.score AS DOUBLE) AS score, CAST(r.confidence AS DOUBLE) AS confidence,
       CASE WHEN len(r.matched) > 0 THEN array_to_string(r.matched, ', ') ELSE 'None' END AS matched_evidence,
       r.reason AS explanation FROM long""",
)
def detector_details(spark, sf_dir):
    out = risk.detector_details(_screened(spark, sf_dir), "prompt_id")
    return out.withColumns({"score": F.col("score").cast(D), "confidence": F.col("confidence").cast(D)})


def _event_map(which):
    rows = " ".join(f"WHEN {q(d)} THEN {q(v)}" for d, v in which.items())
    return f"CASE r.detector {rows} END"


_SECURITY = f"""long AS (SELECT prompt_id, unnest(results) AS r FROM screened),
sec AS (SELECT prompt_id AS log_id, {_event_map(risk._EVENT_SOURCE)} AS agent_source, {_event_map(risk._EVENT_TYPE)} AS trigger_type,
        {oracle.severity_case('r.score')} AS severity_level, CAST(r.score AS DOUBLE) AS score, array_to_string(r.matched, '|') AS matched
        FROM long WHERE r.score > 0.10)"""
_POLICY = """pol AS (SELECT prompt_id AS log_id, 'RISK_SCORE' AS agent_source, 'GATEWAY_POLICY_ENFORCEMENT' AS trigger_type,
        severity AS severity_level, reasoning AS reason, array_to_string(findings, '|') AS matched FROM screened
        WHERE action IN ('BLOCK', 'HUMAN_REVIEW', 'ALLOW_WITH_WARNING'))"""


def _event_columns(events):
    return events.select(
        "log_id", "agent_source", "trigger_type", "severity_level", F.col("details.score").cast(D).alias("score"),
        F.array_join("details.matched", "|").alias("matched"),
    )


@query("security_events", f"WITH {oracle.screened()}, {_SECURITY} SELECT * FROM sec")
def security_events(spark, sf_dir):
    return _event_columns(risk.security_events(_screened(spark, sf_dir), "prompt_id", "ts"))


@query("policy_events", f"WITH {oracle.screened()}, {_POLICY} SELECT * FROM pol")
def policy_events(spark, sf_dir):
    return risk.policy_events(_screened(spark, sf_dir), "prompt_id", "ts").select(
        "log_id", "agent_source", "trigger_type", "severity_level", F.col("details.reason").alias("reason"),
        F.array_join("details.matched", "|").alias("matched"),
    )


@query(
    "audit_events",
    f"""WITH {oracle.screened()}, {_SECURITY}, {_POLICY}
SELECT * FROM sec UNION ALL SELECT log_id, agent_source, trigger_type, severity_level, NULL, matched FROM pol""",
)
def audit_events(spark, sf_dir):
    return _event_columns(risk.all_events(_screened(spark, sf_dir), "prompt_id", "ts"))


@query(
    "audit_logs",
    f"""WITH {oracle.screened()}
SELECT prompt_id AS log_id, session_id, ts, prompt AS raw_input,
       CASE WHEN action = 'BLOCK' THEN NULL WHEN s_sensitive > 0.30 THEN masked ELSE prompt END AS sanitized_input,
       CAST(risk AS DOUBLE) AS risk, action FROM screened""",
)
def audit_logs(spark, sf_dir):
    return log_rows(_screened(spark, sf_dir), "prompt_id", "session_id", "ts", "prompt")


_AUDIT_SQL = f"""WITH {oracle.screened()}
SELECT prompt_id AS log_id, session_id, ts, prompt AS raw_input, CAST(risk AS DOUBLE) AS risk, action,
       CASE WHEN action = 'HUMAN_REVIEW' THEN 1 ELSE 0 END AS n_tickets, action <> 'ALLOW' AS has_events FROM screened"""


@query("audit_round_trip", _AUDIT_SQL)
def audit_round_trip(spark, sf_dir):
    """All prompts through the store in two batches of two runs, one of them replayed, read back with what hangs on them."""
    prompts, store = inputs.prompts(spark, sf_dir), shared_folder(spark, "audit")
    early = F.col("prompt_id") < prompts.agg(F.avg("prompt_id")).first()[0]
    write_audit(prompts.where(early), store, "first", 0)
    for _ in range(2):
        write_audit(prompts.where(~early), store, "second", 0)
    return _stored(spark, store)


def _stored(spark, store):
    logs, events, tickets = read_audit(spark, store)
    marked = events.where("agent_source = 'RISK_SCORE'").select("log_id", F.lit(True).alias("has_events")).distinct()
    held = tickets.groupBy("log_id").agg(F.count(F.lit(1)).cast("int").alias("n_tickets"))
    out = logs.join(marked, "log_id", "left").join(held, "log_id", "left")
    return out.select(
        "log_id", "session_id", "ts", "raw_input", "risk", "action", F.coalesce("n_tickets", F.lit(0)).alias("n_tickets"),
        F.coalesce("has_events", F.lit(False)).alias("has_events"),
    )


@query("audit_stream", _AUDIT_SQL)
def audit_stream(spark, sf_dir):
    """The same rows through the streaming sink: micro-batches from files, each stored by one commit."""
    folder = shared_folder(spark, "audit-stream")
    prompts = inputs.prompts(spark, sf_dir)
    prompts.write.parquet(f"{folder}/in")
    stream = load_prompts(spark, f"{folder}/in", streaming=True, schema=prompts.schema)
    audit_sink(stream, f"{folder}/store", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return _stored(spark, f"{folder}/store")


@query(
    "review_tickets",
    f"WITH {oracle.screened()} SELECT prompt_id AS approval_id, prompt_id AS log_id, 'PENDING' AS status, ts AS created_at FROM screened WHERE action = 'HUMAN_REVIEW'",
)
def review_tickets(spark, sf_dir):
    return risk.review_tickets(_screened(spark, sf_dir), "prompt_id", "ts").select("approval_id", "log_id", "status", "created_at")


@query(
    "triggered_summary",
    f"""WITH {oracle.screened()}, strong AS (SELECT prompt_id, list_filter(results, lambda r: r.score > 0.30) AS s FROM screened)
SELECT prompt_id, CAST(len(s) AS BIGINT) AS n_triggered,
       CASE WHEN len(s) > 0 THEN array_to_string(list_transform(s, lambda r: r.detector || ' (Threat Index: '
         || CAST(CAST(round(r.score, 2) AS DECIMAL(5,2)) AS VARCHAR) || ', Confidence: ' || CAST(CAST(r.confidence * 100 AS INT) AS VARCHAR)
         || '%) Evidence: ' || CASE WHEN len(r.matched) > 0 THEN array_to_string(r.matched, ', ') ELSE 'None' END), chr(10))
       ELSE 'All security modules scanned clean. No threat indicators triggered.' END AS summary FROM strong""",
)
def triggered_summary(spark, sf_dir):
    return risk.triggered_summary(_screened(spark, sf_dir), "prompt_id")


@query(
    "routing",
    f"""WITH {oracle.screened()}
SELECT prompt_id, CASE action WHEN 'BLOCK' THEN 'INTERCEPT' WHEN 'HUMAN_REVIEW' THEN 'HOLD' ELSE 'FORWARD' END AS route,
       CASE WHEN action IN ('ALLOW', 'ALLOW_WITH_WARNING') THEN prompt END AS outbound_text,
       CASE WHEN action = 'BLOCK' THEN {q(fixed.INTERCEPTED_TEXT)} END AS notice FROM screened""",
)
def routing(spark, sf_dir):
    return risk.routing(_screened(spark, sf_dir), "prompt_id", "prompt")


@query(
    "verdict_distribution",
    f"WITH {oracle.screened()} SELECT action, count(*) AS volume FROM screened GROUP BY action",
)
def verdict_distribution(spark, sf_dir):
    return kpi.verdict_distribution(_screened(spark, sf_dir))


@query(
    "risk_band_counts",
    f"""WITH {oracle.screened()}, s AS (SELECT risk, s_sensitive FROM screened)
SELECT CASE WHEN risk >= 0.75 THEN 'CRITICAL' WHEN risk >= 0.35 THEN 'MODERATE' ELSE 'SECURE' END AS gauge,
       CASE WHEN risk > 0.75 THEN 'negative' WHEN risk > 0.40 THEN 'warning' ELSE 'positive' END AS feed,
       CASE WHEN s_sensitive >= 0.75 THEN 'negative' WHEN s_sensitive >= 0.30 THEN 'warning' ELSE 'positive' END AS badge,
       count(*) AS n FROM s GROUP BY ALL""",
)
def risk_band_counts(spark, sf_dir):
    sensitive = F.filter("results", lambda r: r["detector"] == fixed.SENSITIVE.display)[0]["score"]
    return (
        _screened(spark, sf_dir)
        .groupBy(
            risk.risk_band(F.col("risk")).alias("gauge"), risk.risk_band(F.col("risk"), "feed").alias("feed"),
            risk.risk_band(sensitive, "badge").alias("badge"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    "compliance_rollup",
    f"""WITH {oracle.screened()}, rep AS MATERIALIZED (SELECT action, lower(concat_ws(' ', session_id, action, reasoning, array_to_string(findings, ', '))) AS t FROM screened)
SELECT action, NOT (contains(t, 'block') OR contains(t, 'human_review')) AS compliance_passed,
       CASE WHEN contains(t, 'block') THEN 'BLOCKED' WHEN contains(t, 'human_review') THEN 'HELD FOR REVIEW' ELSE 'APPROVED' END AS status_label,
       contains(t, 'block') OR contains(t, 'human_review') OR contains(t, 'pii') AS alert_triggered, count(*) AS n
FROM rep GROUP BY ALL""",
)
def compliance_rollup(spark, sf_dir):
    s = _screened(spark, sf_dir).withColumn(
        "report",
        audit.report_text(F.col("session_id"), F.col("action"), F.col("risk"), F.col("reasoning"), F.col("findings")),
    )
    return (
        audit.compliance_report(s, "report")
        .groupBy("action", "compliance_passed", "status_label", "alert_triggered")
        .agg(F.count("*").alias("n"))
    )


@query(
    "verdict_by_quality_label",
    f"""WITH {oracle.screened()} SELECT l.quality, l.toxic, s.action, count(*) AS n, avg(CAST(s.risk AS DOUBLE)) AS mean_risk
FROM screened s JOIN labels l ON l.doc_id = s.prompt_id GROUP BY ALL""",
)
def verdict_by_quality_label(spark, sf_dir):
    labels = inputs.table(spark, sf_dir, "labels")
    # join before the verdict is computed would only move text: the screened row is narrow
    s = _screened(spark, sf_dir).select("prompt_id", "action", "risk")
    return (
        s.join(labels, s.prompt_id == labels.doc_id)
        .groupBy("quality", "toxic", "action")
        .agg(F.count("*").alias("n"), F.avg(F.col("risk").cast(D)).alias("mean_risk"))
    )


@query(
    "registered_detector",
    f"""WITH {oracle.PROMPTS}, {oracle.features('prompts')},
l AS (SELECT *, list_filter([CASE WHEN regexp_matches(prompt, 'umbrella') THEN 'UMBRELLA' END,
      CASE WHEN regexp_matches(plain, '(?i)\\bqueen\\b') THEN 'QUEEN' END], lambda x: x IS NOT NULL) AS lab FROM feat),
s AS (SELECT *, {{score}} AS sc FROM l)
SELECT prompt_id, array_to_string(lab, '|') AS labels, CAST(sc AS DOUBLE) AS score FROM s""".replace(
        "{score}",
        oracle.scores("lab", fixed.Detector("weather", "Weather", "Weather", "MEDIUM", "0.50", {"UMBRELLA": "0.70"}))[0],
    ),
)
def registered_detector(spark, sf_dir):
    extra = register_detector("Weather", pattern_labels(UMBRELLA="umbrella", QUEEN=r"(?i)\bqueen\b"), weights={"UMBRELLA": "0.70"})
    s = _screened(spark, sf_dir, extra=(extra,))
    return s.select("prompt_id", F.element_at("results", -1).alias("r")).select(
        "prompt_id", F.array_join("r.matched", "|").alias("labels"), F.col("r.score").cast(D).alias("score")
    )


def _classifier_sql():
    group_cols, steps = [], []
    for n, (finding, patterns, literals, *_r) in enumerate(fixed.CLASSIFIER):
        if literals:
            count = "CAST((" + " OR ".join(f"contains(low, {q(k)})" for k in literals) + ") AS INT)"
        else:
            text, flag = ("plain_low", "") if finding == "SQL_INJECTION" else ("plain", "(?i)")
            hits = [f"regexp_matches({text}, {q(flag + oracle.re2(p))})" for p in patterns]
            if finding == "REVERSE_SHELL_PAYLOAD":
                hits = [f"(contains(low, {q(fixed.REVERSE_SHELL_LITERAL)}) OR {h})" for h in hits]
            count = " + ".join(f"CAST({h} AS INT)" for h in hits)
        group_cols.append(f"{count} AS n{n}")
    found = "flatten([" + ", ".join(
        f"list_transform(range(n{n}), lambda x: {q(r[0])})" for n, r in enumerate(fixed.CLASSIFIER)
    ) + "])"
    rank = ", ".join(f"CASE WHEN n{n} > 0 THEN {r[3]} ELSE 0 END" for n, r in enumerate(fixed.CLASSIFIER))
    # final type, from the last group that always replaces back to the first that may
    kind = """CASE WHEN n6 > 0 OR n0 > 0 OR n1 > 0 THEN 'COMMAND_ATTACK' WHEN n2 > 0 THEN 'JAILBREAK'
      WHEN n4 > 0 AND n5 = 0 THEN 'ROLE_ESCALATION' WHEN n4 > 0 THEN 'ROLE_ESCALATION'
      WHEN n3 > 0 OR n5 > 0 THEN 'PROMPT_INJECTION' ELSE 'SAFE' END"""
    severity = "CASE WHEN n6 > 0 OR n0 > 0 OR n1 > 0 THEN 'CRITICAL' WHEN n2 + n3 + n4 + n5 > 0 THEN 'HIGH' ELSE 'LOW' END"
    return f"""{oracle.PROMPTS}, {oracle.features('prompts')}, groups AS (SELECT *, {', '.join(group_cols)} FROM feat),
threats AS (SELECT prompt_id, len({found}) > 0 AS is_injection, CAST(greatest(0.05, {rank}) AS DOUBLE) AS risk_score,
  {kind} AS threat_type, {severity} AS severity, {found} AS findings FROM groups)"""


CLASSIFIER_SQL = _classifier_sql()


@query(
    "classify_threat",
    f"""WITH {CLASSIFIER_SQL}
SELECT prompt_id, is_injection, risk_score, threat_type, severity, array_to_string(findings, ', ') AS findings,
       replace({q(fixed.CLASSIFIER_TEXT)}, '%s', CASE WHEN len(findings) > 0 THEN array_to_string(findings, ', ') ELSE 'None' END) AS explanation
FROM threats""",
)
def classify_threat_query(spark, sf_dir):
    t = classify_threat(inputs.prompts(spark, sf_dir), "prompt").select("prompt_id", "threat.*")
    return t.withColumn("risk_score", F.col("risk_score").cast(D)).withColumn("findings", F.array_join("findings", ", "))


@query("encrypt_round_trip", f"WITH {oracle.PROMPTS} SELECT prompt_id, prompt AS opened, true AS sealed, '[Decryption Failed]' AS wrong_key FROM prompts")
def encrypt_round_trip(spark, sf_dir):
    p = inputs.prompts(spark, sf_dir).withColumn("box", encrypt_col(F.col("prompt"), "key one"))
    return p.select(
        "prompt_id", decrypt_col(F.col("box"), "key one").alias("opened"),
        (F.rlike("box", F.lit("^[A-Za-z0-9_=-]+$")) & (F.col("box") != F.col("prompt"))).alias("sealed"),
        decrypt_col(F.col("box"), "key two").alias("wrong_key"),
    )


_REQUESTS = """requests AS (SELECT conv_id, turn, 's' || conv_id AS session_id,
  CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN ' ' || chr(9) || chr(10) WHEN 2 THEN '' ELSE chr(8195) || chr(160) END AS prompt,
  CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN to_base64(encode(text)) ELSE 'abc' END AS file_base64 FROM conversations)"""


def _requests(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "conversations")
    t, k = F.col("turn") % 4, F.col("conv_id") % 4
    return c.select(
        "conv_id", "turn", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.when(t == 0, F.col("text")).when(t == 1, F.lit(" \t\n")).when(t == 2, F.lit("")).otherwise(F.lit("  ")).alias("prompt"),
        F.when(k == 0, F.lit(None)).when(k == 1, F.lit("")).when(k == 2, F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", ""))
        .otherwise(F.lit("abc")).alias("file_base64"),
    )


@query(
    "accept_requests",
    f"""WITH {_REQUESTS} SELECT conv_id, turn, session_id, prompt FROM requests
WHERE turn % 4 = 0 AND regexp_matches(prompt, '[^\\s]') OR coalesce(file_base64, '') <> ''""",
)
def accept_requests(spark, sf_dir):
    return accept(_requests(spark, sf_dir)).select("conv_id", "turn", "session_id", "prompt")


@query(
    "decode_attachments",
    f"""WITH {_REQUESTS} SELECT conv_id, turn, CASE WHEN conv_id % 4 = 2 THEN decode(from_base64(file_base64)) WHEN conv_id % 4 = 1 THEN '' END AS text FROM requests""",
)
def decode_attachments(spark, sf_dir):
    return _requests(spark, sf_dir).select("conv_id", "turn", decode_attachment("file_base64").cast("string").alias("text"))
