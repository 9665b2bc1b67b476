"""Registered queries over log tables, tool calls, vectors, attachments and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.vectors import cosine, fit_dim
from tidewall.operators import audit, files, guard, kpi, risk
from tidewall.functions.shared import shared_folder
from tidewall.operators.similarity import match_signatures
from tidewall.operators.threat import classify_threat, hybrid_override
from tidewall.plans import inputs, oracle
from tidewall.plans.catalog import query
from tidewall.plans.catalog_screening import CLASSIFIER_SQL
from tidewall.plans.oracle import q
from tidewall.sources.policy import load_policy
from tidewall.sources.signatures import list_signatures, register_signatures
from tidewall.streaming.review import current_logs, outcomes, start_review
from tidewall.streaming.screening import DECIDED_SCHEMA, decisions_sink, risk_by_day_stream, screen_stream

D = "double"
LOGS, KIDS, TICKETS = oracle.EVENT_LOGS, oracle.EVENT_CHILDREN, oracle.EVENT_TICKETS


def _logs(spark, sf_dir):
    return inputs.event_logs(spark, sf_dir).drop("event_type")


# ------------------------------------------------------------------------------------------------ audit search
@query(
    "search_logs",
    f"WITH {LOGS} SELECT log_id, session_id, ts, raw_input, sanitized_input, risk, action FROM logs WHERE action = 'BLOCK' ORDER BY ts DESC, log_id LIMIT 100 OFFSET 20",
)
def search_logs(spark, sf_dir):
    return audit.search_logs(_logs(spark, sf_dir), action="BLOCK", limit=100, offset=20)


@query("search_logs_by_session", f"WITH {LOGS} SELECT log_id, ts, action FROM logs WHERE session_id = 'session-7' ORDER BY ts DESC, log_id LIMIT 100")
def search_logs_by_session(spark, sf_dir):
    return audit.search_logs(_logs(spark, sf_dir), session_id="session-7").select("log_id", "ts", "action")


@query("get_log", f"WITH {LOGS} SELECT log_id, session_id, ts, raw_input, risk, action FROM logs WHERE log_id = 42")
def get_log(spark, sf_dir):
    return audit.get_log(_logs(spark, sf_dir), 42).drop("sanitized_input")


def _tables(spark, sf_dir):
    return _logs(spark, sf_dir), inputs.event_children(spark, sf_dir), inputs.event_tickets(spark, sf_dir)


def _nested(spark, sf_dir):
    return audit.logs_with_children(*_tables(spark, sf_dir))


_NESTED = f"""{LOGS}, {KIDS}, {TICKETS},
e AS (SELECT log_id, count(*) AS n_events, string_agg(trigger_type, '|' ORDER BY position) AS types FROM evts GROUP BY log_id),
nested AS (SELECT l.*, coalesce(n_events, 0) AS n_events, coalesce(types, '') AS types, t.status FROM logs l LEFT JOIN e USING (log_id) LEFT JOIN tickets t USING (log_id))"""


@query(
    "logs_with_children",
    f"WITH {_NESTED} SELECT log_id, n_events, types, CASE WHEN status IS NULL THEN 0 ELSE 1 END AS n_approvals FROM nested",
)
def logs_with_children(spark, sf_dir):
    return _nested(spark, sf_dir).select(
        "log_id", F.size("events").cast("long").alias("n_events"), F.array_join("events.trigger_type", "|").alias("types"),
        F.size("approvals").alias("n_approvals"),
    )


@query(
    "feed_filter",
    f"""WITH {_NESTED} SELECT log_id, ts, risk, action FROM nested WHERE CAST(ts AS DATE) >= DATE '2024-01-01' AND action = 'BLOCK'
AND contains(types, 'SQL Injection Detector') AND risk >= 0.85 AND contains(lower(session_id), 'sion-1')
AND (contains(lower(raw_input), 'k') OR contains(lower(session_id), 'k') OR contains(lower(types), 'k'))
ORDER BY ts DESC, log_id LIMIT 15""",
)
def feed_filter(spark, sf_dir):
    return audit.feed(
        *_tables(spark, sf_dir), action="BLOCK", detector="SQL Injection Detector", min_risk=0.85, user="SION-1", text="K"
    ).select("log_id", "ts", "risk", "action")


@query("feed_filter_by_day", f"WITH {_NESTED} SELECT log_id, ts FROM nested WHERE CAST(ts AS DATE) = DATE '2024-01-09' ORDER BY ts DESC, log_id LIMIT 15")
def feed_filter_by_day(spark, sf_dir):
    return audit.feed(*_tables(spark, sf_dir), date="2024-01-09").select("log_id", "ts")


@query(
    "feed_columns",
    f"""WITH {LOGS}, {KIDS}, {TICKETS},
e AS (SELECT log_id, string_agg(agent_source, ', ' ORDER BY position) AS sources, string_agg(nullif(array_to_string(matched, ', '), ''), ', ' ORDER BY position) AS evidence FROM evts GROUP BY log_id)
SELECT l.log_id, 'TX-' || strftime(ts, '%Y%m%d-%H%M%S') AS tx_id, left(sha256(raw_input), 16) AS prompt_hash,
 strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS time, action AS verdict, risk, coalesce(sources, 'None') AS sources,
 coalesce(evidence, 'None') AS evidence, coalesce(t.status, 'N/A (Auto)') AS analyst_action, session_id AS user, raw_input AS preview
FROM logs l LEFT JOIN e USING (log_id) LEFT JOIN tickets t USING (log_id)""",
)
def feed_columns(spark, sf_dir):
    return audit.feed_columns(_nested(spark, sf_dir))


@query("pending_queue", f"WITH {LOGS}, {TICKETS} SELECT approval_id, log_id, status, created_at FROM tickets WHERE status = 'PENDING'")
def pending_queue(spark, sf_dir):
    return audit.pending_queue(inputs.event_tickets(spark, sf_dir)).select("approval_id", "log_id", "status", "created_at")


_DECIDED = f"""{LOGS}, {TICKETS}, {oracle.DECISIONS},
decided AS (SELECT t.approval_id, t.log_id, coalesce(r.verdict, t.status) AS status, r.reviewer_id, r.review_notes, t.created_at, r.ts AS reviewed_at
 FROM tickets t LEFT JOIN ranked r ON r.approval_id = t.approval_id AND r.rn = 1)"""


def _decided(spark, sf_dir):
    return audit.apply_decisions(inputs.event_tickets(spark, sf_dir), inputs.decisions(spark, sf_dir))


@query("apply_decisions", f"WITH {_DECIDED} SELECT * FROM decided")
def apply_decisions(spark, sf_dir):
    return _decided(spark, sf_dir)


@query(
    "rejected_decisions",
    f"""WITH {_DECIDED}
SELECT decision_id, approval_id, 'Status must be either APPROVED or REJECTED' AS error FROM decisions WHERE upper(status) NOT IN ('APPROVED', 'REJECTED')
UNION ALL SELECT decision_id, approval_id, 'Human approval ticket not found.' FROM valid WHERE approval_id NOT IN (SELECT approval_id FROM tickets)
UNION ALL SELECT r.decision_id, r.approval_id, 'This ticket has already been processed with verdict: ' || d.status || '.' FROM ranked r JOIN decided d USING (approval_id) WHERE r.rn > 1""",
)
def rejected_decisions(spark, sf_dir):
    return audit.rejected_decisions(inputs.event_tickets(spark, sf_dir), inputs.decisions(spark, sf_dir))


@query(
    "sync_verdict",
    f"""WITH {_DECIDED} SELECT l.log_id, CASE d.status WHEN 'APPROVED' THEN 'ALLOW' WHEN 'REJECTED' THEN 'BLOCK' ELSE l.action END AS action
FROM logs l LEFT JOIN decided d USING (log_id)""",
)
def sync_verdict(spark, sf_dir):
    return audit.sync_verdict(_logs(spark, sf_dir), _decided(spark, sf_dir)).select("log_id", "action")


_PRIMARY = """prim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY CASE WHEN severity_level IN ('HIGH', 'CRITICAL') THEN 0 ELSE 1 END, position) AS rn FROM evts) WHERE rn = 1)"""


@query(
    "ticket_view",
    f"""WITH {LOGS}, {KIDS}, {TICKETS}, {_PRIMARY}
SELECT t.approval_id, t.log_id, t.status, 'TX-' || strftime(t.created_at, '%Y%m%d-%H%M%S') AS tx_id, session_id AS user, risk AS composite_risk,
 coalesce(trigger_type, 'Verification Hold') AS threat_type, coalesce(agent_source, 'N/A') AS detector,
 CAST(coalesce(confidence, 0.90) AS DOUBLE) AS confidence, regexp_replace(coalesce(reason, {q(audit.HELD_TEXT)}), '<[^>]*>', ' ', 'g') AS reason
FROM tickets t JOIN logs l USING (log_id) LEFT JOIN prim p USING (log_id)""",
)
def ticket_view(spark, sf_dir):
    return audit.ticket_view(inputs.event_tickets(spark, sf_dir), _logs(spark, sf_dir), inputs.event_children(spark, sf_dir))


@query("primary_events", f"WITH {LOGS}, {KIDS}, {_PRIMARY} SELECT log_id, trigger_type, agent_source, severity_level FROM prim")
def primary_events(spark, sf_dir):
    return audit.primary_events(inputs.event_children(spark, sf_dir)).select(
        "log_id", "primary.trigger_type", "primary.agent_source", "primary.severity_level"
    )


@query(
    "cascade_delete",
    f"""WITH {LOGS}, {KIDS}, {TICKETS}, doomed AS (SELECT log_id FROM logs WHERE session_id IN ('session-1', 'session-2') OR action = 'BLOCK')
SELECT 'logs' AS part, count(*) AS n FROM logs WHERE log_id NOT IN (FROM doomed)
UNION ALL SELECT 'events', count(*) FROM evts WHERE log_id NOT IN (FROM doomed)
UNION ALL SELECT 'tickets', count(*) FROM tickets WHERE log_id NOT IN (FROM doomed)""",
)
def cascade_delete(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    doomed = logs.filter(F.col("session_id").isin("session-1", "session-2") | (F.col("action") == "BLOCK"))
    kept = audit.cascade_delete(logs, inputs.event_children(spark, sf_dir), inputs.event_tickets(spark, sf_dir), doomed)
    counts = [t.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, t in zip(("logs", "events", "tickets"), kept)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "registry_table",
    f"""WITH {LOGS} SELECT log_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS timestamp, action AS verdict,
 CAST(CAST(round(drisk, 3) AS DECIMAL(5,3)) AS VARCHAR) AS risk_score, session_id FROM logs""",
)
def registry_table(spark, sf_dir):
    return audit.registry_table(_logs(spark, sf_dir))


# ------------------------------------------------------------------------------------------------ key figures
@query(
    "kpi_totals",
    f"""WITH {LOGS}, {KIDS} SELECT (SELECT count(*) FROM logs) AS total_requests, (SELECT count(*) FROM logs WHERE action = 'BLOCK') AS blocked,
 (SELECT count(*) FROM evts WHERE agent_source = 'INJECTION') AS injection_events, (SELECT count(*) FROM evts WHERE agent_source = 'PII') AS pii_events,
 (SELECT count(*) FROM evts WHERE agent_source = 'FILE') AS file_events, (SELECT avg(risk) FROM logs) AS avg_risk""",
)
def kpi_totals(spark, sf_dir):
    return kpi.kpi_totals(_logs(spark, sf_dir), inputs.event_children(spark, sf_dir))


def _trend_row(kpi_name, now, was, more, less):
    pct = f"({now} - {was}) * 100.0 / {was}"
    return f"""SELECT {q(kpi_name)} AS kpi, CAST({was} AS DOUBLE) AS earlier, CAST({now} AS DOUBLE) AS later,
 CASE WHEN {was} = 0 THEN CASE WHEN {now} > 0 THEN '+' || {now} || ' pts' ELSE 'Stable' END
      ELSE CASE WHEN {now} >= {was} THEN '+' ELSE '' END || CAST(CAST(round(CAST({pct} AS DECIMAL(28,8)), 1) AS DECIMAL(28,1)) AS VARCHAR) || '%' END AS trend,
 CASE WHEN {now} = {was} THEN 'neutral' WHEN {now} > {was} THEN {q(more)} ELSE {q(less)} END AS direction FROM sums"""


_SUM = {"total_requests": ("lq", "l"), "blocked": ("lb", "l"), "injection_events": ("INJECTION", "e"), "pii_events": ("PII", "e"), "file_events": ("FILE", "e")}


@query(
    "kpi_trend",
    f"""WITH {LOGS}, {KIDS}, ordered AS (SELECT *, row_number() OVER (ORDER BY ts, log_id) AS rn, count(*) OVER () AS n FROM logs),
halves AS (SELECT *, rn <= n // 2 AS early FROM ordered), early_ts AS (SELECT DISTINCT ts FROM halves WHERE early),
ee AS (SELECT e.*, e.ts IN (FROM early_ts) AS early FROM evts e),
sums AS (SELECT (SELECT count(*) FROM halves WHERE early) AS lq1, (SELECT count(*) FROM halves WHERE NOT early) AS lq2,
 (SELECT count(*) FROM halves WHERE early AND action = 'BLOCK') AS lb1, (SELECT count(*) FROM halves WHERE NOT early AND action = 'BLOCK') AS lb2,
 {', '.join(f"(SELECT count(*) FROM ee WHERE {n}early AND agent_source = '{s}') AS {s}{i}" for s in kpi.SOURCES for i, n in ((1, ''), (2, 'NOT ')))},
 (SELECT avg(risk) FROM halves WHERE early) AS r1, (SELECT avg(risk) FROM halves WHERE NOT early) AS r2)
{' UNION ALL '.join(_trend_row(k, _SUM[k][0] + '2', _SUM[k][0] + '1', m, l) for k, _c, m, l in kpi.TRENDS)}
UNION ALL SELECT 'avg_risk', r1, r2, CASE WHEN r2 >= r1 THEN '+' ELSE '' END || CAST(CAST(round(CAST(r2 - r1 AS DECIMAL(28,8)), 3) AS DECIMAL(28,3)) AS VARCHAR),
 CASE WHEN abs(r2 - r1) < 0.005 THEN 'neutral' WHEN r2 > r1 THEN 'negative' ELSE 'positive' END FROM sums""",
)
def kpi_trend(spark, sf_dir):
    return kpi.kpi_trend(_logs(spark, sf_dir), inputs.event_children(spark, sf_dir))


@query("log_verdict_distribution", f"WITH {LOGS} SELECT action, count(*) AS volume FROM logs GROUP BY action")
def log_verdict_distribution(spark, sf_dir):
    return kpi.verdict_distribution(_logs(spark, sf_dir))


@query("severity_distribution", f"WITH {LOGS}, {KIDS} SELECT severity_level, count(*) AS n_events FROM evts GROUP BY severity_level")
def severity_distribution(spark, sf_dir):
    return kpi.severity_distribution(inputs.event_children(spark, sf_dir))


@query("risk_by_day", f"WITH {LOGS} SELECT CAST(ts AS DATE) AS day, avg(risk) AS mean_risk, count(*) AS n FROM logs GROUP BY ALL")
def risk_by_day(spark, sf_dir):
    return kpi.risk_by_day(_logs(spark, sf_dir))


@query(
    "threat_timeline",
    f"""WITH {LOGS}, {KIDS}, newest AS (SELECT * FROM logs WHERE action IN ('BLOCK', 'REDACTED', 'HUMAN_REVIEW') ORDER BY ts DESC, log_id LIMIT 5),
f AS (SELECT log_id, arg_min(trigger_type, position) AS first_type FROM evts GROUP BY log_id)
SELECT log_id, strftime(ts, '%b %d, %H:%M') AS time, CASE action WHEN 'BLOCK' THEN 'Execution Intercepted' ELSE 'Human Review Trigger' END AS title,
 CASE action WHEN 'BLOCK' THEN 'Jailbreak attempt blocked. Risk: ' ELSE 'Escalated file parsing check. Risk: ' END
 || CAST(CAST(round(drisk, 2) AS DECIMAL(5,2)) AS VARCHAR) || '.' || coalesce(' Reason: ' || first_type, '') AS text FROM newest LEFT JOIN f USING (log_id)""",
)
def threat_timeline(spark, sf_dir):
    return kpi.threat_timeline(_logs(spark, sf_dir), inputs.event_children(spark, sf_dir))


@query("flatten_events", f"WITH {LOGS}, {KIDS} SELECT log_id, ts, agent_source, severity_level AS severity, trigger_type FROM evts")
def flatten_events(spark, sf_dir):
    return kpi.flatten_events(_nested(spark, sf_dir))


_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '' ELSE ' noon' END"


@query("parse_ts", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) END AS parsed, event_id % 3 < 2 AS ok FROM events")
def parse_ts(spark, sf_dir):
    k = F.col("event_id") % 3
    e = inputs.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "Z").when(k == 1, "").otherwise(" noon")).alias("text"),
    )
    value, ok = kpi.parse_ts("text")
    return e.select("event_id", value.alias("parsed"), ok.alias("ok"))


# ------------------------------------------------------------------------------------------------ tool calls
_POLICY_SQL = """rules(server, enabled, tool, allowed, blocked) AS (VALUES ('files', true, 'click', true, false), ('files', true, 'read_file', true, false),
 ('files', true, 'purchase', false, true), ('web', true, 'view', true, false), ('old', false, 'signup', true, false))"""
_KEYWORDS = ("rm", "rf", "drop", "delete", "truncate", "format", "purge", "destroy")
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://"
_GUARD_SQL = f"""{oracle.TOOL_CALLS}, {_POLICY_SQL},
words AS (SELECT *, list_filter({oracle.sql_list(_KEYWORDS)}, lambda k: contains(lower(CASE WHEN json_valid(args_json) THEN
    array_to_string(list_transform(json_keys(args_json), lambda n: n || ' ' || coalesce(json_extract_string(args_json, n), '')), ' ')
    ELSE args_json END), k))[1] AS word,
  list_filter(list_transform(CASE WHEN json_valid(args_json) THEN json_keys(args_json) ELSE [] END, lambda k: CASE WHEN json_type(args_json, k) = 'VARCHAR' THEN json_extract_string(args_json, k) END),
    lambda v: v IS NOT NULL AND (contains(v, '.') OR starts_with(v, 'http://') OR starts_with(v, 'https://'))) AS args FROM calls),
hosts AS (SELECT *, list_filter(list_transform(list_transform(args, lambda v: CASE WHEN contains(v, '://') THEN v ELSE 'http://' || v END),
    lambda u: split_part(regexp_extract(u, '{_URL}([^/?#]*)', 1), ':', 1)),
    lambda h: h <> '' AND NOT (h = 'example.com' OR h LIKE '%.example.com' OR h = 'data.example.org' OR h LIKE '%.data.example.org'))[1] AS host FROM words),
denied AS (SELECT tool, min(server) AS server FROM rules WHERE blocked GROUP BY tool)"""


def _policy(spark):
    return load_policy(spark, text=inputs.POLICY_JSON)


@query(
    "tool_permission",
    f"""WITH {_GUARD_SQL} SELECT call_id, CASE WHEN d.server IS NOT NULL THEN 'Tool ''' || c.tool || ''' is explicitly blacklisted on server ''' || d.server || '''.' END AS permission_reason
FROM calls c LEFT JOIN denied d ON d.tool = c.tool""",
)
def tool_permission(spark, sf_dir):
    return guard.tool_permission(inputs.tool_calls(spark, sf_dir), _policy(spark)).select("call_id", "permission_reason")


@query("destructive_arguments", f"WITH {_GUARD_SQL} SELECT call_id, word FROM words")
def destructive_arguments(spark, sf_dir):
    calls = guard.decoded(inputs.tool_calls(spark, sf_dir))
    return calls.select("call_id", guard.destructive_keyword(_policy(spark)).alias("word"))


@query("domain_allowlist", f"WITH {_GUARD_SQL} SELECT call_id, host FROM hosts")
def domain_allowlist(spark, sf_dir):
    return inputs.tool_calls(spark, sf_dir).select(
        "call_id", guard.foreign_domain(F.col("args_json"), _policy(spark)).alias("host")
    )


@query(
    "guard_tool_calls",
    f"""WITH {_GUARD_SQL}, r AS (SELECT h.call_id, h.tool, coalesce(
 'Tool ''' || h.tool || ''' is explicitly blacklisted on server ''' || d.server || '''.',
 CASE WHEN NOT json_valid(args_json) THEN {q(guard.UNREADABLE_TEXT)} END, 'Destructive command keyword ''' || word || ''' detected in execution arguments.',
 'Network domain ''' || host || ''' is not on the firewall allowed domains list.') AS reason FROM hosts h LEFT JOIN denied d ON d.tool = h.tool)
SELECT call_id, tool, reason IS NULL AS is_allowed, coalesce(reason, {q(guard.ALLOWED_TEXT)}) AS explanation FROM r""",
)
def guard_tool_calls(spark, sf_dir):
    return guard.guard(inputs.tool_calls(spark, sf_dir), _policy(spark)).select("call_id", "tool", "is_allowed", "explanation")


@query(
    "server_tool_allowed",
    f"""WITH {_GUARD_SQL} SELECT call_id, r.server IS NOT NULL AS is_allowed FROM calls c
LEFT JOIN rules r ON r.server = c.server AND r.tool = c.tool AND r.enabled AND r.allowed AND NOT r.blocked""",
)
def server_tool_allowed(spark, sf_dir):
    return guard.server_tool_allowed(inputs.tool_calls(spark, sf_dir), _policy(spark)).select("call_id", "is_allowed")


@query(
    "server_tools_used",
    f"""WITH {_GUARD_SQL} SELECT r.server, r.tool, count(c.call_id) AS n_calls FROM rules r LEFT JOIN calls c ON c.server = r.server AND c.tool = r.tool
WHERE r.allowed GROUP BY ALL""",
)
def server_tools_used(spark, sf_dir):
    used = inputs.tool_calls(spark, sf_dir).groupBy("server", "tool").agg(F.count("*").alias("n"))
    return guard.server_tools(_policy(spark)).join(used, ["server", "tool"], "left").select(
        "server", "tool", F.coalesce("n", F.lit(0)).alias("n_calls")
    )


# ------------------------------------------------------------------------------------------------ vectors
def _vectors(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "embeddings")
    # every other place of the vector is turned around: prompts near to signatures, but not equal
    return e.select(F.col("vec_id").alias("prompt_id"), F.transform("embedding", lambda x, i: F.when(i % 16 == 3, -x).otherwise(x)).alias("embedding"))


def _signatures(spark, sf_dir):
    return inputs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signature_id"), "embedding")


_BEST = """p AS (SELECT vec_id AS prompt_id, list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 16 = 3 THEN -x ELSE x END)::DOUBLE[] AS v FROM embeddings),
s AS (SELECT vec_id AS signature_id, embedding::DOUBLE[] AS v FROM embeddings),
sims AS (SELECT prompt_id, signature_id, round(list_cosine_similarity(p.v, s.v), 10) AS sim FROM p CROSS JOIN s),
best AS (SELECT prompt_id, signature_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY sim DESC, signature_id) AS rn FROM sims) WHERE rn = 1)"""
_MATCH_SQL = f"WITH {_BEST} SELECT prompt_id, signature_id, round(sim, 6) AS similarity FROM best"


@query("match_signatures", _MATCH_SQL)
def match_signatures_query(spark, sf_dir):
    m = match_signatures(_vectors(spark, sf_dir), _signatures(spark, sf_dir))
    return m.withColumn("similarity", F.round("similarity", 6))


@query("match_signatures_in_cells", _MATCH_SQL)
def match_signatures_in_cells(spark, sf_dir):
    """The same over many matrix files."""
    m = match_signatures(_vectors(spark, sf_dir), _signatures(spark, sf_dir), matrix_bytes=64_000)
    return m.withColumn("similarity", F.round("similarity", 6))


@query(
    "cosine_and_fit",
    """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS cosine,
 round(list_sum(embedding[1:48]::DOUBLE[]), 6) AS cut_sum, round(list_sum(embedding::DOUBLE[]), 6) AS padded_sum, 80 AS padded_size FROM embeddings""",
)
def cosine_and_fit(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "embeddings")

    def total(v):
        return F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6)

    return e.select(
        "vec_id", F.round(cosine("embedding", F.reverse("embedding")), 6).alias("cosine"),
        total(fit_dim("embedding", 48)).alias("cut_sum"), total(fit_dim("embedding", 80)).alias("padded_sum"),
        F.size(fit_dim("embedding", 80)).alias("padded_size"),
    )


@query(
    "hybrid_override",
    f"""WITH {CLASSIFIER_SQL}, {_BEST},
j AS (SELECT t.*, b.sim, b.sim > 0.85 AS near, b.signature_id FROM threats t LEFT JOIN best b USING (prompt_id))
SELECT prompt_id, is_injection OR coalesce(near, false) AS is_injection, CASE WHEN near THEN greatest(risk_score, 0.98) ELSE risk_score END AS risk_score,
 CASE WHEN near THEN 'JAILBREAK' ELSE threat_type END AS threat_type, CASE WHEN near THEN 'CRITICAL' ELSE severity END AS severity,
 array_to_string(CASE WHEN near THEN list_append(findings, 'VECTOR_SIGNATURE_MATCH') ELSE findings END, '|') AS findings,
 CASE WHEN near THEN 'signature ' || signature_id END AS matched_pattern FROM j""",
)
def hybrid_override_query(spark, sf_dir):
    m = match_signatures(_vectors(spark, sf_dir), _signatures(spark, sf_dir)).withColumn(
        "pattern", F.concat(F.lit("signature "), F.col("signature_id").cast("string"))
    )
    t = classify_threat(inputs.prompts(spark, sf_dir), "prompt").select("prompt_id", "threat")
    out = hybrid_override(t.join(m, "prompt_id", "left")).select("prompt_id", "threat.*")
    return out.select(
        "prompt_id", "is_injection", F.col("risk_score").cast(D).alias("risk_score"), "threat_type", "severity",
        F.array_join("findings", "|").alias("findings"), "matched_pattern",
    )


_CANDIDATES = """cand AS (SELECT vec_id AS signature_id, CASE WHEN vec_id % 7 = 0 THEN '' ELSE 'pattern ' || vec_id END AS pattern,
 CASE WHEN vec_id % 5 = 0 THEN embedding[1:60] ELSE embedding END AS embedding, TIMESTAMP '2024-01-01' + to_minutes(vec_id % 97) AS added_at FROM embeddings)"""


def _candidates(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    return e.select(
        v.alias("signature_id"), F.when(v % 7 == 0, "").otherwise(F.concat(F.lit("pattern "), v.cast("string"))).alias("pattern"),
        F.when(v % 5 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("embedding"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(v % 97).cast("int"))).alias("added_at"),
    )


@query(
    "register_signatures",
    f"""WITH {_CANDIDATES} SELECT signature_id, CASE WHEN pattern = '' THEN 'Signature text is empty.'
 WHEN len(embedding) <> 64 THEN 'Vector embedding must contain exactly 64 float dimensions.' ELSE 'accepted' END AS outcome FROM cand""",
)
def register_signatures_query(spark, sf_dir):
    good, bad = register_signatures(_candidates(spark, sf_dir), dim=64)
    return good.select("signature_id", F.lit("accepted").alias("outcome")).unionByName(bad.select("signature_id", F.col("error").alias("outcome")))


@query("list_signatures", f"WITH {_CANDIDATES} SELECT signature_id, pattern, added_at FROM cand")
def list_signatures_query(spark, sf_dir):
    return list_signatures(_candidates(spark, sf_dir))


# ------------------------------------------------------------------------------------------------ attachments
def _scan_query(detector):
    def run(spark, sf_dir):
        return files.scan_files(inputs.files(spark, sf_dir), "content", "file_name", detector).select(
            "file_id", F.array_join("labels", "|").alias("labels"), F.col("score").cast(D).alias("score"),
            F.col("confidence").cast(D).alias("confidence"),
        )

    return run


for _d, _unnamed in ((fixed.MALWARE, "unnamed"), (fixed.SANDBOX, "document")):
    query(
        f"{_d.key}_scan",
        f"""WITH {oracle.file_scan(_d, _unnamed)} SELECT file_id, array_to_string(lab_{_d.key}, '|') AS labels,
 CAST(s_{_d.key} AS DOUBLE) AS score, CAST(c_{_d.key} AS DOUBLE) AS confidence FROM scans""",
    )(_scan_query(_d))

_TEXT_EXT = "('.txt', '.json', '.xml', '.csv')"


@query(
    "file_text_and_type",
    f"""WITH {oracle.FILE_FACTS} SELECT file_id, ext, CASE WHEN ext IN {_TEXT_EXT} THEN txt ELSE '' END AS text, sha256(content) AS sha256,
 CASE WHEN contains(file_name, '.') THEN upper(string_split(file_name, '.')[-1]) ELSE 'BINARY' END || ' Document' AS file_type FROM labelled""",
)
def file_text_and_type(spark, sf_dir):
    return inputs.files(spark, sf_dir).select(
        "file_id", files.file_ext("file_name").alias("ext"), files.sandbox_text("content", "file_name").alias("text"),
        F.sha2("content", 256).alias("sha256"), files.file_type("file_name").alias("file_type"),
    )


_GATE_SQL = f"""{oracle.FILE_FACTS}, th AS (SELECT *, list_filter([
 CASE WHEN blocked THEN 'MALWARE_EXTENSION: Extension ''' || ext || ''' is explicitly blocked by safety policy.' END,
 CASE WHEN mz THEN 'Executable Payload (MZ Header Detected)' END,
 CASE WHEN mismatch AND ext = '.pdf' THEN 'Mismatched MIME Type: Declared PDF, missing standard header magic bytes' END,
 CASE WHEN mismatch AND ext <> '.pdf' THEN 'Mismatched MIME Type: Declared Office Document, missing ZIP container magic bytes' END,
 CASE WHEN macro THEN 'YARA Alert: OfficeMacroTrigger matched.' END, CASE WHEN pe THEN 'YARA Alert: ExecutableInDocument matched.' END,
 CASE WHEN pdf_active THEN 'YARA Alert: PDFMaliciousTriggers matched.' END,
 CASE WHEN NOT macro AND entries > 0 THEN 'YARA Alert: OfficeMacroTrigger matched. (Container scan)' END], lambda x: x IS NOT NULL) AS before FROM labelled),
gates AS (SELECT *, CASE WHEN len(before) = 0 AND corrupt THEN ['DOCUMENT_PARSE_FAILURE: Corrupted document structure or parser error.'] ELSE before END AS threats FROM th)"""


@query(
    "file_gate",
    f"""WITH {_GATE_SQL} SELECT file_id, len(threats) = 0 AS is_safe, array_to_string(threats, '; ') AS threats,
 CASE WHEN len(threats) = 0 THEN CASE WHEN ext IN {_TEXT_EXT} THEN txt ELSE '' END END AS extracted_text FROM gates""",
)
def file_gate(spark, sf_dir):
    return files.file_gate(inputs.files(spark, sf_dir), "content", "file_name").select(
        "file_id", "is_safe", F.array_join("threats", "; ").alias("threats"), "extracted_text"
    )


def _file_requests(spark, sf_dir):
    return inputs.files(spark, sf_dir).withColumn("prompt", F.concat(F.lit("Please read "), F.col("file_name")))


def _screened_files_sql():
    base = oracle.file_scan(fixed.MALWARE, "unnamed").replace("scans AS", "mal AS").replace("captions AS", "mcap AS").replace("FROM captions", "FROM mcap").replace("feat AS", "mfeat AS").replace("FROM feat", "FROM mfeat")
    s, c = oracle.scores("lab_sandbox", fixed.SANDBOX, zero=True)
    prompts = f"prompts AS (SELECT file_id, file_id AS prompt_id, 'Please read ' || file_name || CASE WHEN ext IN {_TEXT_EXT} AND txt <> '' THEN chr(10) || chr(10) || '[Attached File: ' || file_name || ']' || chr(10) || txt ELSE '' END AS prompt FROM labelled)"
    body = oracle.screened(prompts)
    body = body.replace("CAST([] AS VARCHAR[]) AS lab_malware,\n         CAST([] AS VARCHAR[]) AS lab_sandbox\n         FROM feat JOIN redacted USING (prompt_id)", "lab_malware, lab_sandbox, s_malware, c_malware, s_sandbox, c_sandbox, size, file_name, content\n         FROM feat JOIN redacted USING (prompt_id) JOIN fscore USING (file_id)")
    for d in ("malware", "sandbox"):
        body = body.replace(f", CAST(0 AS DECIMAL(9,4)) AS s_{d}, CAST(1 AS DECIMAL(9,4)) AS c_{d}", "")
    return f"""{base}, fscore AS (SELECT file_id, lab_malware, lab_sandbox, s_malware, c_malware, {s} AS s_sandbox, {c} AS c_sandbox, size, file_name, content FROM mal),
{body}"""


_SCREENED_FILES = _screened_files_sql()


@query(
    "screen_attachments",
    f"""WITH {_SCREENED_FILES} SELECT file_id, CAST(risk AS DOUBLE) AS risk, action, array_to_string(findings, '|') AS findings,
 CAST(s_malware AS DOUBLE) AS malware_score, CAST(s_sandbox AS DOUBLE) AS sandbox_score FROM screened""",
)
def screen_attachments(spark, sf_dir):
    s = risk.screen(_file_requests(spark, sf_dir), content="content", file_name="file_name")
    return s.select(
        "file_id", F.col("risk").cast(D).alias("risk"), "action", F.array_join("findings", "|").alias("findings"),
        F.col("results")[8]["score"].cast(D).alias("malware_score"), F.col("results")[9]["score"].cast(D).alias("sandbox_score"),
    )


@query(
    "file_report",
    f"""WITH {_SCREENED_FILES}, x AS (SELECT *, list_contains(lab_malware, 'EMBEDDED_PE_HEADER') OR list_contains(lab_malware, 'ELF_BINARY_HEADER') AS exe,
 list_contains(lab_malware, 'MALWARE_EXTENSION') AS blk, list_contains(lab_sandbox, 'VBA_MACRO_ARCHIVE') OR list_contains(lab_malware, 'YARA_OFFICEMACROTRIGGER') AS mac,
 list_contains(lab_malware, 'YARA_PDFMALICIOUSTRIGGERS') AS scr, list_contains(lab_command, 'COMMAND_INJECTION_TRIGGER') OR list_contains(lab_command, 'REVERSE_SHELL_PAYLOAD') AS shl,
 list_contains(lab_sandbox, 'PARSER_STRUCTURE_CORRUPTION') AS cor,
 list_filter([CASE WHEN list_contains(lab_sensitive, 'EMAIL_ADDRESS') THEN '1 email address(es)' END, CASE WHEN list_contains(lab_sensitive, 'PHONE_NUMBER') THEN '1 phone number(s)' END,
   CASE WHEN len(list_filter(lab_sensitive, lambda k: regexp_matches(k, 'API_KEY|TOKEN|SECRET'))) > 0 THEN len(list_filter(lab_sensitive, lambda k: regexp_matches(k, 'API_KEY|TOKEN|SECRET'))) || ' API credentials' END], lambda k: k IS NOT NULL) AS det FROM screened)
SELECT file_id, file_name, CASE WHEN size / 1024.0 < 1024 THEN CAST(CAST(round(CAST(size / 1024.0 AS DECIMAL(28,8)), 2) AS DECIMAL(28,2)) AS VARCHAR) || ' KB' ELSE 'large' END AS file_size,
 CASE WHEN contains(file_name, '.') THEN upper(string_split(file_name, '.')[-1]) ELSE 'BINARY' END || ' Document' AS file_type, sha256(content) AS sha256,
 CASE WHEN exe THEN 'Malware detected (executable headers)' WHEN blk THEN 'Malware detected (blocked extension)' ELSE 'Safe' END AS malware_status,
 CASE WHEN mac THEN 'Macro detected' ELSE 'No macros' END AS macro_status,
 CASE WHEN scr THEN 'Suspicious JavaScript' WHEN shl THEN 'Hidden PowerShell' WHEN exe OR blk THEN 'Embedded executable' ELSE 'No malware' END AS script_status,
 CASE WHEN cor THEN 'Parser structures corrupted' ELSE 'Metadata clean' END AS metadata_status,
 CASE WHEN s_sensitive > 0.10 THEN CASE WHEN len(det) > 0 THEN array_to_string(det, ', ') ELSE len(lab_sensitive) || ' sensitive fields' END || ' detected' ELSE 'No private disclosures identified' END AS sensitive_status,
 exe OR blk OR mac OR scr OR shl OR cor AS is_malicious FROM x""",
)
def file_report(spark, sf_dir):
    scored = risk.with_scores(_file_requests(spark, sf_dir), content="content", file_name="file_name")
    return files.file_report(scored, "file_id", "content", "file_name")


# ------------------------------------------------------------------------------------------------ streams
def _scratch(spark) -> str:
    return shared_folder(spark, "stream")


def _run_stream(spark, stream, mode="append"):
    """Run a stream over what is there now, through a Parquet table."""
    folder = _scratch(spark)
    (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _read_stream(spark, sf_dir, name):
    schema = inputs.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(
    "screen_stream",
    f"WITH {oracle.screened(oracle.PROMPTS.replace(oracle.LINES_SQL, '[NULL]').replace(f'% {inputs.LINE_STEP}', '% 1'))} SELECT prompt_id, CAST(risk AS DOUBLE) AS risk, action FROM screened",
)
def screen_stream_query(spark, sf_dir):
    docs = _read_stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
    out = screen_stream(docs).select("prompt_id", F.col("risk").cast(D).alias("risk"), "action")
    return _run_stream(spark, out)


@query("decisions_stream", f"WITH {oracle.DECISIONS} SELECT approval_id, decision_id, verdict AS status, reviewer_id FROM ranked WHERE rn = 1")
def decisions_stream(spark, sf_dir):
    events = _read_stream(spark, sf_dir, "events")
    folder = _scratch(spark)
    decisions = inputs.as_decisions(events).withColumn("ts", F.col("ts").cast("timestamp"))
    decisions_sink(decisions, f"{folder}/rows", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(DECIDED_SCHEMA).parquet(f"{folder}/rows").select("approval_id", "decision_id", "status", "reviewer_id")


def _reviewed(spark, sf_dir):
    """(tickets, folder of outcomes) of the events as decisions, streamed against the tickets of the logs."""
    tickets, folder = inputs.event_tickets(spark, sf_dir), _scratch(spark)
    decisions = inputs.as_decisions(_read_stream(spark, sf_dir, "events"))
    start_review(
        decisions, tickets, f"{folder}/rows", f"{folder}/state", partitions=spark.sparkContext.defaultParallelism, availableNow=True
    ).awaitTermination()
    return tickets, f"{folder}/rows"


@query(
    "review_stream",
    f"""WITH {_DECIDED}
SELECT decision_id, approval_id, CAST(NULL AS VARCHAR) AS status, 'Status must be either APPROVED or REJECTED' AS error FROM decisions WHERE upper(status) NOT IN ('APPROVED', 'REJECTED')
UNION ALL SELECT decision_id, approval_id, NULL, 'Human approval ticket not found.' FROM valid WHERE approval_id NOT IN (SELECT approval_id FROM tickets)
UNION ALL SELECT r.decision_id, r.approval_id, NULL, 'This ticket has already been processed with verdict: ' || d.status || '.' FROM ranked r JOIN decided d USING (approval_id) WHERE r.rn > 1
UNION ALL SELECT r.decision_id, r.approval_id, r.verdict, NULL FROM ranked r JOIN tickets USING (approval_id) WHERE r.rn = 1""",
)
def review_stream(spark, sf_dir):
    """Every decision of the stream: the ticket that it decided, or why it changed nothing."""
    return outcomes(spark, *_reviewed(spark, sf_dir)).select("decision_id", "approval_id", "status", "error")


@query(
    "review_stream_logs",
    f"""WITH {_DECIDED} SELECT l.log_id, CASE d.status WHEN 'APPROVED' THEN 'ALLOW' WHEN 'REJECTED' THEN 'BLOCK' ELSE l.action END AS action
FROM logs l LEFT JOIN decided d USING (log_id)""",
)
def review_stream_logs(spark, sf_dir):
    """Logs after the stream of decisions."""
    return current_logs(_logs(spark, sf_dir), *_reviewed(spark, sf_dir)).select("log_id", "action")


@query("risk_by_day_stream", f"WITH {LOGS} SELECT CAST(ts AS DATE) AS day, avg(risk) AS mean_risk, count(*) AS n FROM logs GROUP BY ALL")
def risk_by_day_stream_query(spark, sf_dir):
    rows = _read_stream(spark, sf_dir, "events").select(
        F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp").alias("ts"),
        ((F.round(F.col("value") * 100).cast("long") % 10000) / 10000).alias("risk")
    )
    # complete mode: the days so far, open ones included, replace the table at every batch
    out, folder = risk_by_day_stream(rows), _scratch(spark)
    (
        out.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state")
        .foreachBatch(lambda days, _: days.write.mode("overwrite").parquet(f"{folder}/rows"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
