"""SQL for DuckDB that states the same results as the registered queries, written from their definitions.

Patterns and other fixed values come from the shared tables; everything else (features, scores, folds, joins) is
written here a second time, in SQL, with DECIMAL arithmetic instead of scaled integers.
"""

from __future__ import annotations

from tidewall import fixed
from tidewall.plans import inputs

SPACES = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(values, quote=True) -> str:
    return "[" + ", ".join(q(v) if quote else str(v) for v in values) + "]"


def re2(pattern: str) -> str:
    """Pattern for RE2.

    Texts have their accented letters replaced by an ASCII word character first, so word classes agree; white space
    is widened; `HEAD\\b.*\\bTAIL` needs no change.  Back-references are spelled out per quote kind.
    """
    if r"\1" in pattern:
        whole = []
        for quote in ("'", '"'):
            whole.append(pattern.replace(r"('|\")", quote, 1).replace(r"\1", quote))
        pattern = "|".join(whole)
    if r"\2" in pattern:
        head, _, tail = pattern.partition(r"('|\")")
        first, second, rest = head, r"('|\")?", tail[len(r"\s*(?:or|and)\s*") + len(r"('|\")?"):]
        middle = r"\s*(?:or|and)\s*"
        options = [rest.replace(r"\2?", "")] + [quote + rest.replace(r"\2", quote) for quote in ("'", '"')]
        pattern = "['\"]" + middle + "(?:" + "|".join(options) + ")"
    return pattern.replace(r"\s", SPACES)


LINES_SQL = sql_list(inputs.LINES)
PROMPTS = f"""
prompts AS (
  SELECT doc_id AS prompt_id, source AS session_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 37 AS BIGINT)) AS ts,
         concat_ws(chr(10), text, {LINES_SQL}[doc_id % {inputs.LINE_STEP} + 1]) AS prompt, lang
  FROM documents
)"""
SHORT_PROMPTS = f"""
prompts AS (
  SELECT o_orderkey AS prompt_id,
         CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || ' ' ELSE '' END
         || {sql_list(inputs.SHORT_LINES)}[o_orderkey % {len(inputs.SHORT_LINES)} + 1] AS prompt
  FROM orders
)"""


def char_sum(text: str) -> str:
    return (
        f"CAST(coalesce(list_sum(list_transform(string_split(regexp_replace({text}, '{SPACES}', '', 'g'), ''), "
        "lambda c: CASE WHEN c = '' THEN 0 ELSE unicode(c) END)), 0) AS BIGINT)"
    )


def features(source: str, text: str = "prompt", name: str = "feat") -> str:
    return rf"""
{name} AS (
  SELECT *, length({text}) AS chars, lower({text}) AS low,
         regexp_replace(regexp_replace({text}, '[^\x00-\x7F\P{{L}}]', '_', 'g'), '[^\x00-\x7F\P{{N}}]', '_', 'g') AS plain,
         regexp_replace(regexp_replace(lower({text}), '[^\x00-\x7F\P{{L}}]', '_', 'g'), '[^\x00-\x7F\P{{N}}]', '_', 'g') AS plain_low,
         length(regexp_replace({text}, '[\p{{L}}\p{{N}}\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}]', '', 'g')) AS symbols,
         {char_sum(text)} AS sum_raw, {char_sum(f'lower({text})')} AS sum_low,
         regexp_replace(lower({text}), '{SPACES}', '', 'g') AS squashed
  FROM {source}
)"""


def label_list(detector: fixed.Detector) -> str:
    """SQL list of the labels of a rule detector."""
    cases = []
    for family in detector.families:
        text, flag = {
            "any": ("plain", "(?i)"), "lower": ("plain_low", "(?i)"),
            "lower_raw": ("plain_low", ""), "raw": ("plain", ""),
        }[family.text]
        for pattern in family.patterns:
            hit = f"regexp_matches({text}, {q(flag + re2(pattern))})"
            if family.label == "REVERSE_SHELL_PAYLOAD":
                hit = f"(contains(low, {q(fixed.REVERSE_SHELL_LITERAL)}) OR {hit})"
            cases.append(f"CASE WHEN {hit} THEN {q(family.label)} END")
        for keyword in family.keywords:
            cases.append(f"CASE WHEN contains(low, {q(keyword)}) THEN {q(family.keyword_label + ':' + keyword)} END")
    return "list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL)"


def clean_score() -> str:
    return (
        "round(least(0.19, 0.01 + least(0.02, 0.002 * symbols) + least(0.02, 0.00005 * chars) "
        "+ 0.001 * (sum_raw % 11)), 4)"
    )


def override_case(column: int, base: str) -> str:
    rows = []
    for texts, limit, score, confidence in fixed.SCORE_OVERRIDES:
        found = " OR ".join(f"contains(squashed, {q(t)})" for t in texts)
        rows.append(f"WHEN {found} THEN CASE WHEN length(squashed) < {limit} THEN {(score, confidence)[column]} ELSE {base} END")
    return "CASE " + " ".join(rows) + f" ELSE {base} END"


def hit_confidence(labels: str) -> str:
    return f"(0.85 + least(0.08, len({labels}) * 0.02) + (sum_low % 7) * 0.01)"


def hit_score(labels: str, detector: fixed.Detector) -> str:
    weights = " ".join(f"WHEN {q(k)} THEN {w}" for k, w in detector.weights.items())
    top = f"list_max(list_transform({labels}, lambda x: CASE x {weights} ELSE {detector.default_weight} END))"
    raw = (
        f"0.6 * {top} + 0.4 * {fixed.SEVERITY_VALUE[detector.severity]} + least(0.04, symbols * 0.003) "
        f"+ least(0.04, chars * 0.0001) + 0.01 * {hit_confidence(labels)} + (sum_low % 100) * 0.0002 "
        f"+ least(0.06, (len({labels}) - 1) * 0.02)"
    )
    return f"round(greatest(0.0000, least(1.0000, {raw})), 2)"


def scores(labels: str, detector: fixed.Detector, zero: bool = False) -> tuple[str, str]:
    """(score, confidence) as DECIMAL(9,4) expressions."""
    clean, sure = ("0", "1") if zero else (clean_score(), "0.88 + (sum_raw % 10) * 0.01")
    return (
        f"CAST(CASE WHEN chars = 0 THEN 0 WHEN len({labels}) > 0 THEN {override_case(0, hit_score(labels, detector))} "
        f"ELSE {clean} END AS DECIMAL(9,4))",
        f"CAST(CASE WHEN chars = 0 THEN 1 WHEN len({labels}) > 0 THEN {override_case(1, hit_confidence(labels))} "
        f"ELSE {sure} END AS DECIMAL(9,4))",
    )


def redaction(source: str, text: str, steps, keep: str, name: str = "redacted") -> str:
    """CTEs for sequential masking: text after each step in t<n>, hits in f<n>."""
    ctes = [f"r0 AS (SELECT {keep}, {text} AS original, {text} AS t FROM {source})"]
    n, flags = 0, []
    for label, mask, patterns, how in steps:
        step_flags = []
        for pattern in patterns if how != "whole" else ("",):
            rx = re2(pattern)
            if how == "mask":
                hit, new = f"regexp_matches(t, {q(rx)})", f"regexp_replace(t, {q(rx)}, {q(mask)}, 'g')"
            elif how == "value":
                rx = "(?i)" + rx
                hit = f"regexp_matches(t, {q(rx)})"
                new = (
                    f"list_reduce(list_prepend(t, regexp_extract_all(t, {q(rx)}, 1)), "
                    f"lambda a, v: replace(a, v, {q(mask)}))"
                )
            elif how == "ident":
                hit = f"contains(lower(original), 'passport') AND regexp_matches(original, {q(rx)})"
                new = (
                    f"CASE WHEN {hit} THEN list_reduce(list_prepend(t, list_filter(regexp_extract_all(t, {q(rx)}), "
                    f"lambda v: regexp_matches(v, '[0-9]'))), lambda a, v: replace(a, v, {q(mask)})) ELSE t END"
                )
            else:
                hit = " OR ".join(f"contains(lower(original), {q(p)})" for p in patterns)
                new = f"CASE WHEN {hit} THEN {q(mask)} ELSE t END"
            n += 1
            step_flags.append(f"f{n}")
            prior = "".join(f", f{i}" for i in range(1, n))
            ctes.append(f"r{n} AS (SELECT {keep}, original{prior}, {new} AS t, {hit} AS f{n} FROM r{n - 1})")
        flags.append(f"CASE WHEN {' OR '.join(step_flags)} THEN {q(label)} END")
    ctes.append(
        f"{name} AS (SELECT {keep}, t AS masked, list_filter([{', '.join(flags)}], lambda x: x IS NOT NULL) AS entities FROM r{n})"
    )
    return ",\n".join(ctes)


def detector_query(detector: fixed.Detector, prompts: str = PROMPTS) -> str:
    score, confidence = scores("labels", detector)
    return f"""WITH {prompts}, {features('prompts')},
hits AS (SELECT *, {label_list(detector)} AS labels FROM feat)
SELECT prompt_id, array_to_string(labels, '|') AS labels, CAST(len(labels) AS BIGINT) AS n_labels,
       CAST({score} AS DOUBLE) AS score, CAST({confidence} AS DOUBLE) AS confidence
FROM hits"""


def sensitive_query() -> str:
    score, confidence = scores("entities", fixed.SENSITIVE, zero=True)
    return f"""WITH {PROMPTS}, {features('prompts')},
{redaction('prompts', 'prompt', fixed.REDACTION, 'prompt_id')}
SELECT prompt_id, array_to_string(entities, '|') AS labels, CAST(len(entities) AS BIGINT) AS n_labels,
       CAST({score} AS DOUBLE) AS score, CAST({confidence} AS DOUBLE) AS confidence
FROM feat JOIN redacted USING (prompt_id)"""


# ------------------------------------------------------------------------------------------------ screening
TEXT_KEYS = [d for d in fixed.DETECTORS if d not in (fixed.MALWARE, fixed.SANDBOX)]


def screened(prompts: str = PROMPTS, reasons: bool = False) -> str:
    """CTEs ending in `screened`: one row per prompt with the ten results, risk, action, reasoning and findings."""
    label_cols = ", ".join(f"{label_list(d)} AS lab_{d.key}" for d in fixed.TEXT_RULE_DETECTORS)
    parts = []
    for d in TEXT_KEYS:
        s, c = scores(f"lab_{d.key}", d, zero=d is fixed.SENSITIVE)
        parts += [f"{s} AS s_{d.key}", f"{c} AS c_{d.key}"]
    for d in (fixed.MALWARE, fixed.SANDBOX):
        parts += [f"CAST(0 AS DECIMAL(9,4)) AS s_{d.key}", f"CAST(1 AS DECIMAL(9,4)) AS c_{d.key}"]
    return f"""{prompts}, {features('prompts')},
{redaction('prompts', 'prompt', fixed.REDACTION, 'prompt_id')},
hits AS MATERIALIZED (SELECT feat.*, masked, entities AS lab_sensitive, {label_cols}, CAST([] AS VARCHAR[]) AS lab_malware,
         CAST([] AS VARCHAR[]) AS lab_sandbox
         FROM feat JOIN redacted USING (prompt_id)),
scored AS MATERIALIZED (SELECT *, {', '.join(parts)} FROM hits),
{composite('scored', reasons)}"""


def composite(source: str, reasons: bool) -> str:
    keys = fixed.DETECTORS
    top = "greatest(" + ", ".join(f"s_{d.key}" for d in keys) + ")"
    total = sum(float(fixed.RISK_WEIGHTS[d.display]) for d in keys)
    mean = "(" + " + ".join(f"s_{d.key} * {fixed.RISK_WEIGHTS[d.display]}" for d in keys) + ")"
    triggered = "(" + " + ".join(f"CAST(s_{d.key} > 0.10 AS INT)" for d in keys) + ")"
    found = "flatten([" + ", ".join(
        f"CASE WHEN s_{d.key} > 0.10 THEN lab_{d.key} ELSE CAST([] AS VARCHAR[]) END" for d in keys
    ) + "])"
    texts = "".join(f", {described('lab_' + d.key)} AS d_{d.key}" for d in keys) if reasons else ""
    v = fixed.VERDICTS
    rows = [
        f"{{'detector': {q(d.display)}, 'score': s_{d.key}, 'confidence': c_{d.key}, 'matched': lab_{d.key}, 'reason': {reason_case(d) if reasons else q('')}}}"
        for d in keys
    ]
    assert abs(total - 2.0) < 1e-9
    case = lambda i: "CASE " + " ".join(f"WHEN risk >= {r[0]} THEN {q(r[i])}" for r in v[:-1]) + f" ELSE {q(v[-1][i])} END"
    return f"""parts AS MATERIALIZED (SELECT *, {top} AS top, CAST({mean} AS DECIMAL(18,6)) AS weighted, {triggered} AS triggered,
                 {found} AS found{texts} FROM {source}),
risks AS MATERIALIZED (SELECT *, CASE WHEN top > 0 THEN CAST(least(1.0, round(
            CAST(top AS DECIMAL(38,16)) + CAST((1 - top) * (weighted * 0.5) AS DECIMAL(30,14)) * (CASE WHEN triggered > 0 THEN 0.20 ELSE 0.18 END)
            + (len(found) % 100) * 0.0002, 4)) AS DECIMAL(9,4)) ELSE CAST(0 AS DECIMAL(9,4)) END AS risk FROM parts),
screened AS MATERIALIZED (SELECT *, {case(1)} AS action, {case(2)} AS severity,
            replace({case(3)}, '%s', CAST(CAST(round(risk, 2) AS DECIMAL(5,2)) AS VARCHAR)) AS reasoning,
            list_sort(list_distinct(found)) AS findings,
            [{', '.join(rows)}] AS results
            FROM risks)"""


def described(labels: str) -> str:
    """SQL list of the texts of labels, with repeats."""
    texts = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.LABEL_TEXT.items())
    name = "string_split(x, ':')[1]"
    return f"list_transform({labels}, lambda x: CASE {name} {texts} ELSE 'Signature match (' || {name} || ')' END)"


def reason_text(texts: str, detector: fixed.Detector) -> str:
    """Reason of a detector from a list of label texts."""
    distinct = f"list_filter({texts}, lambda x, i: list_position({texts}, x) = i)"
    return f"'Detected {detector.title} indicators: ' || array_to_string({distinct}, ', ') || '.'"


def reason_case(detector: fixed.Detector) -> str:
    from tidewall.functions.scoring import CLEAN_REASONS

    clean = CLEAN_REASONS.get(detector.key, f"No threat signatures triggered for {detector.title}.")
    empty = "" if detector in (fixed.MALWARE, fixed.SANDBOX) else "WHEN chars = 0 THEN 'Empty prompt.' "
    return f"CASE {empty}WHEN len(lab_{detector.key}) > 0 THEN {reason_text('d_' + detector.key, detector)} ELSE {q(clean)} END"


# ------------------------------------------------------------------------------------------------ log tables
def verdict_case(risk: str, i: int = 1) -> str:
    v = fixed.VERDICTS
    return "CASE " + " ".join(f"WHEN {risk} >= {r[0]} THEN {q(r[i])}" for r in v[:-1]) + f" ELSE {q(v[-1][i])} END"


def severity_case(score: str) -> str:
    rows = " ".join(f"WHEN {score} > {a} THEN {q(s)}" for a, s in fixed.EVENT_SEVERITIES)
    return f"CASE {rows} ELSE 'LOW' END"


def _event_case(which: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN {q(k)} THEN {q(v[which])}" for k, v in inputs.EVENT_MAP.items()) + " END"


EVENT_LOGS = f"""
ev AS (SELECT *, CAST(round(value * 100) AS BIGINT) % 10000 AS bp FROM events),
logs AS (SELECT event_id AS log_id, 'session-' || user_id AS session_id, ts, props AS raw_input,
                CASE WHEN bp < 8100 THEN props END AS sanitized_input, CAST(bp AS DOUBLE) / 10000 AS risk,
                CAST(bp AS DECIMAL(9,4)) * 0.0001 AS drisk,
                {verdict_case('CAST(bp AS DECIMAL(9,4)) * 0.0001')} AS action, event_type FROM ev)"""
EVENT_CHILDREN = f"""
evts AS (
  SELECT log_id, ts, 0 AS position, {_event_case(0)} AS agent_source, {_event_case(1)} AS trigger_type,
         {severity_case('drisk')} AS severity_level, 0.90 AS confidence, '<b>Matched</b> ' || event_type AS reason,
         [upper(event_type)] AS matched, drisk AS score FROM logs WHERE drisk > 0.10
  UNION ALL
  SELECT log_id, ts, 11, 'RISK_SCORE', 'GATEWAY_POLICY_ENFORCEMENT', {severity_case('drisk')}, 0.90, 'Policy',
         CAST([] AS VARCHAR[]), drisk FROM logs WHERE action <> 'ALLOW')"""
EVENT_TICKETS = "tickets AS (SELECT log_id AS approval_id, log_id, 'PENDING' AS status, ts AS created_at FROM logs WHERE action = 'HUMAN_REVIEW')"
DECISIONS = f"""
decisions AS (SELECT event_id AS decision_id, event_id - event_id % 3 AS approval_id,
              {sql_list(inputs.STATUSES)}[event_id % 4 + 1] AS status, 'rev-' || user_id AS reviewer_id,
              event_type AS review_notes, ts FROM events),
valid AS (SELECT *, upper(status) AS verdict FROM decisions WHERE upper(status) IN ('APPROVED', 'REJECTED')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY approval_id ORDER BY ts, decision_id) AS rn FROM valid)"""
TOOL_CALLS = f"""
calls AS (SELECT event_id AS call_id, {sql_list(inputs.SERVERS)}[user_id % 4 + 1] AS server,
          CASE WHEN event_type = 'error' THEN 'unlisted' ELSE event_type END AS tool,
          replace(props, '}}', ', ' || {sql_list(inputs.ARGUMENTS)}[event_id % {len(inputs.ARGUMENTS)} + 1] || '}}') AS args_json
          FROM events)"""
FILES = f"""
files AS (SELECT page_id AS file_id,
          'page ' || page_id || {sql_list([k[0] for k in inputs.FILE_KINDS])}[page_id % {inputs.FILE_STEP} + 1] AS file_name,
          unhex({sql_list([k[1] for k in inputs.FILE_KINDS])}[page_id % {inputs.FILE_STEP} + 1]) || encode(html)
          || unhex({sql_list([k[2].encode().hex() for k in inputs.FILE_KINDS])}[page_id % {inputs.FILE_STEP} + 1]) AS content
          FROM pages)"""


def _wide(s: str) -> str:
    return "".join(("\\" + c if c in "/_" else c) + r"\x00" for c in s)


def _byte_rule(strings, flag="") -> str:
    return q(flag + "|".join([s for s in strings] + [_wide(s).replace("\\_", "_").replace("\\/", "/") for s in strings]))


_HEXDIGIT = "(strpos('0123456789ABCDEF', substr(hx, {p}, 1)) - 1)"


def _dword_sql(start: int) -> str:
    """Little-endian value of the 4 bytes from a 0-based byte offset of `hx`."""
    parts = []
    for i in range(4):
        hi, lo = 2 * (start + i) + 1, 2 * (start + i) + 2
        parts.append(f"({_HEXDIGIT.format(p=hi)} * 16 + {_HEXDIGIT.format(p=lo)}) * {256 ** i}")
    return "CAST(" + " + ".join(parts) + " AS BIGINT)"


OFFICE = "('.docx', '.xlsx', '.pptx')"
FILE_FACTS = f"""{FILES},
facts AS (SELECT *, octet_length(content) AS size, hex(content) AS hx, decode(content) AS txt,
          CASE WHEN regexp_matches(lower(file_name), '[^./][^/]*\\.[^./]*$')
               THEN regexp_extract(lower(file_name), '\\.[^./]*$') ELSE '' END AS ext FROM files),
checks AS (SELECT *,
   ext IN ({', '.join(q(e) for e in fixed.BLOCKED_EXTENSIONS)}) AS blocked,
   hx[1:4] = '4D5A' AS mz, hx[1:8] = '7F454C46' AS elf,
   regexp_matches(txt, {_byte_rule(fixed.OFFICE_MACRO_STRINGS, '(?i)')}) OR regexp_matches(txt, {_byte_rule(fixed.OFFICE_MACRO_STRINGS_EXACT_CASE)}) AS macro,
   hx[1:4] = '4D5A' AND size >= 64 AND substr(hx, 2 * {_dword_sql(60)} + 1, 8) = '50450000' AS pe,
   regexp_matches(txt, {_byte_rule(fixed.PDF_ACTIVE_STRINGS, '(?i)')}) AS pdf_active,
   size > 5 * 1024 * 1024 AS oversize,
   CASE WHEN ext = '.pdf' THEN hx[1:8] <> '25504446' WHEN ext IN {OFFICE} THEN hx[1:8] <> '504B0304' ELSE false END AS mismatch,
   CASE WHEN ext IN {OFFICE} AND hx[1:8] = '504B0304' THEN
        len(regexp_extract_all(txt, '(?s)PK\\x01\\x02.{{42}}[ -~]*(?:vbaProject|[vV][bB][aA][ -~]*\\.bin)')) ELSE 0 END AS entries,
   CASE WHEN ext = '.pdf' THEN NOT (hx[1:8] = '25504446' AND contains(txt, '%%EOF'))
        WHEN ext IN {OFFICE} THEN NOT (hx[1:8] = '504B0304' AND contains(hx, '504B0506')) ELSE false END AS corrupt
   FROM facts),
labelled AS (SELECT *,
   list_filter([CASE WHEN blocked THEN 'MALWARE_EXTENSION' END, CASE WHEN mz THEN 'EMBEDDED_PE_HEADER' END,
     CASE WHEN elf THEN 'ELF_BINARY_HEADER' END, CASE WHEN macro THEN 'YARA_OFFICEMACROTRIGGER' END,
     CASE WHEN pe THEN 'YARA_EXECUTABLEINDOCUMENT' END, CASE WHEN pdf_active THEN 'YARA_PDFMALICIOUSTRIGGERS' END],
     lambda x: x IS NOT NULL) AS lab_malware,
   list_concat(list_concat(list_filter([CASE WHEN oversize THEN 'ABNORMAL_FILE_SIZE' END,
     CASE WHEN mismatch THEN 'MISMAPPED_MIME_TYPE' END], lambda x: x IS NOT NULL),
     list_transform(range(entries), lambda x: 'VBA_MACRO_ARCHIVE')),
     CASE WHEN corrupt THEN ['PARSER_STRUCTURE_CORRUPTION'] ELSE CAST([] AS VARCHAR[]) END) AS lab_sandbox
   FROM checks)"""


def file_scan(detector: fixed.Detector, unnamed: str) -> str:
    score, confidence = scores(f"lab_{detector.key}", detector, zero=True)
    return f"""{FILE_FACTS},
captions AS (SELECT *, 'File: ' || CASE WHEN file_name = '' THEN {q(unnamed)} ELSE file_name END || '. Size: ' || size || ' bytes.' AS caption FROM labelled),
{features('captions', 'caption')},
scans AS (SELECT *, {score} AS s_{detector.key}, {confidence} AS c_{detector.key} FROM feat)"""
