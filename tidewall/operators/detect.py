"""Text detectors: label arrays from pattern and keyword rules.

A corpus is mostly clean, so a pattern only runs where the literals it cannot match without are present.  One pass
over each text (`with_profile`) finds all literals and keywords; the result is a few long integers per row, and a rule's
gate is a bit test.  That keeps about 100 regexes from touching most rows.  Gates are necessary conditions, so results
do not depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.dialect import fold, fold_lower, search_pattern
from tidewall.functions.plan import pinned, text_literal
from tidewall.functions.text import SEEN_BITS, text_profile

_OVERRIDE_VERBS = (
    "ignore", "bypass", "forget", "override", "overwrite", "delete", "clear", "reset", "skip", "disregard",
)
_CONFIG_NOUNS = ("prompt", "instruction", "rule", "guideline", "directive", "parameter", "variable", "message", "config")
_QUOTES = ("'", '"')
_WORD_NC = ("word nc",)  # as a word of its own: the two letters alone occur in half of all texts

# label -> per pattern: groups of literals, at least one literal of every group must occur in the folded text
GATES: dict[str, tuple[tuple[tuple[str, ...], ...], ...]] = {
    "INSTRUCTION_OVERRIDE_REGEX": (
        (_OVERRIDE_VERBS, ("previous", "system", "safety", "constraint", "policy", "restriction", "limit") + _CONFIG_NOUNS),
        (("disregard",),),
    ),
    "PROMPT_LEAKAGE_REGEX": (
        (
            ("reveal", "output", "print", "display", "show", "leak", "tell", "export", "extract", "read", "give"),
            _CONFIG_NOUNS,
        ),
        (("system",), ("prompt",)),
        (("everything",), ("repeat",)),
    ),
    "ROLE_ESCALATION_REGEX": (
        (
            ("you are now", "act as", "assume the role of", "simulate", "become", "roleplay"),
            ("admin", "root", "sudo", "system", "developer", "operator", "creator", "programmer", "persona"),
        ),
        (("access", "privileges"), ("root", "admin")),
    ),
    "DAN_MODE_REGEX": (
        (
            (
                "dan", "anything", "mode", "evil", "jailbr", "unrestricted", "unfiltered", "lawless", "pirate",
                "sandbox", "offline",
            ),
        ),
        (("gpt-dev-mode",),),
    ),
    "POLICY_BYPASS_REGEX": (
        (
            ("pretend to be", "act as", "simulate"),
            ("unrestricted", "unfiltered", "evil", "villain", "jailbr", "lawless", "pirate", "offline"),
        ),
        (
            ("polic", "guideline", "safety", "restriction", "rule", "constraint", "control", "moral"),
        ),
    ),
    "CHARACTER_JAILBREAK_REGEX": (
        (
            ("roleplay", "hypothetical", "imagine", "simulating"),
            ("character", "jailbr", "villain", "criminal", "programmer", "pirate", "persona"),
        ),
    ),
    "REVERSE_SHELL_PAYLOAD": (
        (("/dev/",), ("bash",)),
        (("nc",), ("-",), ("sh", "cmd", "powershell")),
        (("|",), ("nc",)),
        (("python",), ("socket",), ("dup2",)),
        (("perl",), ("socket",), ("stdin",)),
        (("php",), ("fsockopen",)),
        (("ruby",), ("socket",)),
        (("mkfifo",),),
        (("/dev/tcp/",),),
        (("/dev/tcp/",),),
        (("cmd.exe", "/bin/sh"), ("nc",)),
    ),
    "COMMAND_INJECTION_TRIGGER": (
        (("powershell",),),
        (("cmd",), ("/c", "/k")),
        (("-i",), ("sh",)),
        (("curl",), ("|",)),
        (("wget",), ("|",)),
        (("chmod",),),
        (("base64",),),
        (("whoami",),),
        (("/etc/passwd",),),
        (("/etc/shadow",),),
    ),
    "CLI_TOOL_USE": (
        (("curl",),),
        (("wget",),),
        (_WORD_NC,),
        (("python",), ("-c",)),
        (("perl",), ("-e",)),
        (("ruby",), ("-e",)),
    ),
    "SQL_TAUTOLOGY": (
        (("=",), _QUOTES),
        (("=",), _QUOTES),
        (("=",),),
        (("=",), _QUOTES),
    ),
    "SQL_UNION_SELECT": (
        (("union",), ("select",)),
        (("select",), ("users",)),
        (("select",), ("information_schema",)),
    ),
    "SQL_DESTRUCTIVE_COMMAND": (
        (("drop",),),
        (("delete",),),
        (("insert",),),
        (("update",),),
        (("--",),),
        (("/*",), ("*/",)),
        (("exec",), ("(",)),
    ),
    "XSS_SCRIPT_TAG": ((("<script",), ("</script>",)), (("<script",),)),
    "XSS_EVENT_HANDLER": ((("=",), _QUOTES), (("onerror",),)),
    "XSS_JAVASCRIPT_URI": ((("<iframe",),), (("javascript:",),), (("javascript:",),), (("javascript:",),)),
    "XSS_EXPLICIT_FUNCTION": ((("alert(",),), (("confirm(",),), (("prompt(",),), (("eval(",),)),
    "DIRECT_PROMPT_LEAKAGE": (
        (
            ("reveal", "leak", "print", "show", "output", "dump", "copy", "export", "extract", "give", "tell"),
            ("system", "prompt", "rule", "parameter", "instruction", "template"),
        ),
        (("instruction",), ("what",)),
        (("prompt",), ("what",)),
        (("system",), ("prompt",), ("tell",)),
        (("system",), ("instruction",), ("tell",)),
        (("instruction",), ("reveal",)),
        (("instruction", "config"),),
    ),
    "INDIRECT_PROMPT_LEAKAGE": (
        (("programmed",),),
        (("response",), ("must",)),
        (("repeat",),),
        (("instruction",), ("write",)),
        (("before",), ("what",)),
    ),
    "CODE_EXEC_PYTHON": (
        (("import",),),
        (("import",), ("from",)),
        (("exec",), ("(",)),
        (("eval",), ("(",)),
    ),
    "CODE_EXEC_JS": ((("require(", "process."),), (("eval",), ("(",)), (("function",), ("(",), _QUOTES)),
    "CODE_EXEC_PHP": ((("exec(", "system(", "passthru(", "popen(", "proc_open(", "eval"),),),
    "CODE_EXEC_JAVA": ((("runtime", "processbuilder"),),),
}

# Literals a redaction step cannot do without, looked up in the original or in the lower-cased text.
RAW_LITERALS = ("@", "eyJ", "AKIA", "ASIA", "AMZN", "sk-", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "://")
KEY_WORDS = ("aws_key", "secret", "api_key", "apikey", "private_key", "token")
REDACTION_WORDS = ("passport", "begin private key", "begin rsa private key")

_FOLDED = tuple(
    dict.fromkeys(
        [lit for rows in GATES.values() for groups in rows for g in groups for lit in g if g != _WORD_NC]
        + [*KEY_WORDS]
    )
)
_LOWERED = tuple(
    dict.fromkeys(
        [k for d in fixed.TEXT_RULE_DETECTORS for f in d.families for k in f.keywords]
        + [fixed.REVERSE_SHELL_LITERAL, *REDACTION_WORDS]
        + [k for _, _, literals, *_ in fixed.CLASSIFIER for k in literals]
    )
)
_BIT = {
    (mode, literal): n
    for n, (mode, literal) in enumerate(
        [("fold", x) for x in _FOLDED] + [("lower", x) for x in _LOWERED] + [("raw", x) for x in RAW_LITERALS]
        + [("word", "nc")]
    )
}


def with_profile(df: DataFrame, text: str) -> DataFrame:
    """Add `_profile`: character statistics and literal presence of a text column."""
    if "_profile" in df.columns:
        return df
    return df.withColumn("_profile", pinned(text_profile(text, _FOLDED, _LOWERED, RAW_LITERALS, ("nc",))))


def seen_sql(mode: str, literals: tuple[str, ...]) -> str:
    """True where any of the literals occurs in the folded / lower / raw form of the profiled text."""
    masks: dict[int, int] = {}
    for literal in literals:
        word, bit = divmod(_BIT[mode, literal], SEEN_BITS)
        masks[word] = masks.get(word, 0) | (1 << bit)
    return "(" + " OR ".join(f"(_profile.seen[{w}] & {m}L) <> 0" for w, m in sorted(masks.items())) + ")"


def seen(mode: str, literals: tuple[str, ...]) -> Column:
    return F.expr(seen_sql(mode, literals))


def gate_sql(groups: tuple[tuple[str, ...], ...]) -> str:
    return " AND ".join(
        seen_sql("word", ("nc",)) if group == _WORD_NC else seen_sql("fold", group) for group in groups
    )


def with_text_forms(df: DataFrame, text: str, gates=None) -> DataFrame:
    """Add the lower-cased (`_lower`), folded lower-cased (`_flower`) and folded (`_fold`) forms of a text column.

    NULL where no gate of ``gates`` (default: all) opens, so that clean rows are not rewritten.
    """
    out = with_profile(df, text)
    rows = dict.fromkeys(groups for g in (GATES if gates is None else gates).values() for groups in g)
    some = " OR ".join(f"({gate_sql(groups)})" for groups in rows)
    original = F.coalesce(F.col(text), F.lit(""))
    return (
        out.withColumn("_lower", F.when(F.expr(some), F.lower(original)))
        .withColumn("_flower", fold_lower(F.col("_lower")))
        .withColumn("_fold", fold(original, F.col("_flower")))
    )


def hit_sql(pattern: str, groups: tuple[tuple[str, ...], ...], text_mode: str, raw: str) -> str:
    """Condition of one pattern, after `with_text_forms`: gate first, then the pattern."""
    source, folded = {
        "any": ("_fold", True), "lower": ("_flower", True), "lower_raw": ("_lower", False), "raw": (raw, False),
    }[text_mode]
    return f"({gate_sql(groups)} AND rlike({source}, {text_literal(search_pattern(pattern, folded))}))"


def rule_labels(detector: fixed.Detector, raw: str) -> Column:
    """Labels of one text detector in rule order, with repeats."""
    rows = []
    for family in detector.families:
        for pattern, groups in zip(family.patterns, GATES[family.label], strict=True):
            hit = hit_sql(pattern, groups, family.text, raw)
            if family.label == "REVERSE_SHELL_PAYLOAD":
                hit = f"({seen_sql('lower', (fixed.REVERSE_SHELL_LITERAL,))} OR {hit})"
            rows.append((hit, family.label))
        rows += [(seen_sql("lower", (k,)), f"{family.keyword_label}:{k}") for k in family.keywords]
    cases = ", ".join(f"CASE WHEN {hit} THEN {text_literal(label)} END" for hit, label in rows)
    return F.expr(f"array_compact(array({cases}))")


def with_labels(df: DataFrame, text: str, detectors=fixed.TEXT_RULE_DETECTORS) -> DataFrame:
    """Add `labels_<key>` for each rule detector; expects `with_text_forms`."""
    raw = f"coalesce(`{text}`, '')"
    return df.withColumns({f"labels_{d.key}": pinned(rule_labels(d, raw)) for d in detectors}).drop(
        "_fold", "_flower", "_lower"
    )


def detect(df: DataFrame, text: str, detector: fixed.Detector) -> DataFrame:
    """Labels, score and confidence of a single text detector, added as `labels`, `score`, `confidence`, `reason`."""
    from tidewall.functions.scoring import as_confidence, as_score, reason, score_detector, with_override
    from tidewall.operators.redact import redact

    keep = df.columns
    out = with_profile(df, text)
    if detector is fixed.SENSITIVE:
        out = redact(out, text).withColumnRenamed("entities", f"labels_{detector.key}")
    else:
        out = with_text_forms(out, text, {f.label: GATES[f.label] for f in detector.families})
        out = with_labels(out, text, (detector,))
    name = f"labels_{detector.key}"
    labels = F.col(name)
    out = with_override(out, text, "_profile")
    points, percent = score_detector(
        "_profile", name, detector, "_fix", clean_is_zero=detector is fixed.SENSITIVE
    )
    return out.select(
        *keep,
        pinned(labels).alias("labels"),
        pinned(as_score(points)).alias("score"),
        pinned(as_confidence(percent)).alias("confidence"),
        pinned(reason(name, detector)).alias("reason"),
    )
