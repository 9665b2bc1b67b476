"""Sequential redaction of personal data and secrets.

Each step reads the text as the steps before it left it.  Every step is a named column, so the flag of a step and the
text of a step are computed from the same intermediate text, once; a step's regex only runs where its literals occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.dialect import java_pattern
from tidewall.functions.plan import pinned
from tidewall.operators.detect import KEY_WORDS, seen, with_profile

# What the original text must contain for a step to be tried at all: necessary conditions of the patterns.  Masks add
# nothing a later pattern could start from, so the original text decides for every step.
_FOUR_DIGITS = r"\p{Nd}{4}"
_DIGIT_STEPS = {
    "SSN", "PHONE_NUMBER", "AADHAAR_NUMBER", "AADHAAR", "PAN_NUMBER", "PAN", "CREDIT_CARD_NUMBER", "CREDIT_CARD",
}
_NEEDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "EMAIL_ADDRESS": ("raw", ("@",)),
    "EMAIL": ("raw", ("@",)),
    "PASSPORT_NUMBER": ("lower", ("passport",)),
    "PASSPORT": ("lower", ("passport",)),
    "JWT_TOKEN": ("raw", ("eyJ",)),
    "AWS_ACCESS_KEY": ("raw", ("AKIA", "ASIA", "AMZN")),
    "AWS_SECRET_KEY": ("fold", KEY_WORDS),
    "GENERIC_API_KEY": ("fold", KEY_WORDS),
    "OPENAI_API_KEY": ("raw", ("sk-",)),
    "GOOGLE_API_KEY": ("raw", ("AIza",)),
    "GITHUB_TOKEN": ("raw", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    "API_KEY": ("raw", ("sk-", "AIza")),
    "DB_CONN_STRING": ("raw", ("://",)),
    "PRIVATE_KEY": ("lower", ("begin private key", "begin rsa private key")),
}


def _worth_trying(label: str) -> Column:
    if label in _DIGIT_STEPS:
        return F.col("_digits")
    return seen(*_NEEDS[label])


def _replace_values(text: Column, values: Column, mask: str) -> Column:
    """Replace every extracted value wherever it occurs, in order of appearance."""
    return F.aggregate(F.array_distinct(values), text, lambda acc, v: F.replace(acc, v, F.lit(mask)))


def redact(df: DataFrame, text: str, profile: str = "default") -> DataFrame:
    """Add `sanitized` (masked text) and `entities` (labels in step order) for a text column."""
    steps = {"default": fixed.REDACTION, "strict": fixed.REDACTION_STRICT}[profile]
    original = F.coalesce(F.col(text), F.lit(""))
    out = (
        with_profile(df, text)
        .withColumn("_digits", F.when(F.col("_profile")["digits"] >= 4, F.rlike(original, F.lit(_FOUR_DIGITS))))
        .withColumn("_t0", original)
    )
    flags: list[tuple[str, str]] = []
    now = 0
    for n, (label, mask, patterns, how) in enumerate(steps):
        if how == "whole":
            out = out.withColumn(f"_f{n}", _worth_trying(label))
            out = out.withColumn(f"_t{now + 1}", F.when(F.col(f"_f{n}"), F.lit(mask)).otherwise(F.col(f"_t{now}")))
            flags.append((label, f"_f{n}"))
            now += 1
            continue
        for m, pattern in enumerate(patterns):
            source = F.col(f"_t{now}")
            if how == "mask":
                regex = F.lit(java_pattern(pattern))
                changed = F.when(
                    _worth_trying(label),
                    F.regexp_replace(source, regex, F.lit(mask)),
                ).otherwise(source)
                out = out.withColumn(f"_t{now + 1}", changed)
                # a mask never equals what it replaces, so a step hit exactly where it changed the text
                out = out.withColumn(f"_f{n}_{m}", F.col(f"_t{now + 1}") != F.col(f"_t{now}"))
            elif how == "value":
                regex = F.lit(java_pattern(f"(?i){pattern}"))
                out = out.withColumn(
                    f"_v{n}",
                    F.when(
                        _worth_trying(label),
                        F.regexp_extract_all(source, regex, F.lit(1)),
                    ).otherwise(F.array().cast("array<string>")),
                )
                out = out.withColumn(f"_f{n}_{m}", F.size(f"_v{n}") > 0)
                out = out.withColumn(
                    f"_t{now + 1}",
                    F.when(F.col(f"_f{n}_{m}"), _replace_values(source, F.col(f"_v{n}"), mask)).otherwise(source),
                )
            else:  # ident
                regex = java_pattern(pattern)
                out = out.withColumn(f"_f{n}_{m}", _worth_trying(label) & F.rlike(original, F.lit(regex)))
                tokens = F.filter(
                    F.regexp_extract_all(source, F.lit(regex), F.lit(0)), lambda v: F.rlike(v, F.lit("[0-9]"))
                )
                out = out.withColumn(
                    f"_t{now + 1}",
                    F.when(F.col(f"_f{n}_{m}"), _replace_values(source, tokens, mask)).otherwise(source),
                )
            now += 1
        step_flag = F.col(f"_f{n}_0")
        for m in range(1, len(patterns)):
            step_flag = step_flag | F.col(f"_f{n}_{m}")
        out = out.withColumn(f"_f{n}", step_flag)
        flags.append((label, f"_f{n}"))
    entities = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(label)) for label, flag in flags]))
    if profile == "strict":
        entities = F.array_distinct(entities)  # two key kinds share one label
    return out.select(*df.columns, pinned(f"_t{now}").alias("sanitized"), pinned(entities).alias("entities"))


def pii_summary(df: DataFrame, text: str) -> DataFrame:
    """Strict profile with a flag and an explanation text."""
    out = redact(df, text, profile="strict")
    listed = F.when(F.size("entities") > 0, F.array_join("entities", ", ")).otherwise("None")
    before, after = fixed.STRICT_SUMMARY.split("%s")
    return out.withColumn("has_pii", F.size("entities") > 0).withColumn(
        "explanation", F.concat(F.lit(before), listed, F.lit(after))
    )


def choose_sanitized(action: Column, sensitive_score: Column, masked: Column, content: Column) -> Column:
    """NULL where blocked; masked text where redaction applies; else the content as it came."""
    return (
        F.when(action == "BLOCK", F.lit(None).cast("string"))
        .when((action == "REDACTED") | (sensitive_score > 0.30), masked)
        .otherwise(content)
    )
