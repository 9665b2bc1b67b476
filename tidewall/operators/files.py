"""Attachment screening over a BINARY column and a file name: extension, header and byte-string checks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall import fixed
from tidewall.functions.plan import pinned
from tidewall.functions.scoring import as_confidence, as_score, places, reason, score_detector, with_override
from tidewall.functions.text import short_text_stats


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_ext(name: Column | str) -> Column:
    """Last extension, lower-cased, with its dot; a name of leading dots only has none."""
    return F.regexp_extract(F.lower(F.coalesce(_col(name), F.lit(""))), r"[^./][^/]*(\.[^./]*)$", 1)


def _has_bytes(content: Column) -> Column:
    return F.coalesce(F.length(content) > 0, F.lit(False))


def starts_with(content: Column, header: bytes) -> Column:
    return F.coalesce(F.substring(content, 1, len(header)) == F.lit(header), F.lit(False))


#: Bits of `seen` in what `byte_marks` finds.
_MACRO, _ACTIVE, _ZIP_END, _PDF_END = 1, 2, 4, 8


def byte_marks(content: Column | str) -> Column:
    """What the checks look for inside a file, in one pass over its bytes: struct of `seen` (bits) and `entries`.

    One Arrow batch function over the BINARY column: bytes are neither decoded nor read once per check.  Literals count
    plain and with a zero byte after every character.  `entries` are the macro project entries of a zip directory, whose
    names stand in clear: a directory record is PK\\x01\\x02, 42 more bytes, then the name.  Null and empty: nothing.
    """
    return _marks_udf(
        (
            (_MACRO, True, _either_width(fixed.OFFICE_MACRO_STRINGS)),
            (_MACRO, False, _either_width(fixed.OFFICE_MACRO_STRINGS_EXACT_CASE)),
            (_ACTIVE, True, _either_width(fixed.PDF_ACTIVE_STRINGS)),
            (_ZIP_END, False, (b"PK\x05\x06",)),
            (_PDF_END, False, (b"%%EOF",)),
        )
    )(_col(content))


def _either_width(literals: tuple[str, ...]) -> tuple[bytes, ...]:
    return tuple(s.encode("ascii") for s in literals) + tuple(s.encode("utf-16-le") for s in literals)


def _marks_udf(groups: tuple[tuple[int, bool, tuple[bytes, ...]], ...]):
    """Built inside a function so that it ships by value; groups are (bit, any letter case, literals)."""
    any_case = [(bit, [x.lower() for x in literals]) for bit, folded, literals in groups if folded]
    exact = [(bit, literals) for bit, folded, literals in groups if not folded]
    # name characters only, so that a match stays inside one record
    name = rb"(?:[\x20-\x7e]*vbaProject|(?=[\x20-\x7e]*[vV][bB][aA])[\x20-\x7e]*\.bin(?![\x20-\x7e]))"
    record = rb"(?s)PK\x01\x02.{42}" + name

    @F.arrow_udf("struct<seen:bigint,entries:bigint>")
    def marks(contents):
        import re

        import pyarrow as pa

        entry, seen, entries = re.compile(record), [], []
        for value in contents:
            raw = value.as_py() or b""
            low, bits = raw.lower(), 0
            for data, group in ((low, any_case), (raw, exact)):
                for bit, literals in group:
                    if not bits & bit and any(x in data for x in literals):
                        bits |= bit
            seen.append(bits)
            entries.append(sum(1 for _ in entry.finditer(raw)) if b"PK\x01\x02" in raw else 0)
        return pa.StructArray.from_arrays([pa.array(seen, pa.int64()), pa.array(entries, pa.int64())], ["seen", "entries"])

    return marks


def _seen(marks: Column, bit: int) -> Column:
    return marks["seen"].bitwiseAND(F.lit(bit)) != 0


def office_macro(marks: Column) -> Column:
    """Auto-run macro names (any case) or the VBA marker (exact case), narrow or UTF-16."""
    return _seen(marks, _MACRO)


def pdf_active_content(marks: Column) -> Column:
    return _seen(marks, _ACTIVE)


def _dword(content: Column, start: Column | int) -> Column:
    """Little-endian unsigned 32-bit value at a 1-based byte position."""
    h = F.hex(F.substring(content, start, 4) if isinstance(start, int) else F.substr(content, start, F.lit(4)))
    swapped = F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long")


def executable_in_document(content: Column) -> Column:
    """MZ at the start and the PE signature where the header points to."""
    offset = _dword(content, 0x3C + 1)
    inside = (F.length(content) >= 0x40) & (offset + 4 <= F.length(content))
    at = F.when(inside, (offset + 1).cast("int")).otherwise(1)
    return starts_with(content, b"MZ") & inside & (F.substr(content, at, F.lit(4)) == F.lit(b"PE\x00\x00"))


def malware_labels(content: Column | str, name: Column | str, marks: Column | str | None = None) -> Column:
    """Labels of the malware detector; ``marks`` is a column of `byte_marks` where there is one already."""
    c, ext = _col(content), file_ext(name)
    found = byte_marks(c) if marks is None else _col(marks)
    return F.when(
        _has_bytes(c),
        F.array_compact(
            F.array(
                F.when(ext.isin(*fixed.BLOCKED_EXTENSIONS), F.lit("MALWARE_EXTENSION")),
                F.when(starts_with(c, b"MZ"), F.lit("EMBEDDED_PE_HEADER")),
                F.when(starts_with(c, b"\x7fELF"), F.lit("ELF_BINARY_HEADER")),
                F.when(office_macro(found), F.lit("YARA_OFFICEMACROTRIGGER")),
                F.when(executable_in_document(c), F.lit("YARA_EXECUTABLEINDOCUMENT")),
                F.when(pdf_active_content(found), F.lit("YARA_PDFMALICIOUSTRIGGERS")),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def oversize(content: Column) -> Column:
    return F.length(content) > fixed.MAX_FILE_MB * 1024 * 1024


def type_mismatch(content: Column, ext: Column) -> Column:
    return F.when(ext == ".pdf", ~starts_with(content, b"%PDF")).otherwise(
        ext.isin(*fixed.OFFICE_EXTENSIONS) & ~starts_with(content, b"PK\x03\x04")
    )


def macro_entries(content: Column, ext: Column, marks: Column) -> Column:
    """Number of macro project entries in an Office container."""
    applies = ext.isin(*fixed.OFFICE_EXTENSIONS) & starts_with(content, b"PK\x03\x04")
    return F.when(applies, marks["entries"].cast("int")).otherwise(0)


def structure_corrupt(content: Column, ext: Column, marks: Column) -> Column:
    """No parser could open the file: the directory of a container or the trailer of a PDF is missing."""
    zip_ok = starts_with(content, b"PK\x03\x04") & _seen(marks, _ZIP_END)
    pdf_ok = starts_with(content, b"%PDF") & _seen(marks, _PDF_END)
    return F.when(ext == ".pdf", ~pdf_ok).otherwise(ext.isin(*fixed.OFFICE_EXTENSIONS) & ~zip_ok)


def sandbox_labels(content: Column | str, name: Column | str, marks: Column | str | None = None) -> Column:
    """Labels of the sandbox detector; ``marks`` as for `malware_labels`."""
    c, ext = _col(content), file_ext(name)
    found = byte_marks(c) if marks is None else _col(marks)
    return F.when(
        _has_bytes(c),
        F.concat(
            F.array_compact(
                F.array(
                    F.when(oversize(c), F.lit("ABNORMAL_FILE_SIZE")),
                    F.when(type_mismatch(c, ext), F.lit("MISMAPPED_MIME_TYPE")),
                )
            ),
            F.array_repeat(F.lit("VBA_MACRO_ARCHIVE"), macro_entries(c, ext, found)),
            F.array_compact(F.array(F.when(structure_corrupt(c, ext, found), F.lit("PARSER_STRUCTURE_CORRUPTION")))),
        ),
    ).otherwise(F.array().cast("array<string>"))


def sandbox_text(content: Column | str, name: Column | str, extracted: Column | str | None = None) -> Column:
    """Text of an attachment: plain formats are decoded here with invalid bytes dropped; text of formats that need a
    parser comes in as a column."""
    c, ext = _col(content), file_ext(name)
    given = F.lit("") if extracted is None else F.coalesce(_col(extracted), F.lit(""))
    decoded = F.coalesce(
        F.try_validate_utf8(c.cast("string")), F.replace(F.make_valid_utf8(c.cast("string")), F.lit("�"), F.lit(""))
    )
    return F.when(_has_bytes(c) & ext.isin(*fixed.TEXT_EXTENSIONS), decoded).when(_has_bytes(c), given).otherwise("")


def file_caption(content: Column | str, name: Column | str, unnamed: str) -> Column:
    """The short text that file scores are computed over."""
    shown = F.coalesce(F.nullif(_col(name), F.lit("")), F.lit(unnamed))
    return F.concat(F.lit("File: "), shown, F.lit(". Size: "), F.length(_col(content)).cast("string"), F.lit(" bytes."))


def scan_files(df: DataFrame, content: str, name: str, detector: fixed.Detector) -> DataFrame:
    """Labels, score, confidence and reason of one file detector."""
    keep = df.columns
    make, unnamed = {
        "malware": (malware_labels, "unnamed"),
        "sandbox": (sandbox_labels, "document"),
    }[detector.key]
    needed = F.col(content)
    if detector is fixed.SANDBOX:  # looks inside containers and PDFs only; other bytes stay in the JVM
        needed = F.when(file_ext(name).isin(".pdf", *fixed.OFFICE_EXTENSIONS), needed)
    out = df.withColumn("_marks", pinned(byte_marks(needed)))
    out = out.withColumn("labels", make(content, name, "_marks"))
    out = out.withColumn("_caption", F.when(F.size("labels") > 0, file_caption(content, name, unnamed)))
    out = out.withColumn("_stats", F.when(F.size("labels") > 0, short_text_stats("_caption")))
    out = with_override(out, "_caption", "_stats")
    points, percent = score_detector("_stats", "labels", detector, "_fix", True)
    nothing = F.size("labels") == 0
    return out.select(
        *keep,
        pinned("labels").alias("labels"),
        pinned(as_score(F.when(nothing, F.lit(0)).otherwise(points))).alias("score"),
        pinned(as_confidence(F.when(nothing, F.lit(100)).otherwise(percent))).alias("confidence"),
        pinned(reason("labels", detector)).alias("reason"),
    )


def size_text(content: Column | str) -> Column:
    kb = F.length(_col(content)) / F.lit(1024.0)
    return F.when(kb < 1024, F.concat(places(kb, 2), F.lit(" KB"))).otherwise(F.concat(places(kb / 1024.0, 2), F.lit(" MB")))


def file_type(name: Column | str) -> Column:
    n = F.coalesce(_col(name), F.lit(""))
    label = F.when(F.contains(n, F.lit(".")), F.upper(F.substring_index(n, ".", -1))).otherwise("BINARY")
    return F.concat(label, F.lit(" Document"))


def file_report(scored: DataFrame, key: str, content: str, name: str) -> DataFrame:
    """Report per attachment; expects the columns of `with_scores`."""
    malware, sandbox = F.col("labels_malware"), F.col("labels_sandbox")
    command, sensitive = F.col("labels_command"), F.array_distinct(F.col("labels_sensitive"))

    def has(labels: Column, *wanted: str) -> Column:
        test = F.lit(False)
        for w in wanted:
            test = test | F.array_contains(labels, w)
        return test

    executable = has(malware, "EMBEDDED_PE_HEADER", "ELF_BINARY_HEADER")
    blocked = has(malware, "MALWARE_EXTENSION")
    macro = has(sandbox, "VBA_MACRO_ARCHIVE") | has(malware, "YARA_OFFICEMACROTRIGGER")
    script = has(malware, "YARA_PDFMALICIOUSTRIGGERS")
    shell = has(command, "COMMAND_INJECTION_TRIGGER", "REVERSE_SHELL_PAYLOAD")
    corrupt = has(sandbox, "PARSER_STRUCTURE_CORRUPTION")
    emails = F.size(F.filter(sensitive, lambda x: F.contains(x, F.lit("EMAIL"))))
    phones = F.size(F.filter(sensitive, lambda x: F.contains(x, F.lit("PHONE"))))
    secrets = F.size(F.filter(sensitive, lambda x: F.rlike(x, F.lit("API_KEY|TOKEN|SECRET"))))
    details = F.array_compact(
        F.array(
            F.when(emails > 0, F.concat(emails.cast("string"), F.lit(" email address(es)"))),
            F.when(phones > 0, F.concat(phones.cast("string"), F.lit(" phone number(s)"))),
            F.when(secrets > 0, F.concat(secrets.cast("string"), F.lit(" API credentials"))),
        )
    )
    listed = F.when(F.size(details) > 0, F.array_join(details, ", ")).otherwise(
        F.concat(F.size(sensitive).cast("string"), F.lit(" sensitive fields"))
    )
    return scored.filter(_has_bytes(F.col(content))).select(
        key,
        F.col(name).alias("file_name"),
        size_text(content).alias("file_size"),
        file_type(name).alias("file_type"),
        F.sha2(F.col(content), 256).alias("sha256"),
        F.when(executable, "Malware detected (executable headers)")
        .when(blocked, "Malware detected (blocked extension)")
        .otherwise("Safe")
        .alias("malware_status"),
        F.when(macro, "Macro detected").otherwise("No macros").alias("macro_status"),
        F.when(script, "Suspicious JavaScript")
        .when(shell, "Hidden PowerShell")
        .when(executable | blocked, "Embedded executable")
        .otherwise("No malware")
        .alias("script_status"),
        F.when(corrupt, "Parser structures corrupted").otherwise("Metadata clean").alias("metadata_status"),
        F.when(F.col("bp_sensitive") > 1000, F.concat(listed, F.lit(" detected")))
        .otherwise("No private disclosures identified")
        .alias("sensitive_status"),
        (executable | blocked | macro | script | shell | corrupt).alias("is_malicious"),
    )


def file_gate(df: DataFrame, content: str, name: str, extracted: str | None = None) -> DataFrame:
    """Older gate: a list of threats, safe when empty; text only of safe files."""
    c, ext = F.col(content), file_ext(name)
    megabytes = F.length(c) / F.lit(1024.0 * 1024.0)
    found = F.col("_marks")
    macro_bytes = office_macro(found)
    threats = F.when(
        _has_bytes(c),
        F.array_compact(
            F.array(
                F.when(
                    ext.isin(*fixed.BLOCKED_EXTENSIONS),
                    F.concat(F.lit("MALWARE_EXTENSION: Extension '"), ext, F.lit("' is explicitly blocked by safety policy.")),
                ),
                F.when(
                    oversize(c),
                    F.concat(
                        F.lit("ABNORMAL_FILE_SIZE: File size ("), places(megabytes, 2),
                        F.lit(" MB) exceeds maximum security threshold of 5MB."),
                    ),
                ),
                F.when(starts_with(c, b"MZ"), F.lit("Executable Payload (MZ Header Detected)")),
                F.when(
                    (ext == ".pdf") & type_mismatch(c, ext),
                    F.lit("Mismatched MIME Type: Declared PDF, missing standard header magic bytes"),
                ),
                F.when(
                    (ext != ".pdf") & type_mismatch(c, ext),
                    F.lit("Mismatched MIME Type: Declared Office Document, missing ZIP container magic bytes"),
                ),
                F.when(macro_bytes, F.lit("YARA Alert: OfficeMacroTrigger matched.")),
                F.when(executable_in_document(c), F.lit("YARA Alert: ExecutableInDocument matched.")),
                F.when(pdf_active_content(found), F.lit("YARA Alert: PDFMaliciousTriggers matched.")),
                F.when(
                    ~macro_bytes & (macro_entries(c, ext, found) > 0),
                    F.lit("YARA Alert: OfficeMacroTrigger matched. (Container scan)"),
                ),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
    out = df.withColumn("_marks", pinned(byte_marks(c))).withColumn("_before", threats)
    safe_so_far = F.size("_before") == 0
    needs_parser = (ext == ".pdf") | ext.isin(*fixed.OFFICE_EXTENSIONS)
    broken = _has_bytes(c) & safe_so_far & structure_corrupt(c, ext, found)
    out = out.withColumn(
        "threats",
        F.when(
            broken,
            F.concat("_before", F.array(F.lit("DOCUMENT_PARSE_FAILURE: Corrupted document structure or parser error."))),
        ).otherwise(F.col("_before")),
    )
    out = out.withColumn(
        "_text", F.when(safe_so_far & ~broken, sandbox_text(content, name, extracted)).otherwise(F.lit(""))
    )
    status = (
        F.when(~safe_so_far, F.lit("Skipped"))
        .when(broken, F.lit("Failed"))
        .when(needs_parser | ext.isin(*fixed.TEXT_EXTENSIONS), F.lit("Successful"))
        .otherwise(F.concat(F.lit("Unsupported extension: "), ext))
    )
    is_safe = F.size("threats") == 0
    message = F.concat(
        F.lit("File '"), F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("attachment")), F.lit("' scanned. Safety: "),
        F.when(is_safe, "Safe").otherwise("Threats Identified"),
        F.lit(". Sanitization Parsing: "), status,
        F.lit(". Extracted Content Length: "), F.length("_text").cast("string"), F.lit(" characters."),
        F.when(is_safe, F.lit("")).otherwise(
            F.concat(F.lit(" Violations found: "), F.array_join("threats", ", "))
        ),
    )
    return out.select(
        *df.columns,
        pinned(is_safe).alias("is_safe"),
        pinned("threats").alias("threats"),
        pinned(F.when(_has_bytes(c), message).otherwise("No file attachment scanned.")).alias("explanation"),
        pinned(F.when(is_safe & _has_bytes(c), F.col("_text"))).alias("extracted_text"),
    )
