"""Prompt and attachment sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.functions.text import is_blank


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores where the input has fewer splits than the cluster has cores.

    Screening costs far more per byte than moving it, and one big row group would otherwise be one task.  Large inputs
    already have enough splits and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if not df.isStreaming and df.rdd.getNumPartitions() < cores * 2 else df


def accept(df: DataFrame, prompt: str = "prompt", encoded: str | None = "file_base64", session: str = "session_id") -> DataFrame:
    """Keep requests that hold something to screen.

    A request is refused only where the prompt is blank and there is no file text; the test reads the encoded text, so
    a file that cannot be decoded still counts.  Session ids have 1 to 255 characters.
    """
    something = ~is_blank(prompt)
    if encoded is not None:
        something = something | (F.length(F.coalesce(F.col(encoded), F.lit(""))) > 0)
    return df.filter(something & F.length(session).between(1, 255))


def load_prompts(spark: SparkSession, path: str, streaming: bool = False, schema=None, **columns: str) -> DataFrame:
    """Read prompt rows from Parquet, as a batch or as a stream, and apply `accept`."""
    if streaming:
        rows = spark.readStream.schema(schema).parquet(path)
    else:
        rows = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if "encoded" not in columns and "file_base64" not in rows.columns:
        columns["encoded"] = None
    return accept(rows, **columns)


def decode_attachment(encoded: Column | str) -> Column:
    """Base64 text to bytes; text that cannot be decoded means no file.

    Characters outside the alphabet are skipped, but the padding must be complete: Spark's own decoder is more lenient.
    """
    text = F.col(encoded) if isinstance(encoded, str) else encoded
    kept = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    digits = F.regexp_extract(kept, "^([A-Za-z0-9+/]*)(=*)", 1)
    padding = F.length(F.regexp_extract(kept, "^([A-Za-z0-9+/]*)(=*)", 2))
    rest = F.length(digits) % 4
    complete = (rest == 0) | ((rest == 2) & (padding >= 2)) | ((rest == 3) & (padding >= 1))
    padded = F.concat(digits, F.repeat(F.lit("="), (4 - rest) % 4))
    return F.when(complete, F.try_to_binary(padded, F.lit("base64")))


def load_attachments(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder tree: file_name, size, content."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return found.select(
        F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file_name"), F.col("length").alias("size"), "content"
    )
