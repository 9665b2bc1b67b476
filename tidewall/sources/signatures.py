"""Signature table: signature_id, pattern, embedding, added_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall import fixed


def _valid(dim: int) -> Column:
    return F.coalesce((F.length("pattern") > 0) & (F.size("embedding") == dim), F.lit(False))


def register_signatures(candidates: DataFrame, dim: int = fixed.SIGNATURE_DIM) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) candidates; rejected rows carry an error text."""
    accepted = candidates.filter(_valid(dim))
    error = F.when(F.coalesce(F.length("pattern"), F.lit(0)) == 0, F.lit("Signature text is empty.")).otherwise(
        F.lit(f"Vector embedding must contain exactly {dim} float dimensions.")
    )
    return accepted, candidates.filter(~_valid(dim)).withColumn("error", error)


def append_signatures(candidates: DataFrame, path: str, dim: int = fixed.SIGNATURE_DIM) -> None:
    """Append valid signatures to the table and the others to `<path>_rejected`."""
    accepted, rejected = register_signatures(candidates, dim)
    accepted.write.mode("append").parquet(path)
    rejected.write.mode("append").parquet(f"{path}_rejected")


def list_signatures(signatures: DataFrame) -> DataFrame:
    """Newest first, without the vectors."""
    return signatures.select("signature_id", "pattern", "added_at").orderBy(F.col("added_at").desc(), "signature_id")
