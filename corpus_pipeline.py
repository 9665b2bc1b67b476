"""A training corpus from the documents: toxic ones out, one of each group of near copies, repeated passages out,
sources mixed to weights, texts as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.llm import bpe, mixing, simhash, suffix, toxicity
from tidewall.llm.common import ship, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated toxicity score below one half; the labels of `sf_dir` teach the score.

    Null and empty texts get the score of a text without words; repeated rows go or stay together.
    """
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).where(F.col("score") < 0.5).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints of three-word shingles, linked at 3 or fewer differing bits) the document
    with the smallest id; texts without words are one group; of documents without ids one stays where no other does."""
    ship(spark)
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller id has are cut out; `n_chars` follows the text.

    No row goes: a text that is all repeats is left empty, a null one stays null, ids without a value come last.
    """
    ship(spark)
    cleaned = suffix.clean(docs)
    if "n_chars" in cleaned.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for every time, up to three; a null source is a source of its own."""
    ship(spark)
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (`doc_id`, `n_tokens`, `ids_sha256`, `decoded_sha256`, `ids`), one per row; null and empty texts have no ids."""
    import public_tokenizers

    ship(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(docs, ranks, pattern, keep_ids=True, memory=ENCODER_BYTES, keep=False)


#: The executors have run four stages when the encoder comes, and their heaps are large by then; an executor of two cores
#: may have four Python workers that take turns.  So an encoder is small, and only a worker with a task has one.
ENCODER_BYTES = 32 << 20

STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: XXH64, trees and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
