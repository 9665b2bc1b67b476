"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source gets words in proportion to its weight, but at most `max_epochs` times its own size; what a capped source
leaves is dealt again to the others by weight until none is above its cap.  A source that is to be taken 1.4 times takes
every document once and, in a seeded order of its documents, as many a second time as make up the 0.4.

No source is gathered anywhere: where the fractional part ends is found by narrowing histograms of the documents' seeded
hash (4,096 cells a source, summed before the shuffle, three levels), so a source that holds most rows is as cheap as
many small ones.

Defined results: a null text has size 0 and takes 0 words; null is a source of its own, the last one; documents of equal
id and source share their hash and are repeated alike; sources without words have target 0; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
CELL_BITS = 12
LEVELS = 3
WEIGHTS = (1.0, 2.0, 3.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights dealt to the sources in order of code points, null last, over and over.  One row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    return sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds `_target` to (`_source`, `_words`, `_weight`).

    Each round clamps the sources whose share is above their cap and deals the rest again; the level only rises, so a
    clamped source stays clamped, and the rounds end when a level clamps no further source.
    """
    cap = F.col("_words") * F.lit(float(max_epochs))
    level, clamped = None, -1
    while True:
        full = F.lit(False) if level is None else cap <= F.col("_weight") * F.lit(level)
        state = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("spent"),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(full, 1)).alias("clamped"),
        ).first()
        if state.clamped == clamped or state.weight <= 0:
            break
        clamped, level = state.clamped, max(0.0, budget - state.spent) / state.weight
    share = cap if level is None or state.weight <= 0 else F.least(cap, F.col("_weight") * F.lit(level))
    return sources.withColumn("_target", share.cast("double"))


def plan(
    docs: DataFrame, id: str, text: str, source: str, weights: tuple[float, ...], share: float, max_epochs: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Sizes of the documents (`doc_id`, `source`, `size`, `_hash`), and for each source its target, whole epochs and cut."""
    sized = stored(
        docs.select(
            F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            _hash(id, source, seed).alias("_hash"),
        ),
        "mix-sizes",
    )
    per_source = stored(
        sized.groupBy(F.col("source").alias("_source")).agg(F.sum("size").cast("double").alias("_words")), "mix-sources"
    )
    budget = share * (per_source.agg(F.sum("_words")).first()[0] or 0.0)
    targets = water_fill(cyclic_weights(per_source, weights), budget, max_epochs)
    epochs = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(F.lit(0.0))
    # An epoch a hair below a whole number is that number, else rounding would take none a third time.
    whole = F.floor(epochs + F.lit(1e-9))
    filled = stored(
        targets.withColumn("_whole", whole)
        .withColumn("_rest", F.greatest(F.col("_target") - F.col("_whole") * F.col("_words"), F.lit(0.0))),
        "mix-plan",
    )
    return sized, _cut(sized, filled)


def _hash(id: str, source: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id).cast("string"), F.col(source))


def _repeats(hashed: Column) -> Column:
    extra = F.when(_position(hashed) < F.col("_cut"), 1).otherwise(0)
    return (F.col("_whole") + extra).cast("long")


def mix(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    max_epochs: float = 3.0,
    seed: int = 42,
) -> DataFrame:
    """Rows (`doc_id`, `source`, `size`, `source_size`, `target`, `repeats`, `taken`), one per row of `docs`."""
    sized, bounds = plan(docs, id, text, source, weights, share, max_epochs, seed)
    # One row per source: broadcast where Spark proves it small, else a join that splits a hot source.
    out = sized.join(bounds, F.col("source").eqNullSafe(F.col("_source")), "left")
    repeats = _repeats(F.col("_hash"))
    return out.select(
        "doc_id", "source", "size", F.col("_words").cast("long").alias("source_size"), F.col("_target").alias("target"),
        repeats.alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"),
    )


def mixture(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    max_epochs: float = 3.0,
    seed: int = 42,
) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with the columns of `docs`, whatever their names."""
    _, bounds = plan(docs, id, text, source, weights, share, max_epochs, seed)
    bounds = bounds.select("_source", "_whole", "_cut")
    # The caller's columns travel as one, so their names meet none of these.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source).alias("source"),
        _hash(id, source, seed).alias("_hash"),
    )
    joined = rows.join(bounds, F.col("source").eqNullSafe(F.col("_source")))
    times = joined.select("row", _repeats(F.col("_hash")).alias("times")).where("times > 0")
    repeated = times.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return repeated.select("row.*")


def _position(hashed: Column) -> Column:
    """The leading bits of the hash as a number from 0; a document is in the fraction if it lies below the cut."""
    return F.shiftrightunsigned(hashed, 64 - CELL_BITS * LEVELS)


def _cut(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds `_cut` to the plan: documents at positions below it make up the fractional words as nearly as can be."""
    found = plan.withColumn("_cut", F.lit(0).cast("long"))
    for step in range(1, LEVELS + 1):
        below = CELL_BITS * (LEVELS - step)  # bits that this level leaves open
        cell = F.shiftright(_position(F.col("_hash")), below)
        inside = F.shiftright(F.col("_cut"), below + CELL_BITS) == F.shiftright(cell, CELL_BITS)
        cells = (
            sized.join(found.select("_source", "_cut", "_rest"), F.col("source").eqNullSafe(F.col("_source")))
            .where((F.col("_rest") > 0) & inside)
            .groupBy("_source", cell.alias("_cell")).agg(F.sum("size").alias("_in"))
        )
        ordered = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        upto = cells.withColumn("_sum", F.sum("_in").over(ordered))
        joined = upto.join(found.select(F.col("_source").alias("_s"), "_rest"), F.col("_source").eqNullSafe(F.col("_s")))
        left = F.col("_rest") - (F.col("_sum") - F.col("_in"))  # words still open before this cell
        # The cut lies in the first cell that is too large for the rest; at the last level, where that cell's larger part
        # would be left out.  Where none is, it lies behind the last cell.
        take = (F.col("_sum") <= F.col("_rest")) if step < LEVELS else (left * 2 >= F.col("_in"))
        edge = joined.groupBy(F.col("_source").alias("_s")).agg(
            F.coalesce(F.min(F.when(~take, F.col("_cell"))), F.max("_cell") + 1).alias("_at"),
            F.max(F.when(take, F.col("_sum"))).alias("_spent"),
        )
        start = F.coalesce(F.col("_at"), F.shiftright(F.col("_cut"), below))
        found = stored(
            found.join(edge, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
                "_source", "_words", "_weight", "_target", "_whole",
                (F.col("_rest") - F.coalesce("_spent", F.lit(0))).alias("_rest"),
                F.shiftleft(start, below).cast("long").alias("_cut"),
            ),
            "mix-cut",
        )
    return found
