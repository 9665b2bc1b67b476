"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of learned lexicons, how near their words stand to second-person words, and the rates of
capitals, punctuation, stretched letters and letters hidden behind signs.  The lexicons are beginnings of words (three to
eight characters) that labelled toxic texts have and others do not, each with a weight; they are learned from the same
labelled rows as the trees.

Learning uses a bounded sample of the labelled rows (`sample`, in a seeded order); counting, trees (MLlib) and the
calibration run on Spark.  One third of the sample learns the lexicons, one third the trees, one third the calibration,
so that neither is flattered by what it has seen.  Scoring covers every row: features in one Arrow pass, trees and
calibration on the JVM.

Defined results: null and empty texts have all features 0 and get the score of such a text; a null id is never held out
and never labelled; repeated rows score alike; where the labels do not hold both classes, every score is the share of
toxic labels (0 without labels).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import enter, stored, utf8

#: Most labelled rows that learning looks at.
SAMPLE = 24_000
LEXICON = 4_000
SHORTEST, LONGEST = 3, 8
#: Second-person words, by which a text speaks to someone.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú usted ti tus vosotros".split())
FEATURES = (
    "words", "strong_density", "strong_count", "strong_share", "weak_density", "weight_mean", "weight_top", "near_you",
    "you_density", "capitals", "punctuation", "exclaims", "stretched", "hidden", "digits",
)
_WORD = regex.compile(r"[\w*@$!]*\w[\w*@$]*")
_STRETCHED = regex.compile(r"(\p{L})\1\1")
_HIDDEN = regex.compile(r"\p{L}[*@$#0134]+\p{L}")
_PLAIN = str.maketrans("@$013457", "asoieast")


def held_out(id: Column) -> Column:
    """Every fifth document by the checksum of its id."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def beginnings(word: str) -> Iterator[str]:
    for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
        yield word[:n]
    if len(word) >= SHORTEST:
        yield word + "$"


def words_of(text: str) -> list[str]:
    """Lower-case words; signs that stand for letters are put back."""
    out = []
    for word in _WORD.findall(text.lower()):
        out.append(word if word.isalpha() else word.translate(_PLAIN) if any(c.isalpha() for c in word) else word)
    return out


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Weights of word beginnings by how much more toxic texts have them (smoothed log odds of the document counts).

    Counted per task and then over all; only the `size` heaviest come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, held = Counter(), Counter(), 0

        def flush():
            keys = list(toxic | clean)
            columns = [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["start", "toxic", "clean"])

        for batch in batches:
            for raw, label in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                (toxic if label else clean).update({b for w in set(words_of(raw.decode())) for b in beginnings(w)})
            held = len(toxic) + len(clean)
            if held > 400_000:
                yield flush()
                toxic, clean = Counter(), Counter()
        yield flush()

    totals = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = sample.select("text", "toxic").mapInArrow(count, "start string, toxic long, clean long")
    odds = F.log((F.col("t") + 0.02) / (n1 + 1.0)) - F.log((F.col("c") + 0.2) / (n0 + 1.0))
    least = max(2, n1 // 400)
    top = (
        counts.groupBy("start").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= least)
        .select("start", odds.alias("w"), "t").where("w > 1.0").orderBy(F.col("w") * F.sqrt("t"), "start", ascending=False).limit(size)
    )
    return {row["start"]: row["w"] for row in top.collect()}


def features(text: str, lexicon: dict[str, float], strong: float) -> list[float]:
    words = words_of(text)
    if not words:
        return [0.0] * len(FEATURES)
    weights, you = {}, []
    for word in set(words):
        found = [lexicon[b] for b in beginnings(word) if b in lexicon]
        if found:
            weights[word] = max(found)
    hits = []
    for at, word in enumerate(words):
        if word in weights:
            hits.append((at, weights[word]))
        if word in YOU:
            you.append(at)
    n, chars = len(words), len(text)
    heavy = [(at, w) for at, w in hits if w >= strong]
    near = 0.0
    if heavy and you:
        places = np.array(you)
        near = sum(1.0 / (1 + np.abs(places - at).min()) for at, _ in heavy) / len(heavy)
    letters = sum(map(str.isalpha, text)) or 1
    return [
        math.log1p(n), 100 * len(heavy) / n, math.log1p(len(heavy)), len({words[at] for at, _ in heavy}) / (1 + len(weights)),
        100 * len(hits) / n, sum(w for _, w in hits) / n, max((w for _, w in hits), default=0.0), near, 100 * len(you) / n,
        100 * sum(map(str.isupper, text)) / letters, 100 * sum(map(text.count, ".,;:!?")) / chars, 100 * text.count("!") / chars,
        100 * sum(1 for _ in _STRETCHED.finditer(text)) / n, 100 * sum(1 for _ in _HIDDEN.finditer(text)) / n,
        100 * sum(map(str.isdigit, text)) / chars,
    ]


def with_features(docs: DataFrame, text: str, lexicon: dict[str, float]) -> DataFrame:
    """Adds `_features` (array<double>).  The lexicon is bounded, so it travels with the function."""
    ranked = sorted(lexicon.values(), reverse=True)
    strong = 3.0 if ranked else 0.0

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        enter("toxicity")
        rows = [features(raw.decode(), lexicon, strong) for raw in utf8(column)]
        return pa.array(rows, pa.list_(pa.float64()))

    return docs.withColumn("_features", run(F.col(text)))


class Model:
    """Learned lexicon, trees and calibration; `score` reads any table with texts."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, constant: float | None = None):
        self._lexicon, self._trees, self._calibration, self._constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Rows (`row`, `score`): each row of `docs` as one struct, so that its columns may have any names."""
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).cast("string").alias("text"))
        if self._constant is not None:
            return rows.select("row", F.lit(self._constant).alias("score"))
        raw = _raw(with_features(rows, "text", self._lexicon).drop("text"), self._trees)
        return self._calibration.transform(raw).select(
            "row", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_calibrated"))).alias("score")
        )


def _vectors(df: DataFrame) -> DataFrame:
    columns = [F.get("_features", F.lit(k)).alias(f"_f{k}") for k in range(len(FEATURES))]
    wide = df.select("*", *columns)
    names = [f"_f{k}" for k in range(len(FEATURES))]
    return VectorAssembler(inputCols=names, outputCol="_vector").transform(wide).drop(*names)


def _raw(df: DataFrame, trees) -> DataFrame:
    return trees.transform(_vectors(df)).drop("_vector")


def fit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from labelled rows that are not held out, at most `sample` of them, the first in the order of a hash."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).where(~held_out(F.col(id))).groupBy(
        F.col(id).cast("long").alias("_id")
    ).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample).withColumn("_third", F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(3)))
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "_id"  # ids and labels of `sample` rows at most; the texts are not moved
    )
    rows = stored(rows, "toxicity-sample")
    shares = {(r["_third"], r["toxic"]) for r in rows.select("_third", "toxic").distinct().collect()}
    if len(shares) < 6:
        share = rows.agg(F.avg("toxic")).first()[0]
        if len({toxic for _, toxic in shares}) < 2:
            return Model({}, None, None, float(share or 0.0))
        rows = rows.withColumn("_third", F.lit(None).cast("long"))  # so few rows that all of them serve for everything

    def third(k: int) -> Column:
        return F.col("_third").isNull() | (F.col("_third") == k)

    lexicon = learn_lexicon(rows.where(third(0)))
    marked = stored(with_features(rows.where("_third IS NULL OR _third > 0"), "text", lexicon).drop("text"), "toxicity-features")
    trees = GBTRegressor(
        featuresCol="_vector", labelCol="toxic", predictionCol="_raw", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=32, seed=7,
        minInstancesPerNode=5, cacheNodeIds=False,
    ).fit(_vectors(marked.where(third(1))).select("_vector", "toxic"))
    raw = _raw(marked.where(third(2)), trees).select("_raw", F.col("toxic").cast("double").alias("toxic"))
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="toxic", predictionCol="_calibrated").fit(raw)
    return Model(lexicon, trees, calibration)
