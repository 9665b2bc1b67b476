"""Quality: a factorisation machine over hashed words, statistics of a text's structure, and metadata.

A text is a sparse vector: its words hashed into `BUCKETS` (log counts, scaled to length one), statistics of its structure and
the metadata columns (standardised, bounded).  The machine adds to the linear score half of the sum over all pairs of
features of <v_i, v_j> x_i x_j with vectors of `RANK` numbers.  It is never summed over pairs: it equals half of the sum over
the ranks of (sum of v x) squared minus the sum of (v x) squared, which one pass over a text's features gives.

Learning uses a bounded sample of the labelled rows (`sample`, the first in the order of a hash): one task makes steps of
AdaGrad over batches of it (it is bounded, so is the task), four fifths for the machine, the last fifth for a logistic
calibration of its scores.  Features and scores are made where the rows lie, without a shuffle.

Defined results: null and empty texts have no words and zero statistics, and get the score of such a text; a missing or null
metadata value counts as the mean, a column that `docs` lacks as null; a null id is never held out and never labelled;
repeated rows score alike; where the labels do not hold both classes every score is the share of good ones (0 without any).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import enter, stored, task, utf8
from tidewall.llm.toxicity import held_out

#: Most labelled rows that learning looks at.
SAMPLE = 12_000
BUCKETS = 1 << 16
RANK = 8
EPOCHS = 6
BATCH = 128
STEP = 0.1
DECAY = 1e-5
SEED = 11
STATISTICS = (
    "words", "word_length", "distinct_words", "top_word", "repeated_triples", "lines", "line_length", "repeated_lines", "words_a_sentence",
    "lower", "upper", "digits", "spaces", "ends", "punctuation", "symbols", "beyond_ascii",
)
_BOUND, _SCALE = 4.0, 0.4

_CLASSES = np.full(256, 6, np.int64)  # other signs
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\n\x0b\x0c\r", b".!?", b",;:'\"()-", (), range(128, 256))):
    _CLASSES[list(_chars)] = _k


def statistics(raw: bytes, words: list[bytes], hashes: np.ndarray) -> list[float]:
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    shares = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=8) / size
    lines = [line for line in raw.split(b"\n") if line.strip()]
    counts = np.unique(hashes, return_counts=True)[1]
    triples = hashes[:-2] * 1_000_003 + hashes[1:-1] * 1009 + hashes[2:]
    repeated = 1 - len(np.unique(triples)) / len(triples) if n > 2 else 0.0
    sentences = shares[4] * size
    return [
        math.log1p(n), sum(map(len, words)) / n, len(counts) / n, int(counts.max()) / n, repeated, math.log1p(len(lines)),
        math.log1p(size / len(lines)), 1 - len(set(lines)) / len(lines), math.log1p(n / (1 + sentences)), *shares.tolist(),
    ]


class Features:
    """Sparse rows of several texts: for each entry its row, feature and value, by row; and the dense part."""

    def __init__(self, texts: Iterator[bytes], metadata: np.ndarray):
        keys, dense, n = [], [], 0
        for raw in texts:
            words = raw.lower().split()
            hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
            keys.append((hashes & (BUCKETS - 1)) | n << 32)
            dense.append(statistics(raw, words, hashes))
            n += 1
        keys, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        self.n, self.row, self.bucket = n, keys >> 32, keys & (BUCKETS - 1)
        value = np.log1p(counts)
        self.value = value / np.sqrt(np.bincount(self.row, value**2, n))[self.row] if len(keys) else value
        self.dense = np.hstack([np.array(dense, float).reshape(n, len(STATISTICS)), metadata.reshape(n, -1)])


def _numbers(columns: list[pa.Array], n: int) -> np.ndarray:
    """Metadata as log magnitudes, NaN for null."""
    out = np.full((n, len(columns)), np.nan)
    for k, column in enumerate(columns):
        values = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, k] = np.sign(values) * np.log1p(np.abs(values))
    return out


class Machine:
    """Weights: bias, linear weights and vectors of the buckets and, behind them, of the dense features."""

    def __init__(self, bias: float, linear: np.ndarray, vectors: np.ndarray, mean: np.ndarray, spread: np.ndarray, a: float = 1.0, b: float = 0.0):
        self.bias, self.linear, self.vectors, self.mean, self.spread, self.a, self.b = bias, linear, vectors, mean, spread, a, b

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        out = np.clip((dense - self.mean) / self.spread, -_BOUND, _BOUND) * _SCALE
        return np.where(np.isfinite(out), out, 0.0)

    def raw(self, x: Features) -> np.ndarray:
        """Scores in time linear in the features, by sums and sums of squares."""
        dense, more = self.scaled(x.dense), slice(BUCKETS, None)
        score = self.bias + np.bincount(x.row, self.linear[x.bucket] * x.value, x.n) + dense @ self.linear[more]
        sums, squares = dense @ self.vectors[more], (dense**2) @ (self.vectors[more] ** 2)
        for f in range(RANK):
            weighted = self.vectors[x.bucket, f] * x.value
            total = sums[:, f] + np.bincount(x.row, weighted, x.n)
            score += 0.5 * (total**2 - squares[:, f] - np.bincount(x.row, weighted**2, x.n))
        return score

    def probability(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -30, 30)))


def learn(texts: list[bytes], metadata: np.ndarray, labels: np.ndarray, *, epochs: int = EPOCHS, step: float = STEP) -> Machine:
    """AdaGrad over batches in a seeded order; every fifth text is kept for the calibration."""
    rng = np.random.default_rng(SEED)
    last = np.arange(len(texts)) % 5 == 4
    if len(set(labels[last].tolist())) < 2 or len(set(labels[~last].tolist())) < 2:
        last[:] = False
    learned, kept = np.flatnonzero(~last), np.flatnonzero(last)

    def rows(which: np.ndarray) -> Features:
        return Features((texts[k] for k in which.tolist()), metadata[which])

    order = rng.permutation(learned)
    batches = np.array_split(order, max(1, len(order) // BATCH))
    held = [(rows(part), labels[part].astype(float)) for part in batches]
    dense = np.vstack([x.dense for x, _ in held])
    with np.errstate(all="ignore"):
        known = np.isfinite(dense)
        mean = np.where(known, dense, 0).sum(0) / np.maximum(known.sum(0), 1)
        spread = np.sqrt((np.where(known, dense - mean, 0) ** 2).sum(0) / np.maximum(known.sum(0), 1)) + 1e-6
    size = BUCKETS + dense.shape[1]
    share = float(np.clip(labels[learned].mean(), 0.01, 0.99))
    model = Machine(math.log(share / (1 - share)), np.zeros(size), rng.normal(0, 0.02, (size, RANK)), mean, spread)
    seen_linear, seen_vectors = np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    # Entries of each batch in order of their features, so that gradients are sums of stretches.
    plans = []
    for x, y in held:
        by = np.argsort(x.bucket, kind="stable")
        features, starts = np.unique(x.bucket[by], return_index=True)
        plans.append((x, y, model.scaled(x.dense), by, features, starts))
    more = slice(BUCKETS, None)
    for _ in range(epochs):
        for k in rng.permutation(len(plans)).tolist():
            x, y, dense, by, features, starts = plans[k]
            v = model.vectors[x.bucket] * x.value[:, None]
            totals = dense @ model.vectors[more]
            squares = (dense**2) @ (model.vectors[more] ** 2)
            for f in range(RANK):
                totals[:, f] += np.bincount(x.row, v[:, f], x.n)
                squares[:, f] += np.bincount(x.row, v[:, f] ** 2, x.n)
            score = model.bias + np.bincount(x.row, model.linear[x.bucket] * x.value, x.n) + dense @ model.linear[more]
            score += 0.5 * (totals**2 - squares).sum(1)
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / x.n
            model.bias -= step * error.sum()
            of_entry = error[x.row] * x.value
            linear = np.add.reduceat(of_entry[by], starts) if len(by) else np.zeros(0)
            gradient = of_entry[:, None] * (totals[x.row] - v)
            vectors = np.add.reduceat(gradient[by], starts, axis=0) if len(by) else np.zeros((0, RANK))
            touched = np.append(features, np.arange(BUCKETS, size))
            linear = np.append(linear, error @ dense) + DECAY * model.linear[touched]
            own = (dense * error[:, None]).T @ totals - ((dense**2) * error[:, None]).sum(0)[:, None] * model.vectors[more]
            vectors = np.vstack([vectors, own]) + DECAY * model.vectors[touched]
            seen_linear[touched] += linear**2
            seen_vectors[touched] += vectors**2
            model.linear[touched] -= step * linear / np.sqrt(seen_linear[touched])
            model.vectors[touched] -= step * vectors / np.sqrt(seen_vectors[touched])
    if len(kept):
        model.a, model.b = _calibrate(model.raw(rows(kept)), labels[kept].astype(float))
    return model


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the scores, by Newton's steps with a weak pull to (1, 0)."""
    x = np.column_stack([raw, np.ones(len(raw))])
    w, centre = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + (w - centre)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        w = w - np.linalg.solve(curve, gradient)
    return float(max(w[0], 0.05)), float(w[1])


class Model:
    """The learned machine, or a constant; `score` reads any table with texts."""

    def __init__(self, machine: Machine | None, metadata: tuple[str, ...], constant: float = 0.0):
        self._machine, self._metadata, self._constant = machine, metadata, constant

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Rows (`row`, `score`): each row of `docs` as one struct, so that its columns may have any names."""
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
        if self._machine is None:
            return docs.select(row, F.lit(self._constant).alias("score"))
        machine = self._machine

        @F.arrow_udf("double")
        def run(texts: pa.Array, *metadata: pa.Array) -> pa.Array:
            enter("quality")
            out = []
            for start in range(0, len(texts), 256):
                some = texts.slice(start, 256)
                numbers = _numbers([m.slice(start, 256) for m in metadata], len(some))
                out.append(machine.probability(Features(utf8(some), numbers)))
            return pa.array(np.concatenate(out) if out else np.zeros(0))

        return docs.select(row, run(F.col(text).cast("string"), *_metadata(docs, self._metadata)).alias("score"))


def _metadata(docs: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast("double") for c in names]


def fit(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality",
    metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE,
) -> Model:
    """Learns from labelled rows that are not held out, at most `sample` of them, the first in the order of a hash."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).where(~held_out(F.col(id))).groupBy(
        F.col(id).cast("long").alias("id")
    ).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(
        F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.array(*_metadata(docs, metadata)).alias("metadata")
    ).join(F.broadcast(chosen), "id")  # ids and labels of `sample` rows at most; the texts are not moved
    rows = stored(rows, "quality-sample")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return Model(None, metadata, counts.get(1, 0) / max(1, sum(counts.values())))

    @task("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, numbers, labels_ = [], [], []
        for batch in batches:
            texts += utf8(batch["text"])
            columns = [pa.array(c, pa.float64()) for c in zip(*batch["metadata"].to_pylist())] if metadata else []
            numbers.append(_numbers(columns, batch.num_rows) if batch.num_rows else np.zeros((0, len(metadata))))
            labels_ += batch["label"].to_pylist()
        model = learn(texts, np.vstack(numbers), np.array(labels_))
        parts = [np.array([model.bias, model.a, model.b]), model.linear, model.vectors.ravel(), model.mean, model.spread]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(range(5))], ["part", "k"])

    # One task over a bounded sample, in a fixed order.
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "text")
    parts = [np.frombuffer(r["part"]) for r in sorted(ordered.mapInArrow(run, "part binary, k long").collect(), key=lambda r: r["k"])]
    bias, a, b = parts[0].tolist()
    return Model(Machine(bias, parts[1], parts[2].reshape(-1, RANK), parts[3], parts[4], a, b), metadata)
