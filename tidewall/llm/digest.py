"""Document fingerprints: a quartile bucket digest and a bounded difference between two of them.

All byte triplets of a text are hashed into buckets and counted; a bucket is written as the quartile that its count falls
in (two bits), in front of it stand the text's length (logarithmic) and the ratios of the quartiles.  Two digests differ
by the distance of their quartile codes, where opposite quartiles weigh more, and of their heads; the difference is
bounded and `likeness` turns it into 1 (equal) to 0.

Defined results: a null or empty text has the digest of no triplets (all zero); texts under three bytes differ from it
only in length; the digest of equal texts is equal; a lone document's next one is itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.common import stored, utf8

BUCKETS = 256
BLOCK = 1 << 20
_COST = np.array([0, 1, 2, 4], np.int64)  # by the distance of two quartile codes
_COSTS = _COST[np.abs(np.arange(4)[:, None] - np.arange(4))]
#: For each pair of bytes of four codes the cost between them.
_PAIRS = sum(_COSTS[(np.arange(256)[:, None] >> s) & 3, (np.arange(256)[None, :] >> s) & 3] for s in (0, 2, 4, 6))
_HEAD_WEIGHT = 4


def bucket_counts(raw: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is met; the text is taken in blocks, so memory is bounded."""
    counts = np.zeros(buckets, np.int64)
    shift = np.uint32(32 - int(math.log2(buckets)))
    for start in range(0, max(0, len(raw) - 2), BLOCK):
        x = np.frombuffer(raw, np.uint8, min(BLOCK + 2, len(raw) - start), start).astype(np.uint32)
        triplets = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
        counts += np.bincount(triplets * np.uint32(2654435761) >> shift, minlength=buckets)
    return counts


def digest(raw: bytes, buckets: int = BUCKETS) -> bytes:
    """Length, two ratios of quartiles (a byte each), then two bits for each bucket."""
    counts = bucket_counts(raw, buckets)
    length = min(255, round(12 * math.log2(1 + len(raw))))
    if not counts.any():
        return bytes([length, 0, 0]) + bytes(buckets // 4)
    ordered = np.partition(counts, [buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1])
    q1, q2, q3 = (int(ordered[buckets * k // 4 - 1]) for k in (1, 2, 3))
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    top = max(q3, 1)
    return bytes([length, q1 * 63 // top, q2 * 63 // top]) + packed.astype(np.uint8).tobytes()


def difference(a: bytes, b: bytes) -> int:
    """0 for equal digests, at most `bound`."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    head = np.abs(x[:3].astype(np.int64) - y[:3])
    head = max(0, int(head[0]) - 1) + int(head[1]) // 8 + int(head[2]) // 8
    return int(_PAIRS[x[3:], y[3:]].sum()) + _HEAD_WEIGHT * min(head, 32)


def bound(buckets: int = BUCKETS) -> int:
    return buckets * int(_COST[-1]) + _HEAD_WEIGHT * 32


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests; half of all the cost that is possible, or more, is 0."""
    return max(0.0, 1.0 - 2.0 * difference(a, b) / bound(4 * (len(a) - 3)))


def edited_text(text: str, following: str) -> str:
    """The last third replaced with as many characters from the start of the following text, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(text: bytes, mark: bytes, following: bytes, following_mark: bytes) -> tuple:
    string = text.decode()
    edited = edited_text(string, following.decode()).encode()
    edited_mark = digest(edited)
    return (
        len(string), hashlib.sha256(edited).hexdigest(), mark.hex(), edited_mark.hex(),
        likeness(mark, edited_mark), likeness(mark, following_mark),
    )


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
     ("edge", pa.int32()), ("part", pa.int32()), ("text", pa.string())]
)


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (`doc_id`, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`, `near_edited`, `near_next`).

    The next document is the one with the next smaller id (equal ids: in order of their text; null is the smallest), the
    last one's is the first.  One range shuffle puts neighbours side by side; a task reads its rows in ascending order
    and needs only the row before.  The first row of a task has its neighbour in the task before: both are passed on as
    edges, two rows a task, and compared after.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                block, out = batch.slice(start, 128), []
                for doc_id, raw in zip(block.column(0).to_pylist(), utf8(block.column(1))):
                    mark = digest(raw)
                    if before is None:
                        out.append((doc_id, *[None] * 6, 0, part, raw.decode()))
                    else:
                        out.append((doc_id, *_compare(raw, mark, *before), None, None, None))
                    before, last = (raw, mark), doc_id
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)
        if before is not None:
            out = [(last, *[None] * 6, 1, part, before[0].decode())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)

    done = stored(ordered.mapInArrow(run, f"{_SCHEMA}, edge int, part int, text string"), "digest")
    edges = done.where("edge IS NOT NULL")
    # Two rows a task: the last of the task before, or of all for the very first.
    every = Window.orderBy("part", "edge").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = Window.orderBy("part", "edge")
    pairs = edges.select(
        "doc_id", "edge", "text", F.coalesce(F.lag("text").over(step), F.last("text").over(every)).alias("following")
    ).where("edge = 0")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _ARROW.names[:7]
        for batch in batches:
            out = []
            for doc_id, own, following in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), utf8(batch.column(2))):
                out.append((doc_id, *_compare(own, digest(own), following, digest(following))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], names)

    compared = pairs.select("doc_id", "text", "following").mapInArrow(join, _SCHEMA)
    return done.where("edge IS NULL").drop("edge", "part", "text").unionByName(compared)
