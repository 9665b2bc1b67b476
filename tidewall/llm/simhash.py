"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32.  If two fingerprints differ in at most three bits, they differ
in at most one bit within one of the segments, so both lie in that segment's Hamming ball of radius one.  Every distinct
fingerprint stands in two tables under its exact segments, and looks up the ball around each; of two values that differ
in one bit it is enough that the one with the bit set looks for the one without.  Matches are verified on all 64 bits.

Copies cost nothing: documents are first grouped by fingerprint, and only distinct fingerprints take part.  A segment
value that very many fingerprints share is never joined row by row: the fingerprints under a value are packed into
blocks of bounded size, blocks meet blocks, and a pair of blocks reports a spanning forest of its links, at most one row
per fingerprint, not all pairs.

Defined results: texts without words (null and empty ones too) have fingerprint zero and are linked like any other; a
null id is grouped and reported, but never names a component unless nothing else is there; repeated rows come out as
often as they go in; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.common import enter, stored, task, utf8
from tidewall.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCK = 1024
HOT = 1000
SALTS = 16
_CHUNK = 1 << 15
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(raw, shingle, seed)
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        total += bit_counts(hashes[at : at + _CHUNK])
    return int(np.packbits(total[::-1] * 2 > len(hashes)).view(">u8")[0])


def shingle_hashes(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle; fewer words are one shingle, none give none."""
    words = raw.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    # The words with single spaces between them; a shingle is a stretch of that.
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    stops = (starts + lengths)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), stops)), np.uint64, len(stops))


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How many of the values have each bit set, lowest bit first."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (`doc_id`, `fp`): the fingerprint as a signed long.  No shuffle."""

    return docs.select(F.col(id).cast("long").alias("doc_id"), _marker()(F.col(text).cast("string")).alias("fp"))


def _marker():
    @F.arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        enter("simhash")
        values = np.fromiter((fingerprint(raw) for raw in utf8(column)), np.uint64, len(column))
        return pa.array(values.view(np.int64))

    return run


def _segment(fp: Column, k: int) -> Column:
    return (F.shiftright(fp, 32) if k else F.shiftright(F.shiftleft(fp, 32), 32)).cast("int")


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows (`a`, `b`): links between fingerprints of the column `fp` (each once) that leave no component apart.

    `distance` may be up to 3: two segments and balls of radius one find no more.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one find up to three bits")
    spread = max(64, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    exact = [F.struct(F.lit(k).alias("k"), _segment(F.col("fp"), k).alias("v")) for k in (0, 1)]
    # Blocks of the table: fingerprints under one segment value, dealt by hash, so that a block has about BLOCK of them
    # at most; how many blocks a value needs is counted first (sums before the shuffle).
    table = distinct.select("fp", F.explode(F.array(*exact)).alias("s")).select("fp", "s.k", "s.v")
    crowded = table.groupBy("k", "v").count().where(F.col("count") > BLOCK).select("k", "v", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    crowded = stored(crowded, "simhash-crowded")
    slot = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.lit(0))
    table = table.join(crowded, ["k", "v"], "left").select("k", "v", slot.alias("slot"), F.coalesce("parts", F.lit(1)).alias("parts"), "fp")
    blocks = stored(
        table.groupBy("k", "v", "slot", "parts").agg(F.collect_list("fp").alias("held")), "simhash-blocks"
    )  # a list holds about BLOCK fingerprints: the slots of a value see to that
    own = blocks.where((F.size("held") > 1) | (F.col("parts") > 1))
    others = own.where("parts > 1").select("k", "v", F.col("slot").alias("slot2"), F.col("held").alias("held2"))
    within = own.where("parts > 1").join(others, ["k", "v"]).where("slot2 >= slot").select("held", "held2").union(
        own.where("parts = 1").select("held", F.col("held").alias("held2"))
    )
    # The ball: whoever has a bit set looks for the value without it.  A block looks as a whole.
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("v").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    balls = blocks.select("k", "held", F.explode(F.transform(bits, lambda i: F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1), i)))).alias("v"))
    near = balls.join(blocks.select("k", "v", F.col("held").alias("held2")), ["k", "v"]).select("held", "held2")

    @task("simhash")
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for left, right in zip(batch.column(0), batch.column(1)):
                found.extend(_forest(left.values.to_numpy().view(np.uint64), right.values.to_numpy().view(np.uint64), distance))
            a = np.array([x for x, _ in found], np.uint64).view(np.int64)
            b = np.array([y for _, y in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    pairs = within.union(near)
    pairs = pairs.repartition(spread)  # crowded blocks come out of a join side by side
    return pairs.mapInArrow(verify, "a long, b long").distinct()


def _forest(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between two blocks that connect what any of their links connects."""
    if len(left) == 1 and len(right) == 1:
        x, y = int(left[0]), int(right[0])
        return [(x, y)] if x != y and (x ^ y).bit_count() <= distance else []
    parent = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for start in range(0, len(left), 256):
        part = left[start : start + 256]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ right[None, :]) <= distance)
        for x, y in zip(part[i].tolist(), right[j].tolist()):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Rows (`doc_id`, `fingerprint`, `component_id`, `group`), one for each row of `docs`.

    `group` names the component by its smallest fingerprint, also where no document of it has an id.
    """
    marked = stored(fingerprints(docs, id=id, text=text), "simhash-fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    found = components(links(distinct.select("fp"), distance))
    grouped = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = grouped.select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = stored(grouped.join(smallest, "component").select("fp", "n", "component", "component_id"), "simhash-classes")
    # Nearly all rows have a fingerprint of their own.  One that very many share is dealt out: its class stands under
    # several salts, and its rows, which a small list of such fingerprints marks, meet one each.
    hot = classes.where(F.col("n") > HOT).select("fp", F.lit(True).alias("hot"))
    salts = F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = classes.select("fp", "component", "component_id", F.explode(salts).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    rows = marked.join(hot, "fp", "left").select("doc_id", "fp", salt.alias("salt"))
    return rows.join(salted, ["fp", "salt"]).select(
        "doc_id", _hex("fp").alias("fingerprint"), "component_id", _hex("component").alias("group")
    )


def _hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` that stay if of each group only the document with the smallest id does (one of repeated rows).

    A document without an id stays only where no document of its group has one, and then one of them.  Of rows with one
    id (or without one) the text of the least hash stays.  The columns of `docs` may have any names.
    """
    groups = stored(near_duplicates(docs, id=id, text=text, distance=distance), "simhash-groups")
    # The caller's columns travel as one, so their names meet none of these.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    ).withColumn("order", F.xxhash64("text"))
    smallest = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = rows.where(F.col("doc_id").isNotNull()).join(smallest, "doc_id", "left_semi").select("row", "doc_id", "order")
    first = Window.partitionBy("doc_id").orderBy("order")
    named = named.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    nameless = rows.where(F.col("doc_id").isNull()).select("row", "order", _hex(_marker()("text")).alias("fingerprint"))
    alone = groups.where(F.col("component_id").isNull()).select("fingerprint", "group").distinct()
    first = Window.partitionBy("group").orderBy("order")
    nameless = nameless.join(alone, "fingerprint").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return named.select("row.*").union(nameless.select("row.*"))
