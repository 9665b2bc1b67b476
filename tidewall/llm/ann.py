"""Approximate nearest neighbours by learned partitions.

Fitting (on a bounded sample): the sample's neighbour graph is cut into balanced parts with few edges between them, and a
multinomial classifier learns from the vectors which part they belong to.  Index: the classifier puts every row into a
part; parts are stored in blocks of bounded size.  Search: the classifier ranks the parts for a query, the query visits
the most probable ones, and the vectors there are reranked by exact cosine.  How many parts it visits is measured: a
bounded set of queries is compared with all rows, and the number is the least that finds `recall` of their true
neighbours.

Equal vectors are one entry of the index with its smallest ids (as many as an answer can need), equal queries one search,
so a vector that a third of all rows share costs what a single one does.  Blocks of queries meet blocks of vectors, a
pair of blocks gives a few rows per query, and no pair of rows is ever written out otherwise.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do those
of another length than most (ties: the longer); rows with a null id take no part; ids are taken as unique (equal ids with
equal vectors are one); with fewer candidates than `k` all of them are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.common import stored

#: Most vectors that fitting looks at, and most queries that the number of visited parts is measured on.
SAMPLE = 6144
MEASURED = 192
NEIGHBOURS = 10
PER_PART = 128
MOST_PARTS = 48
BLOCK = 1024
QUERY_BLOCK = 256
RECALL = 0.96
#: How far a product of a matrix may be from the exact measure, and how many pairs are measured at once.
TOLERANCE = 1e-9
PAIRS = 1 << 14


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows (`vec_id`, `vector`) of double vectors that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    # -0.0 and 0.0 are one value
    out = out.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    out = out.withColumn("vector", F.transform(v, lambda x: x + F.lit(0.0)))
    lengths = out.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return out.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))


def entries(rows: DataFrame, kept: int) -> DataFrame:
    """Distinct vectors: (`rep`, `ids`, `vector`) with the smallest ids, in order.

    The rank's limit is applied before the shuffle too, so a common vector sends a few rows a task.
    """
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("_rank", rank).where(F.col("_rank") <= kept)
    ids = F.sort_array(F.collect_set("vec_id"))
    return few.groupBy("vector").agg(ids.alias("ids")).select(F.get("ids", F.lit(0)).alias("rep"), "ids", "vector")


def balanced_parts(neighbours: np.ndarray, points: np.ndarray, parts: int, sweeps: int = 12, slack: float = 1.1) -> np.ndarray:
    """Parts of a neighbour graph with few edges between them and at most `slack` times the mean size.

    Starts from halving along the direction of most variance, again and again; then moves single points to the part
    that most of their neighbours are in while it has room.
    """
    n = len(points)
    part = np.zeros(n, np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        x = points[rows] - points[rows].mean(axis=0)
        direction = np.linalg.eigh(x.T @ x)[1][:, -1]
        order = rows[np.argsort(x @ direction, kind="stable")]
        left = count // 2
        at = len(rows) * left // count
        halve(order[:at], first, left)
        halve(order[at:], first + left, count - left)

    halve(np.arange(n), 0, parts)
    graph: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(neighbours.tolist()):
        for j in row:
            graph[i].append(j)
            graph[j].append(i)
    sizes = np.bincount(part, minlength=parts)
    room = int(np.ceil(slack * n / parts))
    order = np.random.default_rng(11).permutation(n)
    for _ in range(sweeps):
        moved = 0
        for i in order.tolist():
            votes = np.bincount(part[graph[i]], minlength=parts)
            votes[(sizes >= room) & (np.arange(parts) != part[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """The classifier: scores of all parts for vectors of any length."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    @property
    def parts(self) -> int:
        return len(self.bias)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.argsort(-(unit @ self.weights.T + self.bias), axis=1, kind="stable")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit(items: DataFrame, sample: int = SAMPLE, most_parts: int = MOST_PARTS, per_part: int = PER_PART) -> Router:
    """Learns parts from at most `sample` entries, the first in the order of a hash."""
    chosen = stored(items.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(sample), "ann-sample")
    rows = chosen.orderBy("rep").collect()  # bounded by `sample`
    if not rows:
        return Router(np.zeros((1, 1)), np.zeros(1))
    points = np.array([r["vector"] for r in rows])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    parts = max(1, min(most_parts, len(points) // per_part))
    if parts == 1:
        return Router(np.zeros((1, points.shape[1])), np.zeros(1))
    reps = np.array([r["rep"] for r in rows])
    k = min(NEIGHBOURS, len(points) - 1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            similar = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ points.T
            similar[np.arange(len(x)), np.searchsorted(reps, batch.column(0).to_numpy())] = -2
            near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.tolist(), pa.list_(pa.int64()))], ["rep", "near"])

    graph = chosen.repartition(16).mapInArrow(nearest, "rep long, near array<long>").orderBy("rep").collect()
    part = balanced_parts(np.array([r["near"] for r in graph]), points, parts)
    spark = items.sparkSession
    labelled = spark.createDataFrame(
        pa.table({"label": pa.array(part, pa.float64()), "unit": pa.array(points.tolist(), pa.list_(pa.float64()))})
    ).select("label", array_to_vector("unit").alias("features")).repartition(8)
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, standardization=False).fit(labelled)
    return Router(model.coefficientMatrix.toArray(), model.interceptVector.toArray())


class Index:
    """Every entry in the block of its part.  Rows (`part`, `block`, `reps`, `ids`, `vectors`)."""

    def __init__(self, items: DataFrame, router: Router):
        self.router = router

        @F.arrow_udf("int")
        def place(vectors: pa.Array) -> pa.Array:
            return pa.array(router.order(_matrix(vectors))[:, 0] if len(vectors) else [], pa.int32())

        placed = stored(items.withColumn("part", place("vector")), "ann-placed")
        # A part as large as half the table is many blocks: the sizes (a row per part) say how many.
        sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
        self.blocks = stored(
            placed.withColumn("block", _slot(F.col("part"), F.col("rep"), sizes, BLOCK)).groupBy("part", "block").agg(
                F.collect_list(F.struct("rep", "ids", "vector")).alias("held")
            ).select("part", "block", F.col("held.rep").alias("reps"), F.col("held.ids").alias("ids"), F.flatten("held.vector").alias("vectors")),
            "ann-index",
        )

    def search(self, queries: DataFrame, visits: int | None, k: int) -> DataFrame:
        """The k + 1 best entries of distinct queries (`rep`, `vector`): (`query`, `rep`, `ids`, `score`, `part`).

        `visits` parts of each query are looked at, all without.
        """
        router, most = self.router, k + 1
        every = visits is None or visits >= router.parts

        @F.arrow_udf("array<int>")
        def route(vectors: pa.Array) -> pa.Array:
            order = router.order(_matrix(vectors)) if len(vectors) else np.zeros((0, 1))
            return pa.array((order if every else order[:, :visits]).astype(np.int32).tolist(), pa.list_(pa.int32()))

        probes = queries.select("rep", "vector", F.explode(route("vector")).alias("part"))
        counts = {r["part"]: r["count"] for r in probes.groupBy("part").count().collect()}
        asked = probes.withColumn("slot", _slot(F.col("part"), F.col("rep"), counts, QUERY_BLOCK)).groupBy("part", "slot").agg(
            F.collect_list(F.struct("rep", "vector")).alias("q")
        ).select("part", F.col("q.rep").alias("queries"), F.flatten("q.vector").alias("asked"))
        pairs = asked.join(self.blocks, "part").select("part", "queries", "asked", "reps", "ids", "vectors")

        def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    part, names, asked, reps, ids, vectors = (batch.column(c)[row] for c in range(6))
                    names, reps = names.values.to_numpy(), reps.values.to_numpy()
                    q = asked.values.to_numpy().reshape(len(names), -1)
                    x = vectors.values.to_numpy().reshape(len(reps), -1)
                    q_norm, x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
                    similar = (q / q_norm[:, None]) @ (x / x_norm[:, None]).T
                    # All that come near the last one needed by the product, whose last digits depend on the place in
                    # the matrix; then the exact measure, row by row, and ties to the smaller id.
                    needed = min(most, len(reps))
                    last = -np.partition(-similar, needed - 1, axis=1)[:, needed - 1]
                    at, near = np.nonzero(~(similar < last[:, None] - TOLERANCE))
                    score = np.empty(len(at))
                    for a in range(0, len(at), PAIRS):
                        i, j = at[a : a + PAIRS], near[a : a + PAIRS]
                        score[a : a + PAIRS] = (q[i] * x[j]).sum(axis=1) / (q_norm[i] * x_norm[j])
                    by = np.lexsort((reps[near], -score, at))
                    rank = np.arange(len(by)) - np.searchsorted(at, at)
                    by = by[rank < most]
                    chosen = near[by]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[at[by]]), pa.array(reps[chosen]), ids.values.take(pa.array(chosen)), pa.array(score[by]),
                         pa.array([part.as_py()] * len(by), pa.int32())],
                        ["query", "rep", "ids", "score", "part"],
                    )

        spread = max(1, queries.sparkSession.sparkContext.defaultParallelism * 4)
        found = pairs.repartition(spread).mapInArrow(rerank, "query long, rep long, ids array<long>, score double, part int")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
        return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).drop("_n")


def _slot(part: Column, id: Column, sizes: dict[int, int], block: int) -> Column:
    """Which of a part's blocks a row is in, by its hash."""
    blocks = F.lit(1)
    if sizes:
        blocks = F.get(F.array(*(F.lit(-(-sizes.get(p, 0) // block) or 1) for p in range(max(sizes) + 1))), part)
    return F.pmod(F.xxhash64(id), blocks).cast("int")


def visits_for(index: Index, queries: DataFrame, k: int, recall: float = RECALL, measured: int = MEASURED) -> tuple[int, float]:
    """The least number of visited parts that finds `recall` of the true neighbours of some queries, and what it finds."""
    router = index.router
    some = stored(queries.orderBy(F.xxhash64("rep"), "rep").limit(measured), "ann-measured")
    true = index.search(some, None, k).join(some.select(F.col("rep").alias("query"), "vector"), "query")

    @F.arrow_udf("int")
    def place(vectors: pa.Array, parts: pa.Array) -> pa.Array:
        order = router.order(_matrix(vectors)) if len(vectors) else np.zeros((0, 1))
        return pa.array((order == parts.to_numpy()[:, None]).argmax(axis=1), pa.int32()) if len(vectors) else pa.array([], pa.int32())

    ranks = true.where(F.col("rep") != F.col("query")).groupBy(place("vector", "part").alias("rank")).count().collect()
    counts = np.zeros(router.parts)
    for row in ranks:
        counts[row["rank"]] = row["count"]
    share = np.cumsum(counts) / max(1.0, counts.sum())
    visits = int(np.argmax(share >= min(recall, share[-1]))) + 1
    return visits, float(share[visits - 1])


def nearest(
    rows: DataFrame, *, id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, recall: float = RECALL
) -> DataFrame:
    """Rows (`query_id`, `rank`, `vec_id`, `score`): for each row whose id `every` divides, its `k` nearest others."""
    good = stored(usable(rows, id, vector), "ann-rows")
    items = stored(entries(good, k + 1), "ann-entries")
    router = fit(items)
    index = Index(items, router)
    asking = good.where(F.col("vec_id") % every == 0)
    # Equal queries search once.  Most are alone; the others find their search by a salted join.
    searches = stored(asking.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("_n")), "ann-queries")
    visits, _ = visits_for(index, searches.select("rep", "vector"), k, recall)
    found = index.search(searches.select("rep", "vector"), visits, k)
    found = found.select("query", "score", F.explode("ids").alias("vec_id"))
    few = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = stored(found.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k + 1).drop("_n"), "ann-found")
    salts = 16
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")
    shared = searches.where("_n > 1").select(
        F.col("rep").alias("query"), "vector", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    owners = asking.withColumn("_salt", salt).join(shared, ["vector", "_salt"], "left").select(
        F.col("vec_id").alias("query_id"), F.coalesce("query", "vec_id").alias("query")
    ).distinct()
    # An answer is k + 1 rows a search: the copies of a hot one are dealt by salt against that many copies of it.
    hot = searches.where("_n > 1000").select(F.col("rep").alias("query"), F.lit(True).alias("_hot"))
    owners = owners.join(hot, "query", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("query_id"), F.lit(salts))).otherwise(0).cast("int"))
    found = found.join(hot, "query", "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    answers = owners.drop("_hot").join(found.drop("_hot"), ["query", "_salt"]).where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
