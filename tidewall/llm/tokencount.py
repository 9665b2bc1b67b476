"""Token counts of flat token files without any index: a search for the end-of-document id, block by block.

The files hold little-endian unsigned ids of one width and nothing else.  Tasks take blocks of a file, find the ends in
one vectorised comparison, and report a row per block: how many ids stand before the first end, how many ends there are,
how many ids are left behind the last.  A segmented prefix scan over these rows (a row per block, some 10 bytes for
4 MiB) gives every block its first document's number and the ids that earlier blocks owe to it; a second pass emits a
document in the block where it ends.

Defined results: an empty document counts 1 id (its end); ids behind a file's last end are a document without an end
(`complete` false); an empty file has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewall.llm.bpe import Encoder, load_ranks
from tidewall.llm.common import file_system, put, shared_folder, stored, utf8

BLOCK_BYTES = 4 << 20
FILE_BYTES = 64 << 20
LONG_TEXT = 200_000
_LIBRARY: dict = {}


def _encode(ranks: str, pattern: str):
    """Texts to 16-bit ids by the library of the rank files.  It recurses on very long runs of one kind of sign, so long
    texts go through the transducer, which gives the same ids."""
    if (ranks, pattern) not in _LIBRARY:
        import tiktoken

        _LIBRARY[ranks, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})
    library = _LIBRARY[ranks, pattern]

    def run(text: str) -> np.ndarray:
        if len(text) < LONG_TEXT:
            return narrow(np.array(library.encode_ordinary(text), "<u4"))
        return narrow(np.frombuffer(Encoder.shared(ranks, pattern).encode(text), "<u4"))

    return run


def narrow(ids: np.ndarray) -> np.ndarray:
    """Ids as the files hold them; a larger one is an error, whatever text it comes from."""
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError(f"id {ids.max()} does not fit in 16 bits")
    return ids.astype("<u2")


def write_flat(
    docs: DataFrame, ranks: str, pattern: str, end_id: int, *, id: str = "doc_id", text: str = "text",
    folder: str | None = None, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encodes the texts into flat files of 16-bit ids, in whatever order the rows come.  No shuffle.

    Returns rows (`path`, `ordinal`, `doc_id`): which document is the how manieth of a file.  A task that runs again
    writes under other names; the files that count are those that the rows name.
    """
    folder = folder or shared_folder(docs.sparkSession, "token-flat")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _encode(ranks, pattern), TaskContext.get()
        end = narrow(np.array([end_id], "<u4")).tobytes()
        number, out, size, ids = 0, [], 0, []

        def flush():
            path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.u16"
            put(path, b"".join(out))
            columns = [pa.array([path] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["path", "ordinal", "doc_id"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                encoded = encode(raw.decode()).tobytes() + end
                out.append(encoded)
                ids.append(doc_id)
                size += len(encoded)
                if size >= file_bytes:
                    yield flush()
                    number, out, size, ids = number + 1, [], 0, []
        if ids:
            yield flush()

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(write, "path string, ordinal long, doc_id long"), "token-flat-names")


def blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (`path`, `from`, `to`) of byte ranges for a column `path` of flat files."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path)
                size = fs.get_file_info(name).size
                at = np.arange(0, size, block_bytes)
                columns = [pa.array([path] * len(at)), pa.array(at), pa.array(np.minimum(at + block_bytes, size))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "from", "to"])

    return files.select("path").mapInArrow(cut, "path string, from long, to long")


def count_tokens(files: DataFrame, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (`path`, `ordinal`, `start`, `n_tokens`, `complete`) for every document of the files in column `path`."""
    kind = {2: "<u2", 4: "<u4"}[width]
    block_bytes -= block_bytes % width

    def ends(path: str, start: int, stop: int) -> np.ndarray:
        fs, name = file_system(path)
        with fs.open_input_file(name) as file:
            return np.flatnonzero(np.frombuffer(file.read_at(stop - start, start), kind) == end_id)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = ends(row["path"], row["from"], row["to"])
                behind = (row["to"] - row["from"]) // width - (int(found[-1]) + 1 if len(found) else 0)
                rows.append(row | {"ends": len(found), "behind": behind})
            yield pa.RecordBatch.from_pylist(rows, batch.schema.append(pa.field("ends", pa.int64())).append(pa.field("behind", pa.int64())))

    spread = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    surveyed = stored(
        blocks(files, block_bytes).repartition(spread).mapInArrow(survey, "path string, from long, to long, ends long, behind long"),
        "token-blocks",
    )
    # Prefix scan: ends before the block, and ids since the last of them (blocks without an end pass them on).
    order = Window.partitionBy("path").orderBy("from")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    since = F.col("from") / width + F.coalesce(
        F.lit(0) - F.max(F.when(F.col("ends") > 0, F.col("to") / width - F.col("behind"))).over(before), F.lit(0)
    )
    scanned = surveyed.select(
        "path", "from", "to", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"),
        since.cast("long").alias("owed"), (F.lead("from").over(order).isNull()).alias("last"),
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = ends(row["path"], row["from"], row["to"])
                total = (row["to"] - row["from"]) // width
                stops = np.append(found + 1, total) if row["last"] and (not len(found) or found[-1] + 1 < total) else found + 1
                starts = np.concatenate([[-row["owed"]], stops[:-1]]) if len(stops) else stops
                n = len(stops)
                columns = [
                    pa.array([row["path"]] * n, pa.string()), pa.array(row["first"] + np.arange(n), pa.int64()),
                    pa.array(starts + row["from"] // width, pa.int64()), pa.array(stops - starts, pa.int64()),
                    pa.array(np.arange(n) < len(found), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["path", "ordinal", "start", "n_tokens", "complete"])

    out = "path string, ordinal long, start long, n_tokens long, complete boolean"
    return scanned.mapInArrow(emit, out)
