"""Best signature of a prompt vector by cosine similarity, exact at any number of signatures.

Signatures are written once, in ascending order of their ids, as matrix files of bounded size in the shared folder.
Prompts are not moved: each task gathers prompt vectors up to the same bound and holds them against one file after the
other, keeping the best so far.  One file or many, the work is prompts times signatures in matrix products, no pair of
rows is written anywhere, and a task's memory is two such matrices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.functions.shared import shared_folder

MATRIX_BYTES = 64 * 1024 * 1024


def _matrix_files(signatures: DataFrame, folder: str, matrix_bytes: int) -> list[str]:
    """Files of (ids, unit vectors); only their names, a row per `matrix_bytes`, come to the driver."""

    def write(batches):
        import io
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        ids, rows, size = [], [], 0

        def flush():
            out, path = io.BytesIO(), f"{base}/{uuid.uuid4().hex}.npz"
            np.savez(out, ids=np.array(ids, np.int64), vectors=np.array(rows, np.float64))
            with store.open_output_stream(path) as file:
                file.write(out.getvalue())
            return pa.RecordBatch.from_pydict({"first": pa.array([ids[0]], pa.int64()), "path": [path]})

        store.create_dir(base, recursive=True)
        for batch in batches:
            for id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.asarray(vector, np.float64)
                norm = np.sqrt(v @ v)
                if norm > 0:
                    if rows and size + v.nbytes > matrix_bytes:
                        yield flush()
                        ids, rows, size = [], [], 0
                    ids.append(id)
                    rows.append(v / norm)
                    size += v.nbytes
        if rows:
            yield flush()

    usable = signatures.select("signature_id", "embedding").where("signature_id IS NOT NULL AND embedding IS NOT NULL")
    ordered = usable.repartitionByRange("signature_id").sortWithinPartitions("signature_id")
    return [r["path"] for r in sorted(ordered.mapInArrow(write, "first long, path string").collect())]


def match_signatures(
    prompts: DataFrame,
    signatures: DataFrame,
    key: str = "prompt_id",
    vector: str = "embedding",
    matrix_bytes: int = MATRIX_BYTES,
) -> DataFrame:
    """key, signature_id, similarity of the best signature; NULL and 0 where none is similar at all.

    signatures: signature_id BIGINT, embedding.  Equal similarities go to the lowest signature id.  Each prompt row is
    answered by itself: keys may be of any type, repeated or null.
    """
    folder = shared_folder(prompts.sparkSession, "signatures")
    paths = _matrix_files(signatures, folder, matrix_bytes)

    def match(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
        loaded = {}

        def matrix(path):
            if path not in loaded:
                loaded.clear()
                with store.open_input_file(path) as file:
                    found = np.load(file)
                    loaded[path] = found["ids"], found["vectors"]
            return loaded[path]

        def answer(held):
            keys = pa.concat_arrays([k for k, _ in held])
            values = [v for _, vs in held for v in vs.to_pylist()]
            best, at = np.zeros(len(values)), np.zeros(len(values), np.int64)
            rows = {}
            for i, v in enumerate(values):
                a = np.asarray(v if v is not None else [], np.float64)
                n = np.sqrt(a @ a)
                if n > 0:
                    rows.setdefault(len(a), []).append((i, a / n))
            for path in paths:
                ids, signed = matrix(path)
                for i0 in range(0, len(rows.get(signed.shape[1], ())), 1024):
                    part = rows[signed.shape[1]][i0 : i0 + 1024]
                    sims = np.round(np.array([a for _, a in part]) @ signed.T, 10)
                    top = sims.argmax(axis=1)
                    where = np.array([i for i, _ in part])
                    value = sims[np.arange(len(part)), top]
                    better = value > best[where]
                    best[where[better]], at[where[better]] = value[better], ids[top[better]]
            names = ["key", "signature_id", "similarity"]
            return pa.RecordBatch.from_arrays([keys, pa.array(at, mask=best <= 0), pa.array(best)], names)

        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0), batch.column(1)))
            size += batch.column(1).nbytes
            if size >= matrix_bytes:
                yield answer(held)
                held, size = [], 0
        if held:
            yield answer(held)

    rows = prompts.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(match, f"key {kind}, signature_id long, similarity double").withColumnRenamed("key", key)
