"""What the operators share: the shared folder, tables that cut lineage, files beside them, Arrow columns of text."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from tidewall.functions.shared import shared_folder

BATCH_ROWS = 1000
_SHIPPED: set[str] = set()
#: What an operator's tasks keep in a Python worker, and whose it is.
_KEPT: dict = {}
_OWNER: list[str] = [""]


def kept(owner: str, key: tuple, make):
    """`make()`, kept in this worker for the next tasks of `owner`, until a task of another operator starts."""
    enter(owner)
    if key not in _KEPT:
        _KEPT[key] = make()
        gc.freeze()  # tables stay; without this every collection walks over them
    return _KEPT[key]


def enter(owner: str) -> None:
    """A task's first step: what other operators' tasks have kept in this Python worker goes."""
    if _OWNER[0] == owner:
        return
    _OWNER[0] = owner
    _KEPT.clear()
    gc.unfreeze()
    give_back()


def task(owner: str, keep: bool = True):
    """For functions of `mapInArrow`: a worker that waits for its next task holds no more than what is `kept`, and nothing
    without `keep`: an executor has more workers than cores, and those that wait take turns."""

    def wrap(run):
        def all_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enter(owner)
            try:
                yield from run(batches)
            finally:
                if keep:
                    give_back()
                else:
                    enter("")

        return all_batches

    return wrap


def give_back() -> None:
    """Freed memory goes back to the system; Python, Arrow and the C library hold on to it for later use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once an application: tasks import them by name.

    Arrow batches are made of fewer rows than Spark's 10,000: a row here is a whole text.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidewall-")) / "tidewall.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written to the shared folder: lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, uri: str) -> None:
    """Removes a folder that one of the functions above has made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI, in driver and tasks."""
    if "://" in uri:
        return pa.fs.FileSystem.from_uri(uri)
    return pa.fs.LocalFileSystem(), uri.removeprefix("file:")


def put(uri: str, data: bytes) -> None:
    """Writes a whole file.  Another attempt of the task may write the same file: the last rename wins, none sees a part."""
    fs, path = file_system(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def get(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as file:
        return file.read()


def utf8(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """Texts as bytes, null as empty, without a detour over Python strings."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
