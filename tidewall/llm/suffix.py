"""Suffix-array dedup of long repeated passages, with a logarithmic family of indexes.

A document's bytes that lie in a string of `length` bytes which also starts in a document with a smaller id are removed.

Sparse suffix arrays.  Of all suffixes only those are kept that begin at a sampled position: in every window of `length`
bytes the 16 bytes with the least hash are its anchor, so equal windows have equal anchors at the same place, and about
one suffix in 17 bytes is kept instead of every one.  Windows in a row with one anchor form a run.  An array is sorted by
the anchor's hash (not by its letters: ranges of a hash are even in any language), then by a hash of the whole run, then
by document.  It is cut into shards by ranges of the anchor's hash, one file each.

Index family.  Documents come in batches, in ascending order of ids.  A batch's texts are put into chunk files and its
suffixes into an array; per shard, the array is merge-scanned against the arrays of the existing levels and itself, and
written as a level of size one.  Before the next batch, levels of equal size are merged, so a suffix is rewritten a
logarithmic number of times and there are a logarithmic number of levels.

Matches.  A run that a smaller document has as a whole is removed as a whole; that settles nearly all.  Where runs of the
same anchor differ, a common window may still lie in both (passages begin and end somewhere): these runs' bytes are read
from the chunk files, and their windows compared one by one.  Whole arrays and texts are only ever read shard by shard
and chunk by chunk.  Whole runs that are copies in a chunk are settled there, so of a frequent run one entry a chunk is
left.  Where a frequent passage ends, though, each document has a run of its own: those of one anchor are entries of some
30 bytes in one shard.  Their windows, some thousand bytes a run, are not gathered by anchor: for an anchor with many
runs a chunk hashes its windows, settles those that it has several times, and deals the others by anchor and window hash.

Defined results: a null text is empty; documents of equal id do not remove from each other; a null id counts as larger
than any other; passages within one document stay; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.llm.common import get, put, remove, shared_folder, stored, task, utf8

LENGTH = 50
GRAM = 16
CHUNK_BYTES = 4 << 20
SHARD_BYTES = 12 << 20
BATCHES = 4
#: Windows that a comparison holds at once.
WINDOWS = 400_000
#: An anchor with more different runs has its windows dealt by their hashes.
CROWDED = 1000
_BLOCK = 1 << 19
_RUNS_AT_ONCE = 1 << 14
_POSITION = np.uint64((1 << 24) - 1)
_KEY_BITS = 40
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LARGEST = np.iinfo(np.int64).max
_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOUND = "kind int, chunk long, data binary, path string"
#: Timestamps as JSON with all their digits; offsets of old times have seconds.
_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_CUT, _ASK, _CHUNK, _ASK_MANY = 0, 1, 2, 3
#: What a chunk sends to be compared: bytes of runs, windows as hashes, stretches that it has settled.
_RUNS, _HASHES, _SETTLED = 0, 1, 2


def _pack(*arrays: np.ndarray) -> bytes:
    zstd = zstandard.ZstdCompressor(level=1)
    parts = [zstd.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}I", data), 4 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        raw = zstandard.decompress(data[at : at + size]) if size else b""
        out.append(np.frombuffer(raw, kind))
        at += size
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """The low six bytes of each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _wide(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def string_hashes(x: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each position, from hashes of doubled lengths."""
    power, n = {1: _TABLE[x]}, 1

    def join(a, b, n):
        m = a * np.uint64((0x9E3779B97F4A7C15 + 2 * n) & (1 << 64) - 1)
        return (m ^ m >> np.uint64(31)) + b

    while 2 * n <= length:
        power[2 * n] = join(power[n][: len(power[n]) - n], power[n][n:], n)
        n *= 2
    out, done = power[n], n
    for m in sorted(power, reverse=True):
        while length - done >= m:
            part = power[m][done:]
            k = min(len(out), len(part))
            out = join(out[:k], part[:k], done + m)
            done += m
    out = out ^ out >> np.uint64(29)
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def sample_suffixes(buffer: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs (`key`, `run`, `lo`, `n`): windows lo..lo+n-1 share an anchor.  `ends` are the documents' ends in the buffer.

    The buffer is taken in blocks; a run over a block's end comes out as two, which changes no result.
    """
    total, view, out = len(buffer), memoryview(buffer), []
    for start in range(0, max(0, total - length + 1), _BLOCK):
        windows = min(_BLOCK, total - length + 1 - start)
        x = np.frombuffer(buffer, np.uint8, windows + length - 1, start)
        anchor = (string_hashes(x, GRAM) & ~_POSITION) | np.arange(len(x) - GRAM + 1, dtype=np.uint64)
        span, least = 1, anchor
        width = length - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        at = np.arange(start, start + windows)
        inside = ends[np.searchsorted(ends, at, side="right")] >= at + length
        at, least = at[inside], least[inside]
        if not len(at):
            continue
        new = np.empty(len(at), bool)
        new[0] = True
        # A document in between leaves at least one window out, so a step over its end is seen in `at`.
        np.logical_or(least[1:] != least[:-1], at[1:] != at[:-1] + 1, out=new[1:])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        lo = at[first]
        digest = xxhash.xxh3_64_intdigest
        run = [digest(view[a:b]) for a, b in zip(lo.tolist(), (lo + n + (length - 1)).tolist())]
        # The least of many hashes is small: mixed once more, so that ranges of it are even again.
        key = (least[first] >> np.uint64(24)) * _MIX & np.uint64((1 << _KEY_BITS) - 1)
        out.append((key, np.array(run, np.uint64) & np.uint64((1 << 48) - 1), lo, n))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching stretches as one, in order."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > top[:-1])
    return lo[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]


def _first(key: np.ndarray, run: np.ndarray) -> np.ndarray:
    """In sorted arrays, where a new (key, run) begins."""
    new = np.ones(len(key), bool)
    np.logical_or(key[1:] != key[:-1], run[1:] != run[:-1], out=new[1:])
    return new


class Chunk:
    """Texts of some documents in one compressed file: ids, what travels with them, ends and bytes."""

    @staticmethod
    def write(path: str, ids: list[int | None], carried: list[bytes], ends: np.ndarray, buffer: bytes) -> None:
        null = np.array([i is None for i in ids], np.uint8)
        zstd = zstandard.ZstdCompressor(level=3)
        beside = np.frombuffer(b"".join(carried), np.uint8), np.fromiter(map(len, carried), "<u4", len(carried))
        head = _pack(np.array([i or 0 for i in ids], "<i8"), null, ends.astype("<i8"), *beside)
        put(path, struct.pack("<I", len(head)) + head + zstd.compress(buffer))

    def __init__(self, path: str):
        data = get(path)
        (size,) = struct.unpack_from("<I", data)
        ids, null, self.ends, self._beside, self._lengths = _unpack(data[4 : 4 + size], "<i8", np.uint8, "<i8", np.uint8, "<u4")
        self.buffer = zstandard.decompress(data[4 + size :])
        self.ids = [None if n else i for i, n in zip(ids.tolist(), null.tolist())]
        self.order = np.where(null == 1, _LARGEST, ids)

    def carried(self) -> list[str]:
        stops = np.cumsum(self._lengths, dtype=np.int64)
        raw = self._beside.tobytes()
        return [raw[b - n : b].decode() for b, n in zip(stops.tolist(), self._lengths.tolist())]

    def order_at(self, at: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.ends, at, side="right")]


class SuffixIndex:
    """The levels of one family in a shared folder; `add` puts in a batch and reports what it repeats."""

    def __init__(self, spark: SparkSession, shards: int, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES):
        if length < GRAM + 8:
            raise ValueError(f"a passage must have {GRAM + 8} bytes at least")
        self._spark, self._shards, self._length, self._chunk_bytes = spark, shards, length, chunk_bytes
        self._folder = shared_folder(spark, "suffix-index")
        self._levels: list[tuple[int, str]] = []  # size in batches, folder; sizes fall
        self._batches = 0
        self._found: list[DataFrame] = []

    @property
    def levels(self) -> list[int]:
        return [size for size, _ in self._levels]

    def add(self, docs: DataFrame, id: str = "doc_id", text: str = "text", carry: Column | None = None) -> None:
        """A batch, whose ids are not below those of batches before.  The string `carry` comes out again beside a row."""
        self._merge_equal()
        beside = F.lit("") if carry is None else carry
        rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), beside.alias("carry"))
        level = f"{self._folder}/batch-{self._batches:06d}"
        entries = rows.mapInArrow(self._sampler(self._batches), "shard int, " + _FOUND)
        sharded = entries.repartition(self._shards, "shard").sortWithinPartitions("shard", "chunk")
        self._found.append(stored(sharded.mapInArrow(self._scanner(level), _FOUND), "suffix-found"))
        self._levels.append((1, level))
        self._batches += 1

    def _sampler(self, batch: int):
        folder, shards, length, chunk_bytes = f"{self._folder}/texts", self._shards, self._length, self._chunk_bytes

        @task("suffix")
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = TaskContext.get()
            part, number = context.partitionId(), 0
            ids, texts, beside, size = [], [], [], 0

            def flush():
                chunk = batch << 48 | part << 20 | number
                path = f"{folder}/{batch:04d}-{part:06d}-{context.taskAttemptId()}-{number:05d}.chunk"
                ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
                buffer = b"".join(texts)
                Chunk.write(path, ids, beside, ends, buffer)
                key, run, lo, n = sample_suffixes(buffer, ends, length)
                order = np.array([_LARGEST if i is None else i for i in ids], np.int64)[np.searchsorted(ends, lo, side="right")]
                by = np.lexsort((order, run, key))
                key, run, lo, n, order = (a[by] for a in (key, run, lo, n, order))
                rows = [(int(chunk % shards), _CHUNK, None, path)]
                if len(key):
                    # Copies within the chunk are settled here: only a run's smallest document goes on.
                    new = _first(key, run)
                    smallest = order[new][np.cumsum(new) - 1]
                    cut = order > smallest
                    if cut.any():
                        a, b = _merged(lo[cut], lo[cut] + n[cut] + (length - 1))
                        rows.append((int(chunk % shards), _CUT, _pack(a.astype("<u4"), b.astype("<u4")), None))
                    key, run, lo, n, order = (a[~cut] for a in (key, run, lo, n, order))
                    shard = (key * np.uint64(shards) >> np.uint64(_KEY_BITS)).astype(np.int64)
                    bounds = np.searchsorted(shard, np.arange(shards + 1))
                    for s in range(shards):
                        a, b = bounds[s], bounds[s + 1]
                        if a < b:
                            data = _pack(np.diff(key[a:b], prepend=np.uint64(0)), _narrow(run[a:b]), order[a:b], lo[a:b].astype("<u4"), n[a:b].astype("<u4"))
                            rows.append((s, _ASK, data, None))
                columns = list(zip(*rows))
                return pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                     pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.string())],
                    ["shard", "kind", "chunk", "data", "path"],
                )

            for batch_ in batches:
                for doc_id, raw, extra in zip(batch_.column(0).to_pylist(), utf8(batch_.column(1)), utf8(batch_.column(2))):
                    ids.append(doc_id)
                    beside.append(extra)
                    texts.append(raw)
                    size += len(raw)
                    if size >= chunk_bytes:
                        yield flush()
                        ids, texts, beside, size, number = [], [], [], 0, number + 1
            if ids:
                yield flush()

        return run

    def _scanner(self, level: str):
        older, length, crowded = [folder for _, folder in self._levels], self._length, CROWDED

        @task("suffix")
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held = None, []
            for batch in batches:
                rows = zip(*(batch.column(k).to_pylist() for k in range(5)))
                for s, kind, chunk, data, path in rows:
                    if s != shard and held:
                        yield from scan(shard, held)
                        held = []
                    shard = s
                    if kind == _ASK:
                        held.append((chunk, data))
                    else:
                        yield _rows([(kind, chunk, data, path)])
            if held:
                yield from scan(shard, held)

        def scan(shard, held):
            parts = []
            for chunk, data in held:
                step, run, order, lo, n = _unpack(data, "<u8", np.uint8, "<i8", "<u4", "<u4")
                parts.append((np.cumsum(step, dtype=np.uint64), _wide(run), order, np.full(len(lo), chunk), lo, n))
            held.clear()
            fresh = [np.concatenate(c) for c in zip(*parts)]
            known = [_read_level(folder, shard) for folder in older]
            key, run, order, chunk, lo, n = (np.concatenate(c) for c in zip(fresh, *known))
            is_new = np.arange(len(key)) < len(fresh[0])
            by = np.lexsort((order, run, key))
            key, run, order, chunk, lo, n, is_new = (a[by] for a in (key, run, order, chunk, lo, n, is_new))
            first = _first(key, run)
            group = np.cumsum(first) - 1
            cut = order > order[first][group]
            put(_level_file(level, shard), _level(*(a[is_new & ~cut] for a in (key, run, order, chunk, lo, n))))
            whole = cut & is_new
            yield from _by_chunk(_CUT, chunk[whole], lo[whole].astype(np.int64), lo[whole] + n[whole].astype(np.int64) + (length - 1))
            # What is left and shares its anchor with another run of a smaller document is compared window by window.
            key, run, order, chunk, lo, n, is_new = (a[~cut] for a in (key, run, order, chunk, lo, n, is_new))
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            least, most = np.minimum.reduceat(order, starts), np.maximum.reduceat(np.where(is_new, order, -_LARGEST), starts)
            several = np.add.reduceat(_first(key, run).astype(np.int64), starts) > 1
            asked = np.repeat(several & (most > least), sizes)
            # Of the older ones only those below the largest new one can matter.  But all runs of an anchor must be dealt
            # in one way, also those that an earlier batch asked for when they were few.
            many = np.repeat(sizes > crowded, sizes)
            asked &= is_new | (order < np.repeat(most, sizes)) | many
            for kind, which in ((_ASK, asked & ~many), (_ASK_MANY, asked & many)):
                yield from _by_chunk(kind, chunk[which], lo[which].astype(np.int64), n[which].astype(np.int64), key[which])

        return run

    def _merge_equal(self) -> None:
        while len(self._levels) > 1 and self._levels[-1][0] == self._levels[-2][0]:
            (size, a), (_, b) = self._levels[-2:]
            target = f"{self._folder}/merged-{self._batches:06d}-{2 * size}"

            @task("suffix")
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for shard in batch.column(0).to_pylist():
                        parts = [_read_level(a, shard), _read_level(b, shard)]
                        columns = [np.concatenate(c) for c in zip(*parts)]
                        by = np.lexsort((columns[2], columns[1], columns[0]))
                        columns = [c[by] for c in columns]
                        first = _first(columns[0], columns[1])
                        own = columns[2] == columns[2][first][np.cumsum(first) - 1]
                        put(_level_file(target, shard), _level(*(c[own] for c in columns)))
                yield from ()

            shards = self._spark.range(0, self._shards, 1, max(1, min(self._shards, self._spark.sparkContext.defaultParallelism * 2)))
            shards.mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()
            remove(self._spark, a)
            remove(self._spark, b)
            self._levels[-2:] = [(2 * size, target)]

    def spans(self) -> DataFrame:
        """Rows (`chunk`, `kind`, `data`, `path`): of all batches so far, chunk files and stretches to remove in them."""
        found = self._found[0]
        for more in self._found[1:]:
            found = found.union(more)
        compared = stored(self._windows(found).mapInArrow(_compare(self._length), _FOUND), "suffix-compared")
        return found.where(F.col("kind").isin(_CUT, _CHUNK)).union(compared)

    def _windows(self, found: DataFrame) -> DataFrame:
        asked = found.where(F.col("kind") != _CUT).withColumn("_first", F.col("kind") == _CHUNK)
        asked = asked.repartition("chunk").sortWithinPartitions("chunk", F.desc("_first")).drop("_first")
        windows = asked.mapInArrow(_fetch(self._shards, self._length), "shard int, kind int, data binary")
        return windows.repartition(self._shards, "shard").sortWithinPartitions("shard")

    def removed(self, whole_characters: bool = False) -> DataFrame:
        """Rows (`doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept`, `spans`, `carry`) for every document of all batches.

        `kept` are the bytes that stay, with `whole_characters` without the rests of characters that are cut in two;
        `spans` the removed stretches as from and to, in order.
        """
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<from:bigint,to:bigint>>, carry string"
        return self.spans().repartition("chunk").sortWithinPartitions("chunk", F.desc("kind")).mapInArrow(_apply(whole_characters), schema)


def _level_file(folder: str, shard: int) -> str:
    return f"{folder}/{shard:06d}.suffixes"


def _level(key, run, order, chunk, lo, n) -> bytes:
    return _pack(np.diff(key, prepend=np.uint64(0)), _narrow(run), order, chunk, lo.astype("<u4"), n.astype("<u4"))


def _read_level(folder: str, shard: int) -> list[np.ndarray]:
    """A shard without entries has no file."""
    try:
        data = get(_level_file(folder, shard))
    except FileNotFoundError:
        return [np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.uint32, np.uint32)]
    step, run, order, chunk, lo, n = _unpack(data, "<u8", np.uint8, "<i8", "<i8", "<u4", "<u4")
    return [np.cumsum(step, dtype=np.uint64), _wide(run), order, chunk, lo, n]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds, chunks, data, paths = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(chunks, pa.int64()), pa.array(data, pa.binary()), pa.array(paths, pa.string())],
        ["kind", "chunk", "data", "path"],
    )


def _by_chunk(kind: int, chunk: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row per chunk: for cuts merged stretches, for questions starts, counts and anchors."""
    by = np.argsort(chunk, kind="stable")
    chunk, a, b = chunk[by], a[by], b[by]
    key = None if key is None else key[by]
    starts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
    rows = []
    for s, e in zip(starts, np.append(starts[1:], len(chunk)) if len(chunk) else []):
        if kind == _CUT:
            x, y = _merged(a[s:e], b[s:e])
            data = _pack(x.astype("<u4"), y.astype("<u4"))
        else:
            data = _pack(a[s:e].astype("<u4"), b[s:e].astype("<u4"), key[s:e])
        rows.append((kind, int(chunk[s]), data, None))
    if rows:
        yield _rows(rows)


def _fetch(shards: int, length: int):
    """Per chunk: the bytes of the runs asked for, dealt by anchor; of crowded anchors the windows, dealt by their hashes."""

    @task("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts, parts = None, None, []
        for batch in batches:
            for kind, number, data, path in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if number != chunk and parts:
                    yield from send(chunk, texts, parts)
                    parts = []
                chunk = number
                if kind == _CHUNK:
                    texts = path
                else:
                    lo, n, key = _unpack(data, "<u4", "<u4", "<u8")
                    parts.append((lo, n, key, np.full(len(lo), kind == _ASK_MANY)))
        if parts:
            yield from send(chunk, texts, parts)

    def send(number, path, parts):
        chunk = Chunk(path)
        lo, n, key, many = (np.concatenate(c) for c in zip(*parts))
        # Several batches may ask for the same run; if one of them finds its anchor crowded, it is.
        by = np.lexsort((~many, lo))
        by = by[np.append(True, lo[by][1:] != lo[by][:-1])]
        by = by[np.argsort(key[by], kind="stable")]
        lo, n, key, many = lo[by].astype(np.int64), n[by].astype(np.int64), key[by], many[by]
        rows = [*runs(chunk, lo[~many], n[~many], key[~many]), *hashes(chunk, lo[many], n[many], key[many], number)]
        if rows:
            names, kinds, blobs = zip(*rows)
            blobs = [struct.pack("<q", number) + data for data in blobs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "kind", "data"]
            )

    def pieces(shard):
        bounds = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else [0]
        return zip(bounds[:-1], bounds[1:])

    def runs(chunk, lo, n, key):
        shard = (key * np.uint64(shards) >> np.uint64(_KEY_BITS)).astype(np.int64)
        for a, b in pieces(shard):
            text = b"".join(chunk.buffer[s : s + c + length - 1] for s, c in zip(lo[a:b].tolist(), n[a:b].tolist()))
            data = _pack(key[a:b], chunk.order_at(lo[a:b]), lo[a:b].astype("<u4"), n[a:b].astype("<u4"), np.frombuffer(text, np.uint8))
            yield int(shard[a]), _RUNS, data

    def hashes(chunk, lo, n, key, number):
        if not len(lo):
            return
        found = []
        for a in range(0, len(lo), _RUNS_AT_ONCE):
            part = slice(a, a + _RUNS_AT_ONCE)
            text = np.frombuffer(b"".join(chunk.buffer[s : s + c + length - 1] for s, c in zip(lo[part].tolist(), n[part].tolist())), np.uint8)
            row = np.repeat(np.arange(len(n[part])), n[part])
            step = np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            starts = np.cumsum(n[part] + (length - 1)) - (n[part] + (length - 1))
            # One number for anchor and window.
            mixed = string_hashes(text, length)[starts[row] + step] ^ key[part][row] * _MIX
            found.append(((mixed ^ mixed >> np.uint64(31)) * _MIX, lo[part][row] + step))
        window, at = (np.concatenate(c) for c in zip(*found))
        order = chunk.order_at(at)
        by = np.lexsort((order, window))
        window, at, order = window[by], at[by], order[by]
        new = np.append(True, window[1:] != window[:-1])
        cut = order > order[new][np.cumsum(new) - 1]
        if cut.any():
            a, b = _merged(at[cut], at[cut] + length)
            yield number % shards, _SETTLED, _pack(a.astype("<u4"), b.astype("<u4"))
        window, at, order = window[~cut], at[~cut], order[~cut]
        shard = ((window >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        for a, b in pieces(shard):
            yield int(shard[a]), _HASHES, _pack(window[a:b], order[a:b], at[a:b].astype("<u4"))

    return run


def _compare(length: int):
    """Per shard: windows of runs with one anchor; those of a larger document than the smallest that has them go."""

    @task("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, {_RUNS: [], _HASHES: []}
        for batch in batches:
            for s, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if s != shard:
                    yield from compare(held)
                shard = s
                if kind == _SETTLED:
                    yield _rows([(_CUT, struct.unpack_from("<q", data)[0], data[8:], None)])
                else:
                    held[kind].append(data)
        yield from compare(held)

    def compare(held):
        for kind, opened, take in ((_RUNS, open_runs, windows_of_runs), (_HASHES, open_hashes, windows_of_hashes)):
            parts, total = [], 0
            for data in held[kind]:
                (number,) = struct.unpack_from("<q", data)
                part, count = opened(data[8:])
                parts.append((number, *part))
                total += count
            held[kind].clear()
            if not parts:
                continue
            # In ranges of the anchor's hash, each of a bounded number of windows (and one anchor's, which is not crowded),
            # or of the windows' hashes.
            low, high = min(int(p[1][0]) for p in parts), max(int(p[1][-1]) for p in parts) + 1
            steps = -(-total // WINDOWS)
            for k in range(steps):
                yield from compare_range(parts, take, low + (high - low) * k // steps, low + (high - low) * (k + 1) // steps)

    def open_runs(data):
        key, order, lo, n, text = _unpack(data, "<u8", "<i8", "<u4", "<u4", np.uint8)
        n = n.astype(np.int64)
        return (key, order, lo, n, np.cumsum(n + (length - 1)) - (n + (length - 1)), text), int(n.sum())

    def open_hashes(data):
        window, order, at = _unpack(data, "<u8", "<i8", "<u4")
        return (window, order, at), len(window)

    def windows_of_runs(a, b, number, key, order, lo, n, starts, text):
        part, count = text[starts[a] : starts[b - 1] + n[b - 1] + length - 1], n[a:b]
        row = np.repeat(np.arange(a, b), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        hashes = string_hashes(part, length)[starts[row] - starts[a] + step]
        return key[row], hashes, order[row], np.full(len(row), number), lo[row] + step

    def windows_of_hashes(a, b, number, window, order, at):
        return window[a:b], window[a:b], order[a:b], np.full(b - a, number), at[a:b].astype(np.int64)

    def compare_range(parts, take, low, high):
        windows = []
        for part in parts:
            a = np.searchsorted(part[1], np.uint64(low))
            b = len(part[1]) if high > int(part[1][-1]) else np.searchsorted(part[1], np.uint64(high))
            if a < b:
                windows.append(take(a, b, *part))
        if not windows:
            return
        key, hashes, order, chunk, at = (np.concatenate(c) for c in zip(*windows))
        windows.clear()
        by = np.lexsort((order, hashes, key))
        key, hashes, order = key[by], hashes[by], order[by]
        first = _first(key, hashes)
        cut = by[order > order[first][np.cumsum(first) - 1]]
        yield from _by_chunk(_CUT, chunk[cut], at[cut], at[cut] + length)

    return run


def _apply(whole_characters: bool):
    @task("suffix")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, cuts, open_ = None, [], None
        for batch in batches:
            for kind, number, data, name in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if kind == _CHUNK:
                    if path is not None:
                        yield from _kept(path, cuts, whole_characters)
                    path, cuts, open_ = name, [], number
                elif number == open_:
                    cuts.append(_unpack(data, "<u4", "<u4"))
        if path is not None:
            yield from _kept(path, cuts, whole_characters)

    return run


def _kept(path: str, cuts: list, whole_characters: bool) -> Iterator[pa.RecordBatch]:
    chunk = Chunk(path)
    lo, hi = (np.concatenate(c).astype(np.int64) for c in zip(*cuts)) if cuts else (np.zeros(0, np.int64),) * 2
    lo, hi = _merged(lo, hi)
    # A stretch may touch the one of the next document: cut at the documents' ends.
    ends, starts = chunk.ends, np.append(0, chunk.ends[:-1])
    rows, size = [], 0
    firsts = np.searchsorted(hi, starts, side="right")
    lasts = np.searchsorted(lo, ends, side="left")
    for doc_id, start, end, first, last, extra in zip(
        chunk.ids, starts.tolist(), ends.tolist(), firsts.tolist(), lasts.tolist(), chunk.carried()
    ):
        spans = [(max(a, start), min(b, end)) for a, b in zip(lo[first:last].tolist(), hi[first:last].tolist())]
        kept, at = [], start
        for a, b in spans:
            kept.append(chunk.buffer[at:a])
            at = b
        kept.append(chunk.buffer[at:end])
        left = b"".join(kept)
        if whole_characters and spans:
            left = left.decode("utf-8", "ignore").encode()
        spans = [{"from": a - start, "to": b - start} for a, b in spans]
        rows.append((doc_id, end - start, sum(s["to"] - s["from"] for s in spans), len(spans), left, spans, extra))
        size += end - start
        if size > 1 << 20:
            yield _result(rows)
            rows, size = [], 0
    if rows:
        yield _result(rows)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), span, pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans", "carry"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def remove_repeats(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", carry: Column | None = None, length: int = LENGTH,
    batches: int = BATCHES, shard_bytes: int = SHARD_BYTES, whole_characters: bool = False,
) -> DataFrame:
    """`SuffixIndex.removed` of a whole table, fed in `batches` ranges of ascending ids."""
    fractions = [k / batches for k in range(1, batches)]
    cuts, size = docs.agg(
        F.percentile_approx(F.col(id).cast("long"), fractions or [0.5], 10_000), F.sum(F.octet_length(F.col(text).cast("string")))
    ).first()
    index = SuffixIndex(docs.sparkSession, max(16, math.ceil((size or 0) / shard_bytes)), length)
    bounds = sorted(set(cuts or [])) if fractions else []
    key = F.col(id).cast("long")
    for low, high in zip([None, *bounds], [*bounds, None]):
        inside = F.lit(True)
        if low is not None:
            inside &= (key > low) | key.isNull() if high is None else key > low
        if high is not None:
            inside &= key <= high
        index.add(docs.where(inside), id, text, carry)
    return index.removed(whole_characters)


def clean(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The same rows and columns with the repeated passages cut out of the text; of a character that is cut in two
    nothing stays, and a null text stays null."""
    others = [c for c in docs.columns if c not in (id, text)]
    null = "_null"
    while null in {c.lower() for c in others}:
        null = f"_{null}"
    beside = F.struct(F.col(text).isNull().alias(null), *(F.col(f"`{c}`") for c in others))
    kept = remove_repeats(docs, id=id, text=text, carry=F.to_json(beside, _FORMATS), whole_characters=True, **options)

    schema = docs.select(beside.alias("_")).schema["_"].dataType
    rows = kept.select(F.col("doc_id"), F.col("kept").cast("string").alias("_kept"), F.from_json("carry", schema, _FORMATS).alias("_beside"))
    back = {id: F.col("doc_id"), text: F.when(~F.col(f"_beside.{null}"), F.col("_kept"))} | {c: F.col(f"_beside.`{c}`") for c in others}
    return rows.select(*((back[c] if c in others else back[c].cast(docs.schema[c].dataType)).alias(c) for c in docs.columns))


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
