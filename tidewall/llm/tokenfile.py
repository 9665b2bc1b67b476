"""Token ids in files of independent zstandard frames with a trailing seek table.

A shard is a run of frames, each a complete zstandard frame with its own checksum that holds whole documents' ids as
little-endian unsigned 32-bit integers.  Behind them stand two skippable frames, so that `zstd -d` still reads the file:

    documents  magic 0x184D2A5D, size; per document: id (int64), null flag (uint8), tokens (uint32), frame (uint32)
    seek table magic 0x184D2A5E, size; per frame: compressed, decompressed, low 32 bits of XXH64 of the content (uint32
               each); then frames (uint32), descriptor 0x80, magic 0x8F92EAB1, preceded by the size of the first part

A reader takes the tail, then only the frames of the documents it wants, and checks each frame's checksum.

Defined results: a null text is an empty one (just the end id); a null id sorts first; rows of equal id stand one after
the other in order of their text; an empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import file_system, put, shared_folder, stored
from tidewall.llm.words import WordPieces

DOCUMENTS, SEEKABLE, FOOTER = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 18
SHARD_BYTES = 1 << 26
_ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("tokens", "<u4"), ("frame", "<u4")])
_FRAME = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


class ShardWriter:
    """Collects one shard; memory is bounded by the shard's compressed size and one frame (or one document)."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self._frame_bytes = frame_bytes
        self._zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self._out, self._open, self._open_bytes = [], [], 0
        self._entries, self._frames = [], []
        self.tokens, self.bytes = 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._entries.append((doc_id or 0, doc_id is None, len(ids) // 4, len(self._frames)))
        self._open.append(ids)
        self._open_bytes += len(ids)
        self.tokens += len(ids) // 4
        if self._open_bytes >= self._frame_bytes:
            self._close()

    def _close(self) -> None:
        if self._open:
            content = b"".join(self._open)
            packed = self._zstd.compress(content)
            self._frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            self._out.append(packed)
            self.bytes += len(packed)
            self._open, self._open_bytes = [], 0

    @property
    def documents(self) -> int:
        return len(self._entries)

    def finish(self) -> bytes:
        self._close()
        entries = np.array(self._entries, _ENTRY).tobytes()
        documents = struct.pack("<II", DOCUMENTS, len(entries)) + entries
        table = np.array(self._frames, _FRAME).tobytes() + struct.pack("<I", len(documents))
        table += struct.pack("<IBI", len(self._frames), 0x80, FOOTER)
        return b"".join([*self._out, documents, struct.pack("<II", SEEKABLE, len(table)), table])


class ShardReader:
    """Random access to one shard: reads the tail once, then single frames."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self._file = fs.open_input_file(path)
        size = self._file.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER:
            raise ValueError(f"{uri} has no seek table")
        table = count * _FRAME.itemsize + 13
        head = struct.unpack("<II", self._at(size - table - 8, 8))
        if head != (SEEKABLE, table):
            raise ValueError(f"{uri}: broken seek table")
        raw = self._at(size - table, table)
        self.frames = np.frombuffer(raw, _FRAME, count)
        documents = struct.unpack("<I", raw[-13:-9])[0]
        self.entries = np.frombuffer(self._at(size - table - 8 - documents, documents)[8:], _ENTRY)
        self._starts = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        self._zstd = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        return self._file.read_at(size, offset)

    def frame(self, k: int) -> bytes:
        content = self._zstd.decompress(self._at(int(self._starts[k]), int(self.frames["packed"][k])))
        if len(content) != self.frames["size"][k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.frames["check"][k]:
            raise ValueError(f"frame {k}: wrong checksum")
        return content

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, one frame in memory at a time."""
        at, current, content = 0, -1, b""
        for doc_id, null, tokens, frame in self.entries.tolist():
            if frame != current:
                current, content, at = frame, self.frame(frame), 0
            yield (None if null else doc_id), content[at : at + 4 * tokens]
            at += 4 * tokens

    def get(self, doc_ids: Iterable[int]) -> dict[int, bytes]:
        """Ids of the requested documents; only their frames are read and decompressed."""
        wanted = np.isin(self.entries["id"], list(doc_ids)) & (self.entries["null"] == 0)
        out = {}
        for k in np.unique(self.entries["frame"][wanted]):
            inside = np.flatnonzero(self.entries["frame"] == k)
            ends = np.cumsum(self.entries["tokens"][inside], dtype=np.int64) * 4
            content = self.frame(int(k))
            for i, end in zip(inside, ends):
                if wanted[i]:
                    out[int(self.entries["id"][i])] = content[end - 4 * int(self.entries["tokens"][i]) : end]
        return out

    def close(self) -> None:
        self._file.close()


def write_tokens(
    docs: DataFrame, vocabulary: str, *, id: str = "doc_id", text: str = "text", end_id: int = 1,
    folder: str | None = None, shard_bytes: int = SHARD_BYTES, frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Encodes every text and writes shards in ascending order of ids; the manifest's rows are (`part`, `shard`, `path`,
    `documents`, `tokens`), in order by (`part`, `shard`).

    One range shuffle.  A task that runs again writes the same files again; only files in the manifest count.
    """
    folder = folder or shared_folder(docs.sparkSession, "token-shards")
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordPieces.shared(vocabulary)
        part, shard, writer = TaskContext.get().partitionId(), 0, ShardWriter(frame_bytes)
        end = struct.pack("<I", end_id)

        def flush():
            path = f"{folder}/part-{part:06d}-{shard:04d}.tok"
            put(path, writer.finish())
            return pa.RecordBatch.from_pylist(
                [{"part": part, "shard": shard, "path": path, "documents": writer.documents, "tokens": writer.tokens}],
                pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()),
                           ("documents", pa.int64()), ("tokens", pa.int64())]),
            )

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, encoded in zip(ids, words.encode_all(batch.column(1))):
                writer.add(doc_id, encoded + end)
                if writer.bytes >= shard_bytes:
                    yield flush()
                    shard, writer = shard + 1, ShardWriter(frame_bytes)
        if writer.documents:
            yield flush()

    # By range and then in order of the id; equal ids by their text, so that a rerun writes the same bytes.
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    return stored(ordered.mapInArrow(write, "part int, shard int, path string, documents long, tokens long"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Rows (`doc_id`, `start`, `n_tokens`, `ids_crc32`) from the files themselves, a task per shard.

    `start` counts the ids of all documents before; the offsets of the shards come from the manifest, a row per shard of
    64 MiB, which Spark sums up in one window.
    """
    manifest.createOrReplaceTempView("_token_manifest")
    shards = manifest.sparkSession.sql(
        """SELECT path, sum(tokens) OVER (ORDER BY part, shard ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens
           AS before FROM _token_manifest"""
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(path)
                rows = ([], [], [], [])
                for doc_id, ids in reader.documents():
                    for column, value in zip(rows, (doc_id, before, len(ids) // 4, zlib.crc32(ids))):
                        column.append(value)
                    before += len(ids) // 4
                reader.close()
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)

    spread = shards.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
