"""Token ids in files of independent zstandard frames with a trailing seek table and per-frame checksums.

A file is: the frames of its documents in order; a skippable frame with the frames' documents; and
a skippable frame with the seek table, laid out as in the public zstd seekable format, so plain zstd
tools can read the ids as well. A frame holds little-endian unsigned 32-bit ids of one document;
a document of more than FRAME_IDS ids has several frames.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import put_on_path, shared_dir, text_blocks, written
from .tokens import WORK, default_tokenizer, ended_ids

FRAME_IDS = 1 << 18
# Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC, SEEK_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: doc_id, whether there is one, whether the document starts with this frame.
_DOC = struct.Struct("<q??")
_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")


class FrameWriter:
    def __init__(self, sink, level: int = 3):
        self.sink, self.level = sink, zstandard.ZstdCompressor(level=level)
        self.documents, self.entries, self.ids, self.size = [], [], 0, 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        for at in range(0, max(1, len(data)), 4 * FRAME_IDS):
            part = data[at : at + 4 * FRAME_IDS]
            frame = self.level.compress(part)
            self.sink.write(frame)
            self.size += len(frame)
            self.entries.append(_ENTRY.pack(len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
            self.documents.append(_DOC.pack(doc_id or 0, doc_id is not None, at == 0))
        self.ids += len(data) // 4

    def close(self) -> None:
        docs = b"".join(self.documents)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(docs)) + docs)
        table = b"".join(self.entries) + _FOOTER.pack(len(self.entries), CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.size += 16 + len(docs) + len(table)


class FrameReader:
    """Reads the seek table from the end of a file; then only the frames asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, descriptor, magic = _FOOTER.unpack(source.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != SEEKABLE_MAGIC or descriptor != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table_at = size - _FOOTER.size - n * _ENTRY.size - 8
        docs_at = table_at - n * _DOC.size
        self.entries = list(_ENTRY.iter_unpack(source.read_at(n * _ENTRY.size, table_at + 8)))
        self.documents = list(_DOC.iter_unpack(source.read_at(n * _DOC.size, docs_at)))
        self.offsets = [0]
        for length, _, _ in self.entries:
            self.offsets.append(self.offsets[-1] + length)
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        length, size, checksum = self.entries[k]
        data = self.zstd.decompress(self.source.read_at(length, self.offsets[k]), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k}: its checksum does not hold")
        return data

    def __iter__(self) -> Iterator[tuple[int | None, list[int]]]:
        """(doc_id, numbers of its frames) in file order."""
        at = 0
        while at < len(self.documents):
            end = at + 1
            while end < len(self.documents) and not self.documents[end][2]:
                end += 1
            doc_id, known, _ = self.documents[at]
            yield (doc_id if known else None), list(range(at, end))
            at = end


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, level: int = 3) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text), each with the end id, in ascending doc_id order.

    Files are range partitions of doc_id, in order. A task writes under a name of its own and moves
    the whole file into place, so a retried or doubled task leaves one whole file. Returns the written
    manifest: part, path, n_documents, n_ids, n_bytes. A null or empty text is the end id
    alone; rows without a doc_id come first; rows that repeat a doc_id are written each, by text; an
    empty table gives no files; further columns are ignored.
    """
    put_on_path(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, base = pafs.FileSystem.from_uri(folder)
        mine, name = f"{base}/.{uuid.uuid4().hex}", f"{base}/part-{part:08d}.ids.zst"
        n, out, sink = 0, None, None
        for rows, texts in text_blocks(batches, 1, work=WORK):
            if sink is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(mine, compression=None)
                out = FrameWriter(sink, level)
            for doc_id, data in zip(rows.column(0).to_pylist(), ended_ids(path, texts), strict=True):
                out.add(doc_id, data)
                n += 1
        if sink is not None:
            out.close()
            sink.close()
            store.move(mine, name)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name, n, out.ids, out.size)], ["part", "path", "n_documents", "n_ids", "n_bytes"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, "part long, path string, n_documents long, n_ids long, n_bytes long"), "manifest")


def read_token_files(manifest: DataFrame, folder: str, doc_ids: Iterable[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Reads files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on request, ids.

    ``manifest`` has one row per file; the window over it numbers files, not documents. With ``doc_ids``
    only the frames of those documents are decompressed. Every frame that is read is held against its
    checksum. A document without a doc_id comes back without one, repeated ones each; an empty
    manifest gives no rows.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
        kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
        for rows in batches:
            for path, before in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as source:
                    reader, out, held = FrameReader(source), [], 0
                    for doc_id, frames in reader:
                        n = sum(reader.entries[k][1] for k in frames) // 4
                        if wanted is None or doc_id in wanted:
                            crc, data = 0, []
                            for k in frames:
                                frame = reader.frame(k)
                                crc = zlib.crc32(frame, crc)
                                if with_ids:
                                    data.append(frame)
                            out.append((doc_id, before, n, crc, *([b"".join(data)] if with_ids else [])))
                            held += 64 + 4 * n * with_ids
                        before += n
                        if held > 1 << 20:
                            yield _rows(out, names, kinds)
                            out, held = [], 0
                    if out:
                        yield _rows(out, names, kinds)

    files = manifest.count()
    put_on_path(manifest.sparkSession)
    first = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return manifest.select("part", "path", first.alias("first")).repartition(max(1, files), "part").select("path", "first").mapInArrow(read, schema)


def _rows(out: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def token_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "tokens")
