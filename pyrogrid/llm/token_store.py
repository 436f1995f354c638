"""Token files: one zstandard frame per document, one shared dictionary, an offset index.

Documents are range-partitioned and sorted by id; every partition becomes one file:

    magic, dictionary hash (32 bytes), frames one after another, index, footer

The index holds id, offset of the frame, number of ids and width of an id for each
document, so one short document is read with two small reads.  Ids below 65,536 are
serialised as 16-bit, larger ones as 32-bit little-endian integers.  The dictionary is
trained on the serialised ids of a bounded sample and lies beside the files under its
hash; it steers size alone, never content.

Files are written under a name of the task attempt and renamed when complete, so a
repeated or speculative task leaves one whole file.  They go to a folder that all
machines share, through the file system its address names.

A null text is an empty document.  Rows without id come first; rows of one id are kept
apart and ordered by text.  An empty table makes files without documents.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid.llm.common import rows_of
from pyrogrid.llm.word_ids import tokenizer
from pyrogrid.session import scratch_path, stored

MAGIC = b"TOKZSTD1"
END_ID = 2
# Documents the dictionary is trained on (expected), ids taken of each, and its size.
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 2_000, 4_096, 64 * 1024
LEVEL = 3
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("width", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")])
FOOTER = struct.Struct("<QQ8s")


def serialise(ids: np.ndarray) -> tuple[bytes, int]:
    """Bytes of the ids and the width of one."""
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    return ids.astype(f"<u{width}").tobytes(), width


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder address (``file:/x``, ``hdfs://host/x``, ... or a bare path)."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def train_dictionary(docs: DataFrame, path: str, end_id: int = END_ID) -> bytes:
    """Dictionary from the serialised ids of about SAMPLE_DOCUMENTS rows; empty without rows."""
    count = docs.count()
    if not count:
        return b""
    sample = docs.sample(fraction=min(1.0, SAMPLE_DOCUMENTS / count), seed=8).select("text")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch, texts in rows_of(batches):
            out = [serialise(np.append(np.frombuffer(own.encode(t), dtype="<u4"), end_id)[:SAMPLE_IDS])[0] for t in texts]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["ids"])

    samples = [bytes(row.ids) for row in sample.mapInArrow(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves serve
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


class ShardWriter:
    """One file, written front to back; only the index of its documents is kept in memory."""

    def __init__(self, sink, dictionary: bytes) -> None:
        self.sink, self.at, self.index = sink, 0, []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        self._put(MAGIC + hashlib.sha256(dictionary).digest())

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data, width = serialise(ids)
        frame = self.compressor.compress(data)
        self.index.append((doc_id or 0, doc_id is not None, width, self.at, len(frame), len(ids)))
        self._put(frame)

    def finish(self) -> None:
        start = self.at
        self._put(np.array(self.index, dtype=INDEX).tobytes())
        self._put(FOOTER.pack(start, len(self.index), MAGIC))


class ShardReader:
    """Documents of one file, all or by id."""

    def __init__(self, source, folder: str) -> None:
        self.source = source
        size = source.size()
        start, count, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        head = self._at(0, len(MAGIC) + 32)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.index = np.frombuffer(self._at(start, count * INDEX.itemsize), dtype=INDEX)
        dictionary = read_dictionary(folder, head[len(MAGIC) :].hex())
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def ids(self, entry: np.void) -> np.ndarray:
        data = self.decompressor.decompress(self._at(int(entry["offset"]), int(entry["size"])))
        return np.frombuffer(data, dtype=f"<u{entry['width']}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document of that id in this file."""
        unknown = len(self.index) - int(self.index["known"].sum())
        known = self.index["doc_id"][unknown:]
        low, high = np.searchsorted(known, doc_id, "left"), np.searchsorted(known, doc_id, "right")
        return [self.ids(entry) for entry in self.index[unknown + low : unknown + high]]


def write_dictionary(folder: str, dictionary: bytes) -> str:
    """Write the dictionary under its hash; return the hash."""
    name = hashlib.sha256(dictionary).hexdigest()
    system, base = _place(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{name}.dict") as sink:
        sink.write(dictionary)
    return name


def read_dictionary(folder: str, name: str) -> bytes:
    system, base = _place(folder)
    with system.open_input_file(f"{base}/{name}.dict") as source:
        dictionary = source.read()
    if hashlib.sha256(dictionary).hexdigest() != name:
        raise ValueError("dictionary does not match its hash")
    return dictionary


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of (doc_id, text) below ``folder``; return (shard, file, first_id, last_id, n_docs, n_tokens) per file."""
    dictionary = write_dictionary(folder, train_dictionary(docs, path, end_id))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = tokenizer(path), np.array([end_id], dtype="<u4")
        system, base = _place(folder)
        number = TaskContext.get().partitionId()
        name = f"{number:08d}.tok"
        attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
        tokens, first, last = 0, None, None
        with system.open_output_stream(attempt) as sink:
            writer = ShardWriter(sink, read_dictionary(folder, dictionary))
            for batch, texts in rows_of(batches):
                for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    ids = np.concatenate((np.frombuffer(own.encode(text), dtype="<u4"), end))
                    writer.add(doc_id, ids)
                    tokens, last = tokens + len(ids), doc_id
                    first = doc_id if first is None else first
            writer.finish()
        system.move(attempt, f"{base}/{name}")
        columns = [[number], [name], [first], [last], [len(writer.index)], [tokens]]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "file", "first_id", "last_id", "n_docs", "n_tokens"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "shard long, file string, first_id long, last_id long, n_docs long, n_tokens long"
    return stored(ordered.mapInArrow(shard, schema), "token-files")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, read from the files that ``write`` lists."""
    # One row per file: their running total is a small table.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.filter("n_docs > 0").select("shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['file']}") as source:
                    reader, start = ShardReader(source, folder), row["start"]
                    for k in range(0, len(reader.index), 256):
                        out = []
                        for entry in reader.index[k : k + 256]:
                            ids = reader.ids(entry)
                            doc_id = int(entry["doc_id"]) if entry["known"] else None
                            out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
                            start += len(ids)
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                        yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    spread = listed.repartitionByRange(max(1, manifest.count()), "shard")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def find(manifest: DataFrame, folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents of one id, by the index of the files whose range holds it."""
    system, base = _place(folder)
    found = []
    for row in manifest.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).collect():
        with system.open_input_file(f"{base}/{row['file']}") as source:
            found += ShardReader(source, folder).find(doc_id)
    return found


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a new folder of the shared scratch space and read it back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, path, end_id), folder).select("doc_id", "start", "n_tokens", "ids_crc32")
