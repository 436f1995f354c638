"""Exact dedup by chunk recipes: texts are equal when their lists of chunk identifiers are.

Every text is cut into content-defined chunks.  Chunk bytes are grouped once by
(digest, bytes), with partial grouping before the shuffle, which verifies that a digest
stands for one content; where it stands for several, they are numbered.  A text is then
the ordered list of its (digest, number) identifiers, and whole texts are compared
through these short lists, so a long document moves at most once, in pieces, and
repeated pieces of one task not even that.

Texts are compared after lower-casing A to Z only.  Null counts as empty; all empty
texts are equal.  Of equal texts the row with the largest id stays; rows without id
come last, and of rows that repeat an id one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid.llm.chunking import masked_cuts
from pyrogrid.llm.common import ascii_lower, free_name, list_array, rows_of, texts_of
from pyrogrid.session import stored

AVERAGE, LEAST, MOST = 4096, 1024, 32768
DIGEST_BITS = 64
# Differing contents of one digest are so rare that their list is broadcast; beyond this count it is joined.
BROADCAST_CLASHES = 10_000
# Rows of one recipe are dealt to this many keys, so that a group with a third of all rows is not one task's.
SALTS = 256


def _chunks(texts: list[bytes]) -> list[list[bytes]]:
    """Chunks of the normalised texts."""
    lowered = b"".join(texts).lower()  # bytes.lower() changes A to Z only
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    cuts = masked_cuts(np.frombuffer(lowered, dtype=np.uint8), starts, ends, AVERAGE, LEAST, MOST)
    return [[lowered[a:b] for a, b in zip([s, *own], own)] for s, own in zip(starts.tolist(), cuts, strict=True)]


def _digest(chunk: bytes, bits: int) -> int:
    value = xxhash.xxh3_64_intdigest(chunk) >> (64 - bits)
    return value - (1 << 64) if value >> 63 else value


def chunks(docs: DataFrame, digest_bits: int = DIGEST_BITS) -> DataFrame:
    """(digest, chunk): the chunks of (doc_id, text), each at most once per batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in rows_of(batches):
            own = {chunk for parts in _chunks(texts) for chunk in parts}
            yield pa.record_batch([pa.array([_digest(c, digest_bits) for c in own], pa.int64()), pa.array(list(own), pa.binary())], names=["digest", "chunk"])

    return docs.select("text").mapInArrow(cut, "digest long, chunk binary")


def recipes(docs: DataFrame, digest_bits: int = DIGEST_BITS) -> DataFrame:
    """(doc_id, text_sha256, digests) of (doc_id, text): the digests in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            parts = _chunks(texts)
            sha = [hashlib.sha256(b"".join(p)).hexdigest() for p in parts]
            lists = list_array([np.array([_digest(c, digest_bits) for c in p], dtype=np.int64) for p in parts], pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(sha), lists], names=["doc_id", "text_sha256", "digests"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, text_sha256 string, digests array<long>")


def clashes(docs: DataFrame, digest_bits: int = DIGEST_BITS) -> DataFrame:
    """(digest, chunk, number from 1) of every content but the first of digests that stand for several."""
    verified = chunks(docs, digest_bits).groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("n"))
    several = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest")
    several = stored(several, "clashes")
    if several.isEmpty():
        return several.select("digest", F.lit(None).cast("binary").alias("chunk"), F.lit(0).alias("number")).limit(0)
    again = chunks(docs, digest_bits).join(several, "digest").distinct()
    numbered = again.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("chunk")) - 1)
    return stored(numbered.filter("number > 0"), "clashes")


def _numbered(own: DataFrame, docs: DataFrame, found: DataFrame, digest_bits: int) -> DataFrame:
    """``own`` with the identifier list of rows that hold a numbered content replaced."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            for doc_id, cut in zip(batch.column(0).to_pylist(), _chunks(texts), strict=True):
                sha = hashlib.sha256(b"".join(cut)).hexdigest()
                columns = [
                    pa.array([doc_id] * len(cut), pa.int64()), pa.array([sha] * len(cut), pa.string()), pa.array(range(len(cut)), pa.int32()),
                    pa.array([_digest(c, digest_bits) for c in cut], pa.int64()), pa.array(cut, pa.binary()),
                ]
                yield pa.record_batch(columns, names=["doc_id", "text_sha256", "at", "digest", "chunk"])

    occurrences = docs.select("doc_id", "text").mapInArrow(parts, "doc_id long, text_sha256 string, at int, digest long, chunk binary")
    few = found.count() <= BROADCAST_CLASHES
    hits = occurrences.join(F.broadcast(found) if few else found, ["digest", "chunk"]).select("text_sha256", "at", "number").distinct()
    numbers = hits.groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("at", "number"))).alias("numbers"))
    joined = own.join(numbers, "text_sha256", "left")
    ids = F.transform("digests", lambda d, k: F.struct(d.alias("digest"), F.coalesce(F.try_element_at("numbers", k), F.lit(0)).alias("number")))
    return joined.select("row", "doc_id", "text_sha256", ids.alias("recipe"))


def _best(own: DataFrame, texts: DataFrame, found: DataFrame, digest_bits: int) -> DataFrame:
    """``own`` (row, doc_id, text_sha256, digests of ``texts``) with keep_id, group_size and kept."""
    if found.isEmpty():
        own = own.select("row", "doc_id", "text_sha256", F.col("digests").alias("recipe"))
    else:
        own = stored(_numbered(own, texts, found, digest_bits), "recipes")
    own = own.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    # Nulls order first in a struct, so a row with an id wins over one without.
    parts = own.groupBy("recipe", "salt").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    best = parts.groupBy("recipe").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
    # A group's result goes only to the keys that its rows have.
    best = best.select("recipe", "best", "group_size", F.explode("salts").alias("salt"))
    return own.join(best, ["recipe", "salt"]).select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"
    )


def groups(docs: DataFrame, digest_bits: int = DIGEST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``."""
    own_texts = texts_of(docs, id_col, text_col)
    found = clashes(own_texts, digest_bits)
    own = stored(recipes(own_texts, digest_bits).withColumn("row", F.monotonically_increasing_id()), "recipes")
    return _best(own, own_texts, found, digest_bits).drop("row")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any other columns) that stay, with all their columns.

    Rows that repeat both id and text are one document and stay once.
    """
    key, sha, n = (free_name(c, docs.columns) for c in ("key", "sha", "n"))
    known = F.coalesce("doc_id", F.lit(-(2**63)))
    kept = groups(docs).filter("kept").select(known.alias(key), F.col("text_sha256").alias(sha))
    own_sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    found = docs.withColumns({key: known, sha: own_sha}).join(kept, [key, sha], "left_semi")
    numbered = found.withColumn(n, F.row_number().over(Window.partitionBy(key, sha).orderBy(F.lit(0))))
    return numbered.filter(F.col(n) == 1).select(docs.columns)
