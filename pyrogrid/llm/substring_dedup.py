"""Substring dedup: chunks between local peaks of a gear hash, deduplicated by digest.

A chunk ends where the rolling hash is the largest within RADIUS bytes on both sides.
Such cuts depend on the bytes around them alone, so text inserted elsewhere leaves the
chunks of a passage as they are.  Chunks are grouped by digest; a digest found in two
different documents is repeated.  Neighbouring repeated chunks of a document form a
run, and runs of MIN_WORDS words or more are reported: at least that much of a
repeated passage of 50 words lies within whole chunks, while a common line stays below.
Where white space does not tell words (the run has WORD_CHARS code points a word or
more), runs of MIN_WORDS times half as many code points are reported as well.
A run is divided into spans of first and of later copies, which may be shorter.

Positions are in code points of the original text.  Null and empty texts have no
chunks.  Passages repeated only within one document are not reported, nor is anything
of rows without id.  Rows that repeat an id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid.llm.chunking import peak_cuts
from pyrogrid.llm.common import list_array, raw_texts, rows_of, texts_of
from pyrogrid.session import stored

RADIUS = 16
# Texts without a peak (one short pattern over and over) are cut at this many bytes.
MOST_BYTES = 512
MIN_WORDS = 25
# No script that separates its words has words of this many code points on average.
WORD_CHARS = 20


def _cut(text: bytes, radius: int) -> np.ndarray:
    """Chunk borders of a text in bytes, both ends included."""
    data = np.frombuffer(text, dtype=np.uint8)
    borders = np.union1d(np.array([0, len(text)]), peak_cuts(data, radius))
    gaps = np.flatnonzero(np.diff(borders) > MOST_BYTES)
    if len(gaps):
        extra = [np.arange(borders[k] + MOST_BYTES, borders[k + 1], MOST_BYTES) for k in gaps]
        borders = np.union1d(borders, np.concatenate(extra))
    # Cuts go to the start of a code point.
    inner = borders[:-1]
    while (part := (data[inner] & 0xC0) == 0x80).any():
        inner = np.unique(np.where(part, inner - 1, inner))
    return np.append(inner, len(text))


def chunk_lists(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, digests, ends, words): digest, end in code points and words begun, per chunk in order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch, texts in rows_of(batches):
            digests, ends, words = [], [], []
            for text in texts:
                if not text:
                    for column in (digests, ends, words):
                        column.append(np.empty(0, dtype=np.int64))
                    continue
                borders = _cut(text, radius)
                cuts = borders.tolist()
                digests.append(np.array([digest(text[a:b]) for a, b in zip(cuts, cuts[1:])], dtype=np.uint64).view(np.int64))
                data = np.frombuffer(text, dtype=np.uint8)
                points = np.cumsum((data & 0xC0) != 0x80)
                blank = (data == 32) | ((data >= 9) & (data <= 13))
                begun = np.cumsum(~blank & np.concatenate(([True], blank[:-1])))
                last = borders[1:] - 1
                ends.append(points[last])
                words.append(np.diff(begun[last], prepend=0))
            columns = [batch.column(0), list_array(digests, pa.int64()), list_array(ends, pa.int64()), list_array(words, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "digests", "ends", "words"])

    kind = "doc_id long, digests array<long>, ends array<long>, words array<long>"
    return docs.select("doc_id", "text").mapInArrow(of, kind)


def spans(docs: DataFrame, min_words: int = MIN_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words, n_chunks, first_doc_id, is_first) of each repeated span.

    ``first_doc_id`` is the smallest id among the documents that share any chunk of the
    span; ``is_first`` tells that the span is the copy to keep.  First and later copies
    are never in one span.
    """
    texts = texts_of(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    lists = chunk_lists(texts, radius).filter(F.size("digests") > 0)
    lists = stored(lists.withColumn("row", F.monotonically_increasing_id()), "chunks")
    once = lists.select("doc_id", F.explode(F.array_distinct("digests")).alias("digest"))
    seen = once.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    repeated = stored(seen.filter("low < high").select("digest", "low"), "repeated")
    each = lists.select("row", "doc_id", F.posexplode("digests").alias("at", "digest"))
    own = (F.col("doc_id") == F.col("low")).alias("own")
    hits = each.join(repeated, "digest").select("row", "doc_id", "at", "low", own)
    # Neighbours keep the same difference between position and rank: those of a run among all repeated chunks, those of a part among chunks of one kind.
    ranked = hits.withColumns({
        "run": F.col("at") - F.row_number().over(Window.partitionBy("row").orderBy("at")),
        "part": F.col("at") - F.row_number().over(Window.partitionBy("row", "own").orderBy("at")),
    })
    runs = ranked.groupBy("row", "own", "run", "part").agg(
        F.min("at").alias("head"), F.max("at").alias("tail"), F.min("low").alias("first_doc_id")
    )
    whole = Window.partitionBy("row", "run")
    runs = runs.withColumns({"from": F.min("head").over(whole), "to": F.max("tail").over(whole)})
    found = runs.join(lists.select("row", "doc_id", "ends", "words"), "row")
    start = F.when(F.col("head") == 0, F.lit(0)).otherwise(F.element_at("ends", F.col("head")))
    inside = F.slice("words", F.col("head") + 1, F.col("tail") - F.col("head") + 1)
    run_words = F.aggregate(F.slice("words", F.col("from") + 1, F.col("to") - F.col("from") + 1), F.lit(0).cast("long"), lambda a, b: a + b)
    found = found.select(
        "doc_id", start.cast("long").alias("start"), F.element_at("ends", F.col("tail") + 1).alias("end"),
        F.aggregate(inside, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_words"),
        (F.col("tail") - F.col("head") + 1).cast("long").alias("n_chunks"), "first_doc_id",
        F.col("own").alias("is_first"), run_words.alias("_words"),
        (F.element_at("ends", F.col("to") + 1) - F.when(F.col("from") == 0, F.lit(0)).otherwise(F.element_at("ends", F.col("from")))).alias("_chars"),
    )
    unbroken = (F.col("_chars") >= WORD_CHARS * F.col("_words")) & (F.col("_chars") >= min_words * WORD_CHARS // 2)
    return found.filter((F.col("_words") >= min_words) | unbroken).drop("_words", "_chars")


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (unique doc_id) with every reported span but the first copy cut out of the text."""
    cuts = found.filter("NOT is_first").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))

    def shorten(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(raw_texts(texts), cuts.to_pylist(), strict=True):
            shown, at, parts = text.decode(), 0, []
            for cut in own:
                parts.append(shown[at : cut["start"]])
                at = cut["end"]
            out.append("".join(parts) + shown[at:])
        return pa.array(out, pa.string())

    udf = F.arrow_udf(shorten, "string")
    joined = docs.join(cuts, "doc_id", "left")
    cut_text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(udf("text", F.coalesce("_cuts", F.array().cast("array<struct<start:bigint,end:bigint>>"))))
    return joined.withColumn("text", cut_text).select(docs.columns)
