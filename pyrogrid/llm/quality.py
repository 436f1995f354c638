"""Quality classifier: averaged subword embeddings with softmax output, trained by numpy gradient descent.

Features of a text are its words, pairs of neighbouring words, and the character
n-grams of each word with its borders, hashed into BUCKETS; a word that repeats the one
before it, and a pair that repeats an earlier pair of the same text, have features of
their own.  Each bucket has a learned vector; a document is the average of its
features' vectors, and a softmax layer gives the two labels' probabilities.

Training takes up to SAMPLE_PER_LABEL labelled documents of each label in expectation,
chosen by a hash of the id among rows open to learning, gathers their sparse feature
counts (bounded by the sample), and runs EPOCHS of stochastic gradient descent on the
driver.  The layer after averaging is linear, so scoring looks up one number per
bucket: its vector times the difference of the two output rows.

Null and empty texts have no features and get the score of the bias alone.  Labels
learn from are 0 and 1; other or null labels and documents without id are ignored.
Without labelled rows of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import held_out, raw_texts, rows_of
from pyrogrid.llm.ngrams import blocks, gram_hashes, is_blank, layout, scramble

BUCKETS = 1 << 15
SIZES = (1, 2, 3, 4)
DIMENSIONS = 8
EPOCHS, RATE = 12, 0.5
SAMPLE_PER_LABEL = 1_200
THRESHOLD = 0.7


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row of the part, bucket) of every feature occurrence of a block."""
    points, starts, _ = layout(parts)
    blank = is_blank(points)
    part_of = np.repeat(np.arange(len(parts)), np.diff(np.append(starts, len(points))))
    rows, buckets = [], []
    # Character n-grams with at most a border at either end.
    inner_blank = np.concatenate(([0], np.cumsum(blank)))
    for n in SIZES:
        hashes = gram_hashes(points, n)
        at = np.arange(len(hashes))
        if n > 2:
            whole = inner_blank[at + n - 1] == inner_blank[at + 1]
        else:
            whole = ~blank[: len(hashes)] if n == 1 else ~(blank[: len(hashes)] & blank[1 : len(hashes) + 1])
        rows.append(part_of[at[whole]])
        buckets.append(scramble(hashes[whole] ^ np.uint64(0xC4A5), BUCKETS))
    # Words: a hash of all their characters.
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if len(begins):
        ends = np.flatnonzero(~blank & np.concatenate((blank[1:], [True]))) + 1
        # The text starts with a space, so there are positions before the first word.
        heads = np.append(0, begins)
        place = np.arange(len(points)) - np.repeat(heads, np.diff(np.append(heads, len(points))))
        mixed = (points + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed[blank] = 0
        words = np.add.reduceat(mixed, begins) + (ends - begins).astype(np.uint64)
        of = part_of[begins]
        rows.append(of)
        buckets.append(scramble(words ^ np.uint64(0x517), BUCKETS))
        same = of[1:] == of[:-1]
        again = same & (words[1:] == words[:-1])
        rows.append(of[1:][again])
        buckets.append(np.full(int(again.sum()), 0))
        pairs = (words[:-1] * np.uint64(3) + words[1:])[same]
        rows.append(of[1:][same])
        buckets.append(scramble(pairs ^ np.uint64(0x9A1), BUCKETS))
        if len(pairs):
            # Pairs that occurred before in the same part.
            order = np.lexsort((pairs, of[1:][same]))
            sorted_pairs, sorted_of = pairs[order], of[1:][same][order]
            before = (sorted_pairs[1:] == sorted_pairs[:-1]) & (sorted_of[1:] == sorted_of[:-1])
            rows.append(sorted_of[1:][before])
            buckets.append(np.full(int(before.sum()), 1))
    return np.concatenate(rows), np.concatenate(buckets)


def counted(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, buckets, counts) of each block of each text that has features."""
    for numbers, parts in blocks(texts):
        rows, buckets = features(parts)
        cells, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
        cuts = np.flatnonzero(np.diff(cells // BUCKETS, prepend=-1))
        for own, n in zip(np.split(cells, cuts[1:]), np.split(counts, cuts[1:]), strict=True) if len(cells) else ():
            yield int(numbers[own[0] // BUCKETS]), (own % BUCKETS).astype(np.int32), n.astype(np.int32)


class Model:
    """One weight per bucket, a bias, and what led to them."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), float(bias)


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 6) -> Model:
    """Stochastic gradient descent over (buckets, counts) of documents; both labels weigh the same in sum."""
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)))
    draw = np.random.Generator(np.random.PCG64(seed))
    vectors = draw.uniform(-1, 1, size=(BUCKETS, DIMENSIONS)) / DIMENSIONS
    output = np.zeros((2, DIMENSIONS + 1))
    weight = len(labels) / (2.0 * np.bincount(labels, minlength=2))
    steps, step = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in draw.permutation(len(examples)):
            rate = RATE * (1 - step / steps)
            step += 1
            buckets, counts = examples[k]
            share = counts / counts.sum() if len(counts) else counts.astype(float)
            hidden = np.append(share @ vectors[buckets], 1.0)
            logits = output @ hidden
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[k]] -= 1.0
            chance *= weight[labels[k]]
            slope = chance @ output[:, :DIMENSIONS]
            output -= rate * np.outer(chance, hidden)
            # Every feature moves by its share, as the average hands its gradient on; sparse rows need larger steps.
            vectors[buckets] -= rate * 20.0 * share[:, None] * slope
    difference = output[1] - output[0]
    return Model(vectors @ difference[:DIMENSIONS], difference[DIMENSIONS])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL) -> Model:
    """Learn from ``labels`` (doc_id, quality) of the open rows of ``docs`` (doc_id, text)."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {row.quality: row.n for row in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit([], np.empty(0, dtype=np.int64))
    share = F.create_map(*[F.lit(v) for q, n in sizes.items() for v in (q, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.filter(draw < share[F.col("quality")]).select("doc_id", "quality")
    # At most ``sample`` rows of each label are expected here: a bounded side.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            labels, ids = batch.column(batch.schema.get_field_index("quality")).to_pylist(), batch.column(0).to_pylist()
            out = [(ids[n], labels[n], b.tobytes(), c.tobytes()) for n, b, c in counted([t.decode() for t in texts])]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "quality", "buckets", "counts"])

    found = texts.select("doc_id", "quality", "text").mapInArrow(of, "doc_id long, quality int, buckets binary, counts binary").collect()
    found.sort(key=lambda row: (row.doc_id, row.quality, bytes(row.buckets)))
    examples = [(np.frombuffer(row.buckets, dtype=np.int32), np.frombuffer(row.counts, dtype=np.int32)) for row in found]
    return fit(examples, np.array([row.quality for row in found], dtype=np.int64))


def scores_of(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of label 1 for each text."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for numbers, parts in blocks(texts):
        rows, buckets = features(parts)
        total += np.bincount(numbers[rows], weights=model.weights[buckets], minlength=len(texts))
        count += np.bincount(numbers[rows], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-(total / np.maximum(count, 1) + model.bias)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text and any other columns) with column score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def of(texts: pa.Array) -> pa.Array:
        return pa.array(scores_of(Model(*shared.value), [t.decode() for t in raw_texts(texts)]), pa.float64())

    return docs.withColumn("score", F.arrow_udf(of, "double").asNondeterministic()("text"))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``."""
    found = score(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
