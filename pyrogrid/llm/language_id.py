"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of up to SAMPLE_PER_LANGUAGE documents of each language
(chosen by a hash of the id among the rows open to learning), adds SMOOTHING to every
bucket, and keeps one matrix of log-probabilities, bounded by buckets times languages,
which is broadcast.  A document is a sparse row of n-gram occurrences; its score is the
row times the matrix, summed in numpy for many documents at once, plus the log-priors.

A null text, and one without any letter, is ``und`` with score 0.  Languages learned
are the non-null values found; without any, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm.common import held_out, rows_of
from pyrogrid.llm.ngrams import blocks, gram_hashes, layout, scramble

SIZES = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
# Documents of a language that training looks at, in expectation.
SAMPLE_PER_LANGUAGE = 3_000
UNDETERMINED = "und"
# Documents that the pipeline rejects: undetermined, or scored below this.
LEAST_SCORE = 0.5


class Model:
    """Languages, log-priors and log-probabilities (buckets by languages)."""

    def __init__(self, languages: list[str], prior: np.ndarray, table: np.ndarray) -> None:
        self.languages, self.prior, self.table = languages, prior, table


def _grams(parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets per position, start and end of each part) for each n-gram size."""
    points, starts, ends = layout([p.lower() for p in parts])
    for n in SIZES:
        yield scramble(gram_hashes(points, n), BUCKETS), starts, ends


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from ``docs`` (doc_id, text, lang)."""
    open_rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {row.lang: row.n for row in open_rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.empty(0), np.empty((BUCKETS, 0), dtype=np.float32))
    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, sample / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = open_rows.filter(draw < share[F.col("lang")]).select("lang", "text")
    number = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS * len(number), dtype=np.int64)
        for batch, texts in rows_of(batches):
            of = np.array([number[lang] for lang in batch.column(0).to_pylist()])
            for rows, parts in blocks([t.decode() for t in texts]):
                for buckets, starts, ends in _grams(parts):
                    inside = np.zeros(len(buckets), dtype=bool)
                    inside[np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])] = True
                    cells = buckets[inside] * len(number) + np.repeat(of[rows], ends - starts)
                    table += np.bincount(cells, minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], names=["cell", "n"])

    counted = chosen.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.full(BUCKETS * len(languages), SMOOTHING)
    for cell, n in counted:
        table[cell] += n
    table = table.reshape(BUCKETS, len(languages))
    total = np.array([sizes[lang] for lang in languages], dtype=float)
    return Model(languages, np.log(total / total.sum()), np.log(table / table.sum(axis=0)).astype(np.float32))


def log_likelihoods(model: Model, texts: list[str]) -> np.ndarray:
    """Texts by languages."""
    out = np.tile(model.prior, (len(texts), 1))
    for rows, parts in blocks(texts):
        for buckets, starts, ends in _grams(parts):
            borders = np.column_stack((starts, ends)).ravel()
            np.add.at(out, rows, np.add.reduceat(model.table[buckets].astype(np.float64), borders, axis=0)[::2])
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text and any other columns) with lang_pred and score."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.prior, model.table))

    def of(texts: pa.Array) -> pa.Array:
        own = Model(*shared.value)
        values = texts.to_pylist()
        names, scores = [UNDETERMINED] * len(values), [0.0] * len(values)
        lettered = [k for k, t in enumerate(values) if t is not None and own.languages and any(map(str.isalpha, t))]
        if lettered:
            likely = log_likelihoods(own, [values[k] for k in lettered])
            likely -= likely.max(axis=1, keepdims=True)
            chance = np.exp(likely)
            chance /= chance.sum(axis=1, keepdims=True)
            for k, best, value in zip(lettered, chance.argmax(axis=1).tolist(), chance.max(axis=1).tolist(), strict=True):
                names[k], scores[k] = own.languages[best], value
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    udf = F.arrow_udf(of, "struct<lang_pred:string,score:double>").asNondeterministic()
    return docs.withColumn("_found", udf("text")).select(*[F.col(c) for c in docs.columns], "_found.lang_pred", "_found.score")


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``, by a model learned from its open rows."""
    model = train(docs)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least LEAST_SCORE."""
    plain = docs.select([F.col(c) for c in docs.columns])
    model = train(docs)
    renamed = plain.withColumnsRenamed({c: f"_{c}" for c in ("lang_pred", "score") if c in plain.columns})
    found = predict(renamed, model).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return found.drop("lang_pred", "score").withColumnsRenamed({f"_{c}": c for c in ("lang_pred", "score") if c in plain.columns}).select(docs.columns)
