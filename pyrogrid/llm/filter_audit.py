"""Filter interaction audit: what each filter removes in every order, by contingency tensor contractions.

One pass over the documents tells which filters each one fails.  The counts of a part
(a language) over all combinations of failures are one tensor with an axis of length
two per filter: 2 x 2 x 2 x 2 x 2.  Every figure of every step of every order is then a
contraction of that tensor in which each axis is weighted with (1, 0) for "passes",
(0, 1) for "fails" or (1, 1) for "either"; einsum evaluates all 600 steps of a part at
once.  Only counts leave the first pass, so the work after it does not grow with texts.

The last filter, E, fails a text that equals the text of a smaller doc_id anywhere in
the table (SHA-256 of the bytes).  Copies are counted before the shuffle by text, part
and labels, so a group with a third of all rows is a few counts in one task.

Null texts count as empty, a null language is the part of the empty string, as is the
empty language.  A row without id is later than none and passes E; rows that repeat id
and text are counted each and none is smaller than another.  A document counts as good
or toxic if any row of labels with its id says 1; other labels and labels without id
play no part.  Other columns, whatever their names, are not looked at.  Without
documents there are no parts and no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid.llm.common import rows_of

LEAST_WORDS = 100
# In percent: distinct words of all words, capital letters of all code points.
LEAST_DISTINCT, MOST_CAPITALS = 80, 10
CAPITALS = re.compile(rb"[A-Z]+")
SYMBOLS = re.compile(rb"[#$%&*|]")
CONTINUATION = bytes(range(0x80, 0xC0))

Rule = Callable[[bytes, list[bytes]], bool]


def few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < LEAST_WORDS


def repeats_words(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < LEAST_DISTINCT * len(words)


def many_capitals(text: bytes, words: list[bytes]) -> bool:
    capitals = sum(m.end() - m.start() for m in CAPITALS.finditer(text))
    return 100 * capitals > MOST_CAPITALS * len(text.translate(None, CONTINUATION))


def has_symbols(text: bytes, words: list[bytes]) -> bool:
    return SYMBOLS.search(text) is not None


# Filters by letter; the copy filter COPIES comes after them.
RULES: dict[str, Rule] = {"A": few_words, "B": repeats_words, "C": many_capitals, "D": has_symbols}
COPIES = "E"

PASS, FAIL, EITHER = (1, 0), (0, 1), (1, 1)
MEASURES = ("n", "good", "toxic")
# Parts contracted at once: their intermediate tensors stay within some 10 MB.
PARTS_AT_ONCE = 32


def failures(docs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """(doc_id, part, cell, digest) of (doc_id, text, lang): one bit of ``cell`` per failed rule, the first rule highest."""
    checks = tuple(rules.values())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            cells = []
            for text in texts:
                words, cell = text.split(), 0  # bytes: the white space of ASCII
                for check in checks:
                    cell = 2 * cell + check(text, words)
                cells.append(cell)
            digests = [hashlib.sha256(t).digest() for t in texts]
            columns = [batch.column(0), batch.column(2), pa.array(cells, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "part", "cell", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(of, "doc_id long, part string, cell int, digest binary")


def contingency(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """(part, cell, n, good, toxic): documents per combination of failures, the copy filter in the lowest bit."""
    each = failures(docs, rules).groupBy("doc_id", "part", "cell", "digest").agg(F.count(F.lit(1)).alias("m"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    )
    marked = each.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # Of the rows of one text, those with the smallest id pass; ids are unique within a group here.
    with_id = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "m"))
    texts = marked.groupBy("digest", "part", "cell", "good", "toxic").agg(
        F.sum("m").alias("all"), F.sum(F.when(F.col("doc_id").isNull(), F.col("m")).otherwise(0)).alias("nameless"), F.min(with_id).alias("first")
    )
    lowest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    first = F.when(F.col("first.doc_id") == lowest, F.col("first.m")).otherwise(0)
    split = texts.withColumn("passing", F.col("nameless") + first)
    cells = F.array(
        F.struct((F.col("cell") * 2).alias("cell"), F.col("passing").alias("n")),
        F.struct((F.col("cell") * 2 + 1).alias("cell"), (F.col("all") - F.col("passing")).alias("n")),
    )
    counted = split.select("part", "good", "toxic", F.explode(cells).alias("of")).select("part", "of.*", "good", "toxic").filter("n > 0")
    sums = [F.sum("n").alias("n")] + [F.sum(F.col("n") * F.col(c)).alias(c) for c in MEASURES[1:]]
    return counted.groupBy("part", "cell").agg(*sums)


def selections(letters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All (order, step) and, per figure, the weights of each axis at each of them: (steps, filters, 2)."""
    steps, chosen = [], {"kept": [], "removed": [], "failing": [], "only": []}
    for order in permutations(letters):
        for step, own in enumerate(order, 1):
            steps.append(("".join(order), step))
            before = set(order[: step - 1])
            chosen["kept"].append([PASS if f in before or f == own else EITHER for f in letters])
            chosen["removed"].append([PASS if f in before else FAIL if f == own else EITHER for f in letters])
            chosen["failing"].append([FAIL if f == own else EITHER for f in letters])
            chosen["only"].append([FAIL if f == own else PASS for f in letters])
    return steps, {name: np.array(weights, dtype=np.int64) for name, weights in chosen.items()}


def contract(tensors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(..., steps): ``tensors`` (..., 2, ..., 2) weighted along each of its filter axes by ``weights`` (steps, filters, 2)."""
    filters = weights.shape[1]
    axes = list(range(1, filters + 1))
    operands: list = [tensors, [..., *axes]]
    for axis in axes:
        operands += [weights[:, axis - 1, :], [0, axis]]
    return np.einsum(*operands, [..., 0], optimize=True)


def figures(tensors: np.ndarray, letters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The steps, and each figure as an array (parts, steps), of ``tensors`` (parts, measures, 2, ..., 2)."""
    steps, weights = selections(letters)
    kept, failing, only = (contract(tensors[:, 0], weights[name]) for name in ("kept", "failing", "only"))
    removed = contract(tensors, weights["removed"])
    own = np.array([order[step - 1] for order, step in steps])
    shapley = np.zeros_like(kept)
    for letter in letters:
        shapley[:, own == letter] = removed[:, 0, own == letter].sum(axis=1, keepdims=True)
    return steps, {
        "kept": kept, "removed": removed[:, 0], "redundant": failing - removed[:, 0], "unique_fails": only,
        "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": shapley,
    }


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, figures) of ``counts`` (part, cell, n, good, toxic): every order, every step."""
    shape = (2,) * len(letters)
    entries = F.collect_list(F.struct("cell", *MEASURES)).alias("entries")  # at most one per cell

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                parts, tables = some.column(0).to_pylist(), some.column(1).to_pylist()
                tensors = np.zeros((len(parts), len(MEASURES), 2 ** len(letters)), dtype=np.int64)
                for row, table in enumerate(tables):
                    for entry in table:
                        tensors[row, :, entry["cell"]] = [entry[m] for m in MEASURES]
                steps, found = figures(tensors.reshape(len(parts), len(MEASURES), *shape), letters)
                columns = [
                    pa.array([p for p in parts for _ in steps], pa.string()), pa.array([o for o, _ in steps] * len(parts), pa.string()),
                    pa.array([s for _, s in steps] * len(parts), pa.int32()), *[pa.array(found[name].ravel(), pa.int64()) for name in FIGURES],
                ]
                yield pa.record_batch(columns, names=["part", "filter_order", "step", *FIGURES])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in FIGURES)
    return counts.groupBy("part").agg(entries).mapInArrow(of, schema)


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row per part, order of the filters and step.  ``shapley`` is what the step's
    filter removes, summed over all orders; divided by their number it is its share.
    """
    letters = "".join(rules) + COPIES
    assert all(len(letter) == 1 for letter in letters) and factorial(len(letters)) <= 720
    return interactions(contingency(docs, labels, rules), letters)


def audit_sql() -> str:
    """The same rows for the five filters, by plain counting."""
    space = r"[^\x20\x09-\x0D]+"
    return rf"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents
        ), w AS (
            SELECT *, regexp_extract_all(t, '{space}') AS words FROM t
        ), m AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
        ), d AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                (len(words) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words))::INT
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t))::INT
                + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS cell
            FROM w LEFT JOIN m USING (doc_id)
        ), c AS (
            SELECT part, cell, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, cell
        ), f AS (
            SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)
        ), o AS (
            SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
            FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31
        ), s AS (
            SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
            FROM o, range(1, 6) r(step)
        ), a AS (
            SELECT part, filter_order, step, own,
                coalesce(sum(n) FILTER (cell & (before | own) = 0), 0)::BIGINT AS kept,
                coalesce(sum(n) FILTER (cell & before = 0 AND cell & own <> 0), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (cell & before <> 0 AND cell & own <> 0), 0)::BIGINT AS redundant,
                coalesce(sum(n) FILTER (cell = own), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (cell & before = 0 AND cell & own <> 0), 0)::BIGINT AS good_lost,
                coalesce(sum(toxic) FILTER (cell & before = 0 AND cell & own <> 0), 0)::BIGINT AS toxic_lost
            FROM c, s GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
        FROM a
    """
