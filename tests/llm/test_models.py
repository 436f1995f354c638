import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyrogrid.llm import language_id, ngrams, quality
from pyrogrid.llm.common import held_out, prepared

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return prepared(spark).read.parquet(f"{SF}/documents.parquet")


def test_held_out_rows(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("out")).collect()
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_layout_and_gram_hashes():
    points, starts, ends = ngrams.layout(["abc", "", "cab"])
    assert "".join(map(chr, points)) == " abc" + " " * 3 + " " + " " * 3 + " cab" + " " * 4
    assert starts.tolist() == [0, 7, 11] and ends.tolist() == [5, 9, 16]
    two = ngrams.gram_hashes(points, 2)
    assert two[1] == two[13] and two[1] != two[2]
    assert len(ngrams.gram_hashes(points[:1], 2)) == 0


def test_long_texts_are_taken_in_blocks_without_loss():
    text = "word " * 1000 + "x" * 700
    parts = [(n.tolist(), p) for n, p in ngrams.blocks(["a", text, "", "b"], chars=300)]
    assert "".join(t for numbers, own in parts for n, t in zip(numbers, own, strict=True) if n == 1) == text
    assert {n for numbers, _ in parts for n in numbers} == {0, 1, 2, 3} and all(sum(map(len, own)) <= 700 for _, own in parts)


def test_language_on_held_out_rows(spark, docs):
    rows = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "der die das und nicht " * 20_000), (5, "ñ"), (5, "ñ"), (None, "the of and")]
    odd = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, lang_pred string, score string, source int")
    found = language_id.predict(odd.drop("lang_pred", "score"), language_id.train(docs)).collect()
    got = {(r.doc_id, r.lang_pred) for r in found}
    assert len(found) == len(rows) and {(1, "und"), (2, "und"), (3, "und"), (4, "de")} <= got
    none = language_id.languages(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert language_id.languages(docs.limit(0)).count() == 0


def test_language_stage_keeps_columns_and_clear_documents(spark, docs):
    extra = docs.withColumns({"score": F.lit("own"), "lang_pred": F.lit(1)})
    kept = language_id.keep_identified(extra.unionByName(spark.createDataFrame([(-1, "12 34", None, "s", 5, "own", 1)], extra.schema)))
    assert kept.columns == extra.columns and kept.filter("doc_id = -1").isEmpty() and kept.filter("score <> 'own'").isEmpty()
    assert kept.count() > 0.97 * docs.count()


def test_language_scores_equal_a_plain_sum(spark, docs):
    model = language_id.train(docs)
    text = "Der Satz ist kurz."
    want = model.prior.copy()
    points = np.array([ord(c) for c in f" {text.lower()}    "], dtype=np.uint64)
    for n in language_id.SIZES:
        for k in range(len(text) + 2):
            want += model.table[ngrams.scramble(ngrams.gram_hashes(points[k : k + n], n), language_id.BUCKETS)[0]]
    assert np.allclose(language_id.log_likelihoods(model, [text])[0], want)
    assert np.allclose(language_id.log_likelihoods(model, ["other text", text, ""])[1], want)


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.rated(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 60 and np.mean([r.predicted == r.quality for r in out]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_edges(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "spam " * 300_000), (4, "same"), (4, "same")], "doc_id long, text string")
    found = quality.score(odd, model).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id in (1, 2)} == {found[0].score}
    assert len({r.score for r in found if r.text == "same"}) == 1
    assert next(r.score for r in found if (r.text or "").startswith("spam")) < 0.5
    none = quality.rated(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.rated(docs.limit(0), labels).count() == 0


def test_a_score_does_not_depend_on_the_batch(docs):
    texts = [r.text for r in docs.limit(40).collect()]
    draw = np.random.Generator(np.random.PCG64(1))
    model = quality.Model(draw.normal(size=quality.BUCKETS), 0.1)
    together = quality.scores_of(model, texts)
    assert np.allclose(together, [quality.scores_of(model, [t])[0] for t in texts])
