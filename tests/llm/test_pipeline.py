import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from pyrogrid.llm import queries
from pyrogrid.llm.common import prepared
from tests.llm.test_dedup import naive_similar
from pyrogrid.session import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and what each stage made of them."""
    docs = prepared(spark).read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_columns_and_order_of_stages(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "private_data", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_dedup_stages_equal_brute_force(steps):
    before = rows(steps[1])
    last = {}
    for i, r in before.items():
        last[(r["text"] or "").encode().lower()] = max(i, last.get((r["text"] or "").encode().lower(), i))
    assert rows(steps[2]) == {i: before[i] for i in last.values()}
    kept = rows(steps[2])
    assert rows(steps[3]) == {i: kept[i] for i in naive_similar([(i, r["text"]) for i, r in kept.items()])}


def test_private_stage_changes_only_documents_with_entities(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert before.keys() == after.keys()
    changed = {i for i in before if before[i]["text"] != after[i]["text"]}
    private = re.compile(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|AKIA[0-9A-Z]{16}|password=\w+|\b\d{1,3}(?:\.\d{1,3}){3}\b")
    assert {i for i in before if private.search(before[i]["text"])} <= changed
    for i in before:
        assert not set(private.findall(before[i]["text"])) & set(private.findall(after[i]["text"]))
        if not re.search(r"[@\d=]", before[i]["text"]):
            assert i not in changed


def test_language_stage_keeps_clean_documents(steps):
    assert len(rows(steps[1])) >= 0.97 * len(rows(steps[0]))


def test_packing_stage_holds_every_document(spark, steps):
    packed = steps[5]
    assert {r.doc_id for r in packed.collect()} == set(rows(steps[4]))
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.filter("n <> end or n > 4096").isEmpty()


def test_run_gives_the_stages_result(spark, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    again = corpus_pipeline.run(spark, SF).select(columns).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, steps[5].select(columns).collect()))


def test_registration():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and "pipeline" in queries.QUERIES
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14)] == [1] * 13
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    found = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    columns = ", ".join(sorted(found.columns))
    want = sorted(con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall())
    got = sorted(tuple(r) for r in found.select(sorted(found.columns)).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True))
