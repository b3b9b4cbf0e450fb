"""The registered queries over training data against their SQL, and the pipeline."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from codemill.llm.queries import SQL

DATA = "/root/testdata"


def test_every_written_operator_is_registered():
    assert set(entry.queries()) >= {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_ids", "p9_found", "p10_found"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("code_records", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
    found = entry.queries()[name](spark, f"{DATA}/sf0.01")
    wanted = con.execute(entry.oracle_sql()[name])
    assert found.columns == [c[0] for c in wanted.description]
    assert Counter(map(tuple, found.collect())) == Counter(wanted.fetchall())


@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p4_rates", "p6_found", "p7_found", "p8_ids", "p10_rates"])
def test_query_without_sql_gives_rows(spark, name):
    # sf0.001 has no file that does not parse
    rows = entry.queries()[name](spark, f"{DATA}/{'sf0.01' if name == 'p4_found' else 'sf0.001'}").collect()
    assert rows and len(rows) == len(set(map(str, rows)))


def test_pipeline_keeps_every_clean_document(spark):
    d = f"{DATA}/sf0.001"
    documents = rows = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, d)
    dirty = {r.doc_id for r in entry.queries()["p9_found"](spark, d).collect()}
    wanted = {r.doc_id for r in documents.collect() if r.text and r.text.strip()} - dirty
    assert {r.doc_id for r in rows.collect() if r.ids} == wanted
