"""Every operator over chunks and documents on nulls in any column, odd texts, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from codemill.llm import documented, handwritten, leakage, near_duplicates, nearest_vectors, parsing, secrets, splitting, tokenizing, toxicity

CLASH = ("shard", "rec", "label", "n", "chunks", "text", "score", "field", "cell", "block", "word", "features", "notice", "valid", "value", "best", "figures", "run")


@pytest.fixture(scope="module")
def chunks(spark):
    """The table of sf0.001 with rows that have a null in one column each, repeated rows, a very long text, and more columns."""
    rows = spark.read.parquet("/root/testdata/sf0.001/code_records.parquet")
    some = rows.orderBy("rec_id").limit(1)
    odd = rows.limit(0)
    for i, c in enumerate(rows.columns):
        odd = odd.unionByName(some.withColumn("rec_id", F.lit(900_000 + i).cast("long")).withColumn(c, F.lit(None).cast(dict(rows.dtypes)[c])))
    long_ = some.withColumn("rec_id", F.lit(910_000).cast("long")).withColumn("filePath", F.lit("/srv/code/long/a.py")).withColumn("content", F.repeat(F.lit("x = 'abc' # word\n"), 20_000))
    empty = some.withColumn("rec_id", F.lit(910_001).cast("long")).withColumn("filePath", F.lit("/srv/code/empty/a.json")).withColumn("content", F.lit(""))
    whole = rows.unionByName(odd).unionByName(long_).unionByName(empty).unionByName(some)
    for c in CLASH:
        whole = whole.withColumn(c, F.lit(1))
    return whole.cache()


OPERATORS = {
    "p1": near_duplicates.near_duplicate_pairs, "p1_groups": near_duplicates.near_duplicate_groups, "p2": splitting.oversized, "p3": handwritten.scored_files, "p4": parsing.parsed_files, "p4_rates": parsing.error_rates,
    "p5": nearest_vectors.nearest_vectors, "p6": documented.documented_functions, "p7": secrets.secret_lines,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_chunks(chunks, name):
    rows = OPERATORS[name](chunks).collect()
    assert len(set(map(str, rows))) == len(rows)
    plain = OPERATORS[name](chunks.drop(*CLASH)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, plain))
    assert OPERATORS[name](chunks.limit(0)).collect() == []


def test_long_text_is_split_whole(chunks):
    assert splitting.split_oversized(chunks.where("rec_id = 910000")).count() > 200
    assert [r.rec_id for r in splitting.oversized(chunks).collect()].count(910_000) == 1


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = rows.where("text is not null").orderBy("doc_id").limit(1)
    odd = some.limit(0)
    for i, c in enumerate(rows.columns):
        odd = odd.unionByName(some.withColumn("doc_id", F.lit(900_000 + i).cast("long")).withColumn(c, F.lit(None).cast(dict(rows.dtypes)[c])))
    docs = rows.unionByName(odd).unionByName(some.withColumn("doc_id", F.lit(910_000).cast("long")).withColumn("text", F.repeat("text", 2000)))
    for c in ("ids", "item_id", "score", "spans", "toxic", "word", "block", "value"):
        docs = docs.withColumn(c, F.lit(1))
    items, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("eval_items", "doc_labels"))
    assert tokenizing.encode(docs).count() == docs.count()
    assert leakage.leaked(docs, items).count() > 0 and leakage.leaked(docs.limit(0), items).count() == 0
    scores = toxicity.scored(docs, labels)
    assert scores.count() == docs.where("doc_id is not null").count() and scores.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.rates(docs.limit(0), labels.limit(0)).count() == 0
