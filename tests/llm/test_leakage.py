"""Problem 9: every run of an item is looked up, by both ways of joining."""

import pytest

from codemill.llm import leakage


@pytest.mark.parametrize("sent_rows", [200_000, 1])
def test_every_run_of_an_item_is_found(spark, sent_rows):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, "x " + " ".join(words[i : i + 8]).upper() + " y") for i in range(33)] + [(99, " ".join(words[:7])), (100, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short one")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked(docs, items, sent_rows).collect()} == {(i, 1) for i in range(33)}


def test_items_hold_their_runs_only():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(f"w{i}" for i in range(20))])], names=["item_id", "text"])
    (out,) = leakage._item_runs(iter([batch]))
    assert out.schema.names == ["item_id", "value", "run"] and out.num_rows == 13


def test_both_ways_give_the_same_pairs_on_odd_texts(spark):
    from codemill.llm.leakage import leaked

    run = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, f"x {run.upper()} y", 0), (2, "alpha-beta, gamma. delta_epsilon zeta eta theta!", 0), (3, "alpha beta gamma", 0), (4, None, 0), (5, "", 0), (6, run, 0), (6, run, 0), (None, run, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, f"{run} iota"), (10, f"{run} iota"), (11, "seven words only one two three four"), (12, None), (None, run)], "item_id long, text string")
    for sent in (200_000, 0):
        got = leaked(docs, items, sent)
        assert got.columns == ["doc_id", "item_id"] and sorted(map(tuple, got.collect())) == [(1, 10), (2, 10), (6, 10)]
        assert leaked(docs.limit(0), items, sent).count() == 0 and leaked(docs, items.limit(0), sent).count() == 0
