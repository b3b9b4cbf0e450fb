"""Problem 8 against the tokenizer itself, and back."""

import tiktoken

from codemill.llm import tokenizing

TEXTS = ["Hello world  hello\n\n", "", None, "<|endoftext|> naïve 漢字🙂\x00", "a" * 5000, " " * 300, "don't x1y22", "same", "same"]


def test_ids_equal_the_tokenizers_and_decode(spark):
    own = tiktoken.Encoding("t", pat_str=tokenizing.PATTERN, mergeable_ranks=tokenizing.ranks(tokenizing.VOCABULARY), special_tokens={})
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    rows = tokenizing.encode(docs)
    got = {r.doc_id: r.ids for r in rows.collect()}
    assert got == {i: own.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in tokenizing.decode(rows).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_blocks_are_the_same_each_time_and_repeated_rows_stay(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "three")], "doc_id long, text string").coalesce(1)
    a, b = (sorted((r.doc_id, tuple(r.ids)) for r in tokenizing.encode(docs).collect()) for _ in range(2))
    assert a == b and len(a) == 3
    assert tokenizing.encode(docs.limit(0)).count() == 0
