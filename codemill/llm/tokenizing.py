"""Problem 8: the corpus as ids of a public byte-level BPE.

Method: a global shuffle of distinct words. Texts are cut into pre-tokens with their positions; every distinct word of the
corpus is encoded once; ids are joined back and documents put together by position; decoding joins the table of token bytes.

To keep the shuffle small, words are made distinct within blocks of documents first: a block holds its documents as positions
in the block's own word list, and only (block, word number, word) rows are shuffled. A block is bounded by characters, and a
longer text is a block of its own. A word that stands in most blocks makes its partition of the join large; the join's result
goes to another shuffle, so adaptive execution is free to split such a partition on the side of the places.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemill.storage import staged

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 1_500_000


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = regex.compile(PATTERN).findall
    number: dict[str, int] = {}
    docs: list[int] = []
    sizes: list[int] = []
    codes: list[np.ndarray] = []
    held, emitted = 0, 0
    first = TaskContext.get().partitionId() << 32  # a task that runs again gives its blocks the same numbers

    def emit() -> pa.RecordBatch:
        nonlocal emitted
        block = first + emitted
        emitted += 1
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), one(docs, pa.int64()), one(sizes, pa.int32()), one(np.concatenate(codes) if codes else [], pa.int32()), one(list(number), pa.string())],
            names=["block", "docs", "sizes", "codes", "words"],
        )

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = cut(text) if text else []
            if docs and held + len(text or "") > BLOCK_CHARS:
                yield emit()
                number, docs, sizes, codes, held = {}, [], [], [], 0
            docs.append(doc)
            sizes.append(len(found))
            codes.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
            held += len(text or "")
    if docs:
        yield emit()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            flat = own.encode_ordinary_batch(words, num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            docs, sizes, codes, at, ids = (batch.column(i)[row].values for i in range(1, 6))
            own = ids.flatten() if ids is not None else pa.array([], pa.int32())
            length = np.diff(ids.offsets.to_numpy()) if ids is not None else np.empty(0, np.int64)
            own = own.to_numpy(zero_copy_only=False)
            order = np.argsort(at.to_numpy(zero_copy_only=False)) if at is not None else np.empty(0, np.int64)
            start = np.r_[0, np.cumsum(length)][:-1][order]  # by word number
            length = length[order]
            code = codes.to_numpy(zero_copy_only=False)
            n = length[code]
            total = np.r_[0, np.cumsum(n)]
            flat = own[np.repeat(start[code] - total[:-1], n) + np.arange(total[-1])] if len(code) else own[:0]
            ends = np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(flat.astype(np.int32)))], names=["doc_id", "ids"])


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every row of documents. A null and an empty text give an empty list; strings that look like special
    tokens are ordinary text. Repeated rows stay repeated; other columns are ignored."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = staged(source.mapInArrow(_blocks, "block long, docs array<long>, sizes array<int>, codes array<int>, words array<string>"), "token-blocks")
    places = blocks.select("block", F.posexplode("words").alias("at", "word"))
    known = places.select("word").distinct().mapInArrow(_encode(path), "word string, ids array<int>")
    back = places.join(known, "word").groupBy("block").agg(F.collect_list(F.struct("at", "ids")).alias("w"))
    whole = blocks.select("block", "docs", "sizes", "codes").join(back.select("block", F.col("w.at").alias("at"), F.col("w.ids").alias("ids")), "block", "left")
    return whole.mapInArrow(_assemble, "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """id, bytes: the vocabulary, of bounded size."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(path).items()], "id int, bytes binary")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text of rows doc_id, ids: a join with the token bytes, put together by position. doc_id must not repeat. An
    empty or null list gives an empty text."""
    spark = encoded.sparkSession
    spelled = encoded.select("doc_id", F.posexplode("ids").alias("at", "id")).join(F.broadcast(token_bytes(spark, path)), "id")
    texts = spelled.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("h")))).alias("p"))
    texts = texts.select("doc_id", F.decode(F.unhex(F.array_join("p.h", "")), "UTF-8").alias("text"))
    return encoded.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
