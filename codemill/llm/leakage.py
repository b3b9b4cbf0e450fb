"""Problem 9: evaluation passages that stand in training texts.

Method: exact look-up of shared runs. The shingles are runs of eight words, and one shared shingle is a case already, so a
MinHash sketch that loses none must keep all of an item's shingles. All hashes of an item are kept, without partitions by
size; those of the documents are looked up in them, and every hit is verified by comparing the eight words themselves.

Items are a small fixed set; their hashes are broadcast only up to SENT_ROWS shingles and SENT_BYTES and joined by a shuffle
beyond that. There a run of boilerplate that many documents share makes a skewed partition of the documents' side, which
adaptive execution may split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
RUN = 8
#: Shingles, and bytes of their words, up to which the items are broadcast. Both ways give the same pairs.
SENT_ROWS, SENT_BYTES = 200_000, 64 << 20
_MIX = np.random.default_rng(9).integers(1, 2**63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def run_hashes(tokens: list[str], hashes: dict) -> np.ndarray:
    """A 64-bit value of every run of eight words, in order."""
    if len(tokens) < RUN:
        return np.empty(0, np.uint64)
    h = np.array([hashes[t] for t in tokens], np.uint64)
    n = len(h) - RUN + 1
    out = np.zeros(n, np.uint64)
    for i in range(RUN):
        out += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29))) * _MIX[i]
    return out ^ (out >> np.uint64(32))


def _item_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, rows = _Hashes(), []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = words(text) if text else []
            values = run_hashes(tokens, hashes)
            if len(values):
                low, at = np.unique(values, return_index=True)
                rows += [(item, v, " ".join(tokens[i : i + RUN])) for v, i in zip(low.view(np.int64).tolist(), at.tolist())]
        yield _batch(rows, ["item_id", "value", "run"], [pa.int64(), pa.int64(), pa.string()])


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


def _probe(sketches: tuple[np.ndarray, list[tuple[int, str]], np.ndarray]):
    """Documents against the sent sketches."""
    values, owners, starts = sketches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = _Hashes(), []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words(text) if text else []
                got = run_hashes(tokens, hashes)
                if not len(got):
                    continue
                at = np.searchsorted(values, got)
                at[at == len(values)] = 0
                hits = np.flatnonzero(values[at] == got)
                found = set()
                for h in hits.tolist():
                    run_text = " ".join(tokens[h : h + RUN])
                    for item, own in owners[starts[at[h]] : starts[at[h] + 1]]:
                        if own == run_text:
                            found.add(item)
                rows += [(doc, item) for item in sorted(found)]
            yield _batch(rows, ["doc_id", "item_id"], [pa.int64(), pa.int64()])

    return run


def _document_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, rows = _Hashes(), []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = words(text) if text else []
            low, at = np.unique(run_hashes(tokens, hashes), return_index=True)
            rows += [(doc, v, " ".join(tokens[i : i + RUN])) for v, i in zip(low.view(np.int64).tolist(), at.tolist())]
        yield _batch(rows, ["doc_id", "value", "run"], [pa.int64(), pa.int64(), pa.string()])


def leaked(documents: DataFrame, items: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, item_id: documents and items that have a run of at least eight consecutive words in common.

    Null, empty and shorter texts have no rows; repeated rows count once; other columns are ignored."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    sketches = tests.mapInArrow(_item_runs, "item_id long, value long, run string")
    size = sketches.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("run")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= sent_rows and size["bytes"] <= SENT_BYTES:
        head = sketches.toArrow()
        value = head.column("value").to_numpy().view(np.uint64)
        order = np.argsort(value, kind="stable")
        distinct, starts = np.unique(value[order], return_index=True)
        if not len(distinct):
            return docs.select("doc_id", F.lit(0).cast("long").alias("item_id")).where("false")
        item, run = head.column("item_id").to_pylist(), head.column("run").to_pylist()
        owners = [(item[i], run[i]) for i in order]
        sent = documents.sparkSession.sparkContext.broadcast((distinct, owners, np.r_[starts, len(value)]))
        found = docs.mapInArrow(lambda it: _probe(sent.value)(it), "doc_id long, item_id long")
    else:
        found = docs.mapInArrow(_document_values, "doc_id long, value long, run string").join(sketches, ["value", "run"]).select("doc_id", "item_id")
    return found.distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, documents: every item with the number of documents it stands in."""
    per = leaked(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"))
    own = items.select("item_id", "suite").dropDuplicates(["item_id"])
    return own.join(per, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))
