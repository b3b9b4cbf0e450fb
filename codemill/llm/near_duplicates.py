"""Problem 1: chunks that are near-copies of each other.

Method: every chunk gets a Hamming code of 128 one-bit MinHash components. Chunks are put into shards by MinHash bands, each
shard becomes a BK-tree (children keyed by the integer Hamming distance to their parent) and each member follows only the
edges within the radius. Candidates are then verified by the exact Jaccard similarity of their shingle sets.

Trees travel with their shard through the shuffle and are not broadcast from the driver, as their total size grows with the
data. Shards are counted first. One of more than BLOCK members is cut into blocks before it is shuffled; each pair of blocks is
one tree and one set of probes, in tasks of its own, so that no member and no link is lost in a hot shard.

For a pair at the threshold 0.6, 30 bands of three values miss with probability (1 - 0.6**3)**30 = 0.0007, and radius 46 of
128 bits (mean 25.6, deviation 4.5) misses fewer than 1 in 100,000.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemill.storage import staged

TOKEN = re.compile(r"[a-z0-9_]+")
MIN_TOKENS, WIDTH, THRESHOLD = 30, 3, 0.6
BANDS, ROWS, BITS, RADIUS = 30, 3, 128, 46
BLOCK = 1500
#: Members of one block of a class; pairs of blocks are expanded in tasks of their own.
SPREAD = 512

_rng = np.random.default_rng(20_240_117)
_MUL = _rng.integers(1, 2**63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BITS, dtype=np.uint64)
_BIT = _rng.integers(1, 2**63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str, hashes: dict) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of the runs of three tokens; None under 30 tokens."""
    tokens = TOKEN.findall(text.lower())
    if len(tokens) < MIN_TOKENS:
        return None
    h = np.array([hashes[t] for t in tokens], dtype=np.uint64)
    s = h[:-2] * _WORD[0]
    s ^= s >> np.uint64(29)
    s = (s + h[1:-1]) * _WORD[1]
    s ^= s >> np.uint64(31)
    s = (s + h[2:]) * _WORD[2]
    s ^= s >> np.uint64(30)
    return np.unique(s)


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the Hamming code as two 64-bit words."""
    low = (s[:, None] * _MUL + _ADD).min(axis=0)
    keys = low[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = ((keys ^ (keys >> np.uint64(32))) * _BAND).sum(axis=1, dtype=np.uint64)
    keys ^= keys >> np.uint64(31)
    bits = ((low * _BIT) >> np.uint64(63)).astype(np.uint8)
    return keys.view(np.int64), np.packbits(bits).view(">u8").astype(np.uint64).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = _Hashes()
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingles(text, hashes) if text and rec is not None else None
            if s is None:
                continue
            keys, code = sketch(s)
            for out, value in zip(rows, (rec, xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63, keys, int(code[0]), int(code[1]), s.view(np.int64))):
                out.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64())))],
            names=["rec_id", "class_key", "bands", "c0", "c1", "shingles"],
        )


class BKTree:
    """Each node holds a code, the ids under it, and its children by their distance to it."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, code: int, item: int) -> None:
        if self.root is None:
            self.root = [code, [item], {}]
            return
        node = self.root
        while d := (node[0] ^ code).bit_count():
            child = node[2].get(d)
            if child is None:
                node[2][d] = [code, [item], {}]
                return
            node = child
        node[1].append(item)

    def within(self, code: int, radius: int) -> list[int]:
        found: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ code).bit_count()
            if d <= radius:
                found += node[1]
            stack += [child for edge, child in node[2].items() if d - radius <= edge <= d + radius]
        return found


def _codes(c0: np.ndarray, c1: np.ndarray) -> list[int]:
    return [(int(a) << 64) | int(b) for a, b in zip(c0.view(np.uint64), c1.view(np.uint64))]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, rec, c0, c1) sorted by shard in, candidate pairs a, b out. No shard here has more than BLOCK rows."""
    held = np.empty((0, 4), np.int64)

    def solve(part: np.ndarray) -> pa.RecordBatch:
        key = part[:, 0]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        pairs: set[tuple[int, int]] = set()
        for at, n in zip(starts[sizes > 1], sizes[sizes > 1]):
            rows = part[at : at + n]
            tree = BKTree()
            for rec, code in zip(rows[:, 1].tolist(), _codes(rows[:, 2].copy(), rows[:, 3].copy())):
                pairs.update((min(rec, x), max(rec, x)) for x in tree.within(code, RADIUS) if x != rec)
                tree.add(code, rec)
        flat = np.array(list(pairs), np.int64).reshape(len(pairs), 2)
        return pa.RecordBatch.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        whole = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
        if not len(whole):
            continue
        cut = int(np.searchsorted(whole[:, 0], whole[-1, 0]))  # the last shard may go on
        held = whole[cut:]
        if cut:
            yield solve(whole[:cut])
    if len(held):
        yield solve(held)


def _blocks(key: tuple, part: pa.Table) -> pa.Table:
    """One pair of blocks of a hot shard: a tree of the left block, probed by the right one."""
    side, rec = part.column("side").to_numpy(), part.column("rec").to_numpy()
    codes = _codes(part.column("c0").to_numpy().copy(), part.column("c1").to_numpy().copy())
    tree, pairs = BKTree(), set()
    left = [(int(r), c) for r, c, s in zip(rec, codes, side) if s == 0]
    for r, c in left:
        if key[1].as_py() == key[2].as_py():
            pairs |= {(min(r, x), max(r, x)) for x in tree.within(c, RADIUS) if x != r}
        tree.add(c, r)
    for r, c, s in zip(rec, codes, side):
        if s == 1:
            pairs |= {(min(int(r), x), max(int(r), x)) for x in tree.within(c, RADIUS) if x != r}
    flat = np.array(list(pairs), np.int64).reshape(len(pairs), 2)
    return pa.table({"a": flat[:, 0].copy(), "b": flat[:, 1].copy()})


def classes_and_links(chunks: DataFrame, rec_id: str = "rec_id", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(members, links). members: rec_id, rep - rep is the smallest rec_id with the same set of shingles. links: a, b,
    similarity - pairs of representatives whose sets share at least 0.6 of their union.

    Null or short texts (under 30 tokens) have no row. Rows that repeat a rec_id count once. Other columns are ignored, so
    their names cannot clash. An empty table gives two empty results."""
    source = chunks.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(content).alias("content"))
    features = staged(
        source.mapInArrow(_features, "rec_id long, class_key long, bands array<long>, c0 long, c1 long, shingles array<long>"), "near-duplicates"
    )
    first = features.groupBy("class_key").agg(F.min("rec_id").alias("rep"))
    members = features.select("rec_id", "class_key").distinct().join(first, "class_key").select("rec_id", "rep")
    reps = staged(features.groupBy("class_key").agg(F.min_by(F.struct("rec_id", "bands", "c0", "c1"), "rec_id").alias("r")).select("r.*"), "near-duplicate-codes")
    postings = reps.select(F.explode("bands").alias("shard"), F.col("rec_id").alias("rec"), "c0", "c1")
    # shards are counted before anything is brought together by shard: hot ones never reach a task as a whole
    per = staged(postings.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("shard", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("n_blocks")), "near-duplicate-hot")
    found = postings.join(per.select("shard"), "shard", "left_anti").repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards, "a long, b long")
    hot = postings
    placed = hot.join(per, "shard").withColumn("block", F.pmod(F.xxhash64("rec"), F.col("n_blocks")).cast("int"))
    sides = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    sides = sides.select(
        "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "rec", "c0", "c1"
    )
    more = sides.groupBy("shard", "i", "j").applyInArrow(_blocks, "a long, b long")
    pairs = staged(found.union(more).distinct(), "near-duplicate-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rec_id")).distinct()
    sets = features.select("rec_id", "shingles").join(wanted, "rec_id", "left_semi").dropDuplicates(["rec_id"])
    left, right = sets.select(F.col("rec_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rec_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("similarity", both / (F.size("sa") + F.size("sb") - both))
        .where(F.col("similarity") >= THRESHOLD)
        .select("a", "b", "similarity")
    )
    return members, links


def _blocked(members: DataFrame) -> DataFrame:
    """rep, block, recs: the members of each class in blocks of about SPREAD."""
    size = members.groupBy("rep").agg(F.ceil(F.count("*") / F.lit(SPREAD)).cast("int").alias("n"))
    placed = members.join(size, "rep").select("rep", F.pmod(F.xxhash64("rec_id"), F.col("n")).cast("int").alias("block"), "rec_id")
    return placed.groupBy("rep", "block").agg(F.collect_list("rec_id").alias("recs"))


def near_duplicate_pairs(chunks: DataFrame) -> DataFrame:
    """rec_a < rec_b of all near-copies: every pair within a class of equal sets, whatever its size, and every pair of members
    of two linked classes. Large classes are cut into blocks, and each pair of blocks is expanded for itself."""
    members, links = classes_and_links(chunks)
    blocks = staged(_blocked(staged(members, "near-duplicate-members")), "near-duplicate-blocks")
    count = blocks.groupBy("rep").agg(F.count("*").alias("blocks"), F.sum(F.size("recs")).alias("n"))
    left, right = blocks.select(F.col("rep").alias("a"), F.col("block").alias("i"), F.col("recs").alias("xs")), blocks.select(F.col("rep").alias("b"), F.col("block").alias("j"), F.col("recs").alias("ys"))
    own = count.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    sides = own.union(links.select("a", "b")).join(left, "a").join(right, "b").where("a <> b or i <= j")
    spread = sides.repartition("a", "b", "i", "j")
    pairs = spread.select(F.explode("xs").alias("x"), "a", "b", "i", "j", "ys").select("x", F.explode("ys").alias("y"), "a", "b", "i", "j")
    # within one block each pair stands twice; elsewhere no pair can, as classes and blocks share no member
    return pairs.where("a <> b or i <> j or x < y").select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))


def near_duplicate_groups(chunks: DataFrame) -> DataFrame:
    """rec_id, group_id, links: the connected group of each chunk (its smallest rec_id) and its number of links to other texts."""
    from codemill.operators.graph import connected_components

    members, links = classes_and_links(chunks)
    members, links = staged(members, "near-duplicate-members"), staged(links, "near-duplicate-links")
    part = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        members.join(part.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(degree, "rep", "left")
        .select("rec_id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
