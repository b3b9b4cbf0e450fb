"""Problem 1: a shard that most chunks share, against brute force."""

import random
import re

from codemill.llm import near_duplicates


def brute(texts):
    sets = {}
    for i, t in texts.items():
        k = re.findall(r"[a-z0-9_]+", t.lower())
        if len(k) >= 30:
            sets[i] = {tuple(k[j : j + 3]) for j in range(len(k) - 2)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_hot_shards_in_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    rng = random.Random(6)
    head = " ".join(f"licence{i}" for i in range(60))
    texts = {i: head + " " + " ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(5, 60))) for i in range(90)}
    texts |= {100 + i: texts[i] + f" x{i} y{i}" for i in range(10)} | {200: "short text", 201: ""}
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(1, texts[1]), (300, None)], "rec_id long, content string")
    got = [(r.rec_a, r.rec_b) for r in near_duplicates.near_duplicate_pairs(rows).collect()]
    want = brute(texts)
    assert len(got) == len(set(got)) and len(want) > 100
    # by the formula of the bands a pair at the threshold is missed with probability 0.0007
    assert set(got) <= want and len(want - set(got)) <= 0.005 * len(want)
