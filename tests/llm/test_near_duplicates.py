"""Problem 1: every pair of a large class, and of a class and its near-copies."""

from codemill.llm.near_duplicates import near_duplicate_pairs


def test_large_class_keeps_all_pairs(spark):
    words = [f"word{i}" for i in range(60)]
    base = " ".join(words)
    rows = [(i, base.upper() if i % 2 else base + " ." * i) for i in range(1, 604)]
    near = [(1000 + i, " ".join([*words[:50], f"end{i}", *words[51:]])) for i in range(3)]
    other = [(2000, " ".join(f"other{i}" for i in range(60)))]
    found = [(r.rec_a, r.rec_b) for r in near_duplicate_pairs(spark.createDataFrame(rows + near + other + rows[:5], "rec_id long, content string")).collect()]
    ids = [r for r, _ in rows + near]
    wanted = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]}
    assert len(found) == len(set(found)) and set(found) == wanted
