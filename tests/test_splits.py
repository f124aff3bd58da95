"""Splits by order against plain loops."""

import hashlib
from collections import Counter

import pytest

from gleaner.operators import sets


def order(seed, names):
    return sorted(names, key=lambda s: (hashlib.sha256(f"{seed}|{s}".encode()).hexdigest(), s))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1001])
def test_hash_and_document_splits(spark, n):
    names = [f"g{i}" for i in range(n)]
    frame = spark.createDataFrame([(s,) for s in names], "source string")
    want = order("a", names)
    got = {r.source: (r.place, r.split) for r in sets.hash_split(frame, "a").collect()}
    cut = round(n * 0.5), round(n * 0.75)
    assert got == {s: (i + 1, "train" if i < cut[0] else "valid" if i < cut[1] else "test") for i, s in enumerate(want)}
    counts = Counter(r.split for r in sets.document_split(frame, "a").collect())
    if n >= 3:
        assert min(counts[k] for k in ("train", "valid", "test")) >= 1 and counts.total() == n


def plain_cumulative(counts, seed, share, least, rest):
    total, taken, out = sum(counts.values()), 0, {}
    target = min(max(int(total * share), least), max(1, total - rest))
    names = order(seed, counts)
    for i, s in enumerate(names):
        if taken < target and i < len(names) - 1:
            out[s], taken = "valid", taken + counts[s]
        else:
            out[s] = "test"
    return out


@pytest.mark.parametrize("share, least", [(0.2, 40), (0.9, 1), (2.0, 5)])
def test_cumulative_split_equals_a_loop(spark, share, least):
    counts = {f"d{i}": (i * 7) % 23 for i in range(500)}
    got = sets.cumulative_split(spark.createDataFrame(list(counts.items()), "d string, n long").repartition(6), "v", "d", share, least)
    assert {r.d: r.split for r in got.collect()} == plain_cumulative(counts, "v", share, least, 10)
    few = {"a": 3, "b": 50}
    got = sets.cumulative_split(spark.createDataFrame(list(few.items()), "d string, n long"), "v", "d", share, least)
    assert {r.d: r.split for r in got.collect()} == plain_cumulative(few, "v", share, least, 10)
