"""The curated set against a sequential builder."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import curate

#: The last topic has a question of another; only topics without quotas may share one.
VARIANTS = {"a": ["a1", "a2", "a3"], "b": ["b1"], "c": ["c1", "c3", "c4"], "z": ["z1", "b1"]}
GENERIC = ["g1", "g2", "a3"]


def sequential(snippets, quotas, target):
    out, used, counts = [], set(), dict.fromkeys(quotas, 0)

    def add(s, topic, question, turn):
        if len(out) < target and (s, question) not in used:
            used.add((s, question))
            out.append((len(out) + 1, turn, s, topic, question))
            return True
        return False

    for topic, most in quotas.items():
        for s, topics in snippets:
            for q in VARIANTS[topic]:
                if topic in topics and counts[topic] < most:
                    counts[topic] += add(s, topic, q, 1)
    deferred = []
    for s, topics in snippets:
        pairs = [(t, q) for t in (topics or ["z"])[:3] for q in VARIANTS[t]]
        for t, q in [*pairs[:2], ("general", GENERIC[0])]:
            add(s, t, q, 2)
        deferred += [(s, t, q) for t, q in [*pairs[2:], *[("general", g) for g in GENERIC[1:]]]]
    for s, t, q in deferred:
        add(s, t, q, 3)
    return out


@pytest.mark.parametrize("target", [0, 5, 40, 300, 5000])
def test_rounds_equal_the_sequential_builder(spark, target):
    rng = random.Random(target)
    snippets = [(s, [t for t in "abcz" if rng.random() < 0.4]) for s in range(1, 120)]
    quotas = {"c": 17, "a": 500, "b": 3} if target != 300 else {"b": 40, "a": 10}
    frame = spark.createDataFrame(snippets, "s long, topics array<string>").repartition(5)
    got = sorted(tuple(r) for r in curate.curated(frame, VARIANTS, GENERIC, quotas, target, "z").collect())
    assert got == sequential(snippets, quotas, target)


def test_counterexamples_equal_the_search(spark, monkeypatch):
    monkeypatch.setattr(curate, "STRETCH", 7)
    rng = random.Random(8)
    evidence = ["".join(rng.choices("pqr", k=rng.choice([1, 2, 6]))) for _ in range(60)] + ["pqr"] * 30 + ["pq"] * 5
    questions = ["p", "q", "r", ""]
    frame = spark.createDataFrame(list(enumerate(evidence, 1)), "position long, evidence string").repartition(4)
    out = curate.counterexamples(frame, len(evidence), questions, lambda q, e: e.contains(q), 80)
    want = set()
    for idx in range(80):
        q = questions[idx % 4]
        for offset in range(len(evidence)):
            at = len(evidence) - (idx + offset) % len(evidence)
            if q not in evidence[at - 1]:
                want.add((idx, q, at))
                break
    assert {tuple(r) for r in out.collect()} == want


def test_topics_are_words(spark):
    row = spark.createDataFrame([("Fire, and WATER-damage",), ("fires",), (None,)], "t string").select(curate.matched_topics(F.col("t"), {"w": ["water"], "f": ["fire", "heat"]}).alias("m")).collect()
    assert [r.m for r in row] == [["w", "f"], [], []]
