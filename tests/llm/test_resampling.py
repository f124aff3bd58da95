"""The draw towards a target against a plain version of the same rules."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from gleaner.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, target, share=10, least=20, runs=1, buckets=10_000, seed="2024"):
    features = lambda t: [" ".join(ws[i : i + n]) for ws in [words(t)] for n in range(1, runs + 1) for i in range(len(ws) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, text in rows for f in features(text)) for rows in (docs, target))
    all_s, all_t = float(s.total()), float(t.total())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + buckets)) / ((s[b] + 1.0) * (all_t + buckets))))
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features(text))
        rows.append([i, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    ranked = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = ranked[: len(ranked) * share // 100]
    place = {id(r): i + 1 for i, r in enumerate(drawn)}
    return sorted(((*r[:4], place.get(id(r))) for r in rows), key=repr)


def made():
    base = "Ärger É\x0b naïve 中文字 A1b2 don't x_y under-score [the] THE the`end`".split(" ")
    texts = [None, "", "?!", " ".join(base) * 3, "word " * 19, "word " * 20, "Wİ KK " * 15, "z" * 200_000, "long text " * 20_000]
    texts += [" ".join(base[(i * j) % len(base)] + str(i % 7) for j in range(10 + i % 40)) for i in range(300)]
    rows = list(enumerate(texts)) + [(7, texts[20])] * 3 + [(None, texts[30]), (None, texts[40]), (5, "other " * 30)]
    return rows, [(1, "the end of don't 中文字 " * 9), (2, None), (3, texts[33])]


def got(frame):
    assert frame.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def frames(spark, docs, target):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS weight", "'x' AS place", "2 AS n_words")
    return docs, spark.createDataFrame(target, "item_id long, text string")


def ranks_apart(rows):
    """Rows that differ in nothing but the rank, by the set of their ranks: which of equal rows has which place is open."""
    held = {}
    for r in rows:
        held.setdefault(r[:4], []).append(r[4])
    return {k: sorted(v, key=repr) for k, v in held.items()}


def test_draw_equals_a_plain_version(spark):
    docs, target = made()
    assert ranks_apart(got(resampling.resample(*frames(spark, docs, target)))) == ranks_apart(brute(docs, target))


def test_longer_runs_fewer_buckets_other_shares(spark):
    docs, target = made()
    out = resampling.resample(*frames(spark, docs[:6] + docs[9:], target), share=35, least=15, runs=3, buckets=64, seed="s")
    assert ranks_apart(got(out)) == ranks_apart(brute(docs[:6] + docs[9:], target, 35, 15, 3, 64, "s"))


def test_empty_tables(spark):
    docs, target = made()
    assert got(resampling.resample(*frames(spark, [], target))) == []
    out = got(resampling.resample(*frames(spark, docs[:40], [])))
    assert ranks_apart(out) == ranks_apart(brute(docs[:40], []))
    none = spark.createDataFrame([], "text string")
    assert not resampling.bucket_counts(none).any()


def test_counts_do_not_depend_on_the_partitions(spark):
    docs, _ = made()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = [resampling.bucket_counts(df.repartition(n)) for n in (1, 9)]
    assert (held[0] == held[1]).all() and held[0].sum() == sum(len(words(t)) for _, t in docs)
    assert held[0].dtype == np.int64
