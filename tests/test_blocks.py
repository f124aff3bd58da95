"""The block index against exhaustive scoring in plain Python."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gleaner.operators import blocks

TOKEN = re.compile("[a-z0-9$%]+")


def made(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=rng.choice([3, 20, 60]))) for _ in range(n)]
    texts[5:9] = [None, "", "...", texts[10]]
    texts[20] = "w7 " * 5000
    asked = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 30])))) for i in range(40)] + [(90, None), (91, "unknown"), (92, "w1 w1 w2")]
    return list(enumerate(texts)), asked


def exhaustive(docs, asked, k):
    bags = {i: Counter(TOKEN.findall((t or "").lower())) for i, t in docs}
    n, mean = len(bags), sum(b.total() for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}

    def vector(bag):
        v = Counter()
        for t, c in bag.items():
            v[blocks.bucket_of(t)] += c
        norm = math.sqrt(sum(c * c for c in v.values())) + 1e-10
        return {b: c / norm for b, c in v.items()}

    vectors, out = {i: vector(b) for i, b in bags.items()}, set()
    for q, text in asked:
        want = Counter(TOKEN.findall((text or "").lower()))
        qv = vector(want)
        sparse = {i: sum(c * idf[t] * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * b.total() / mean)) for t, c in want.items() if b[t]) for i, b in bags.items()}
        dense = {i: (round(1e9 * sum(x * v.get(b, 0) for b, x in qv.items())) + 500) // 1000 / 1e6 for i, v in vectors.items()}
        for channel, scores in (("sparse", {i: s for i, s in sparse.items() if s > 0}), ("dense", dense)):
            best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
            out |= {(q, channel, i, round(s, 6), place) for place, (i, s) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("size, most, k", [(16, 100, 7), (1024, 16384, 100), (50, 30, 1)])
def test_search_equals_exhaustive_scores(spark, monkeypatch, size, most, k):
    docs, asked = made()
    monkeypatch.setattr(blocks, "MOST_TERMS", most)
    packed = blocks._packed

    def small(kind):
        run = packed(kind)

        def step(frames):
            blocks.BLOCK = size
            yield from run(frames)

        return step

    monkeypatch.setattr(blocks, "_packed", small)
    monkeypatch.setattr(blocks, "BLOCK", size)
    index = blocks.BlockIndex.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    found = index.search(spark.createDataFrame(asked, "qid long, text string"), k)
    got = {(r.qid, r.channel, r.id, round(r.score, 6), r["rank"]) for r in found.collect()}
    assert got == exhaustive(docs, asked, k)


def test_bounds_hold_and_close_blocks(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices([f"{'abcd'[i // 300]}{j}" for j in range(50)], k=20))) for i in range(1200)]
    index = blocks.BlockIndex.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id"))
    asked = next(index._question_blocks(spark.createDataFrame([(1, "a1 a2 a3"), (2, "d4 d4 d9")], "qid long, text string")))
    least = index._thresholds(asked, 5)
    assert (least > 0).all()
    for row in index.blocks.collect():
        block = {c: pa.array(row[c]) for c in ("terms", "starts", "docs", "tf", "lengths", "most_tf", "least_length")}
        bound = asked.bounds(block["terms"], block["most_tf"], block["least_length"])
        doc, q, score = asked.lexical(block, None)
        assert all(s <= bound[i] + 1e-9 for i, s in zip(q, score))
        closed = asked.lexical(block, least)
        assert set(closed[1]) == {i for i in set(q) if bound[i] >= least[i] - 1e-6}


def test_text_ids_and_empty_tables(spark):
    docs, asked = made(60)
    frame = spark.createDataFrame([(f"d{i:03d}", t) for i, t in docs], "doc_id string, text string")
    index = blocks.BlockIndex.build(frame)
    q = spark.createDataFrame(asked, "qid long, text string")
    got = {(r.qid, r.channel, int(r.id[1:]), round(r.score, 6), r["rank"]) for r in index.search(q, 9).collect()}
    assert got == exhaustive(docs, asked, 9)
    assert index.search(q.where("false"), 9).count() == 0
    none = blocks.BlockIndex.build(frame.where("false"))
    assert none.search(q, 9).count() == 0


def test_what_a_task_holds_is_bounded(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=2_000 if i % 7 == 0 else 50))) for i in range(300)]
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)
    frame = pa.record_batch([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["id", "tokens"])
    made_blocks = list(blocks._packed(pa.int64())(iter([frame])))
    sizes = [[sum(len(docs[i][1]) for i in b.column("ids")[0].as_py()[:-1])] for b in made_blocks]
    assert sum(len(b.column("ids")[0]) for b in made_blocks) == 300 and max(sizes) < [20_000]
    index = blocks.BlockIndex.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    monkeypatch.setattr(blocks, "MOST_QUESTIONS", 16)
    short = [(q, rng.choice(words)) for q in range(50)]
    groups = list(index._question_blocks(spark.createDataFrame(short, "qid long, text string")))
    assert max(len(g.ids) for g in groups) <= 16 and sum(len(g.ids) for g in groups) == 50
    monkeypatch.setattr(blocks, "PAIRS", 500)
    row = index.blocks.first()
    block = {c: pa.array(row[c]) for c in ("terms", "starts", "docs", "tf", "lengths", "most_tf", "least_length")}
    parts = list(groups[0].lexical_parts(block, None))
    assert len(parts) > 1 and max(len(p[0]) for p in parts) <= 500
    whole = {(d, q): s for d, q, s in zip(*groups[0].lexical(block, None))}
    monkeypatch.setattr(blocks, "PAIRS", 10**9)
    assert {(d, q): s for d, q, s in zip(*groups[0].lexical(block, None))} == whole


def test_row_groups_hold_few_blocks(spark, monkeypatch):
    """Parquet would look at the size of a row group after 100 rows first; each row is a block."""
    monkeypatch.setattr(blocks, "ROW_GROUP", 20_000)
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(3_000)}" for _ in range(50))) for i in range(2_000)]
    index = blocks.BlockIndex.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.blocks.inputFiles()]
    assert sum(m.num_rows for m in files) >= 16 and sum(m.num_row_groups for m in files) >= 4
