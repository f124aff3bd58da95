"""Second, plain versions of the quality classifier, the mix and the fingerprints, and the pipeline on an empty table."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from gleaner.llm import features, fingerprints, mixing, nbsvm
from gleaner.llm.queries import op2_source_mix, op4_quality_classifier, op10_fingerprints
from tests.llm.test_models import make

MASK = 2**64 - 1


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = make(260, seed=5)
    rows = [(i, t) for i, t, _ in docs] + [(5000, None), (5001, ""), (5002, "tiny"), (5003, "long word " * 30_000), (None, "no id"), (rows_id := docs[0][0], docs[0][1])]
    assert rows_id == docs[0][0]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS codes", "'x' AS score").write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path, rows, labels


def indicators(text):
    """All indicator slots of a text, by definition."""
    text = text or ""
    words, data = text.split(), text.encode()
    slots = {zlib.crc32(w) % features.REPEATED for w in text.lower().encode().split()}
    twice = sum(a == b for a, b in zip(words, words[1:]))
    slots |= {features.REPEATED + i for i, share in enumerate(features.SHARES) if twice > share * len(words)}
    for i in range(len(data) - 2):
        raw = int.from_bytes(data[i : i + 3], "big")
        slots.add(2**17 + ((raw * 0x9E3779B1 >> 11) & (2**17 - 1)))
    return sorted(slots)


def test_quality_scores_equal_a_second_version(spark, folder):
    path, rows, labels = folder
    out = {(r.doc_id, r.held_out): (r.score, r.predicted) for r in op4_quality_classifier(spark, path).collect()}
    docs, table = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))
    model = nbsvm.fit(docs, table, where=~nbsvm.held_out())
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = {i: q for i, q, _ in labels if not held(i)}
    texts = dict(rows)
    learned = [i for n, i in enumerate(sorted(known)) if n % 5 != 4]  # every fifth row fits the curve alone
    counts = {c: Counter(s for i in learned if (known[i] == 1) == c for s in indicators(texts[i])) for c in (True, False)}
    total = {c: sum(counts[c].values()) + features.N_FEATURES for c in counts}
    for slot in random.Random(1).sample(range(features.N_FEATURES), 3000) + list(counts[True])[:2000]:
        ratio = math.log((counts[True][slot] + 1) / total[True] * total[False] / (counts[False][slot] + 1))
        assert model.ratios[slot] == pytest.approx(ratio, abs=1e-4)
    for i, text in rows:
        slots = indicators(text)
        r = [float(model.ratios[s]) for s in slots]
        margin = model.bias + sum(x * float(model.weights[s]) for x, s in zip(r, slots)) / math.sqrt(sum(x * x for x in r) + nbsvm.FLOOR)
        score = 1 / (1 + math.exp(-(model.slope * margin + model.offset)))
        got = out[i, i is not None and held(i)]
        assert got[0] == pytest.approx(score, abs=1e-4) and got[1] == (got[0] >= 0.7)


def test_mix_equals_a_second_version(spark, folder):
    path, rows, _ = folder
    got = op2_source_mix(spark, path).collect()
    assert len(got) == len(rows)
    n = np.array([r.n_tokens for r in got], float)
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got])
    texts = {r[0]: r[1] for r in rows}
    assert all(r.n_tokens == len((texts[r.doc_id] or "").split()) for r in got) and np.allclose(p.sum(axis=1), 1)
    low, start = np.where(p[:, 0] >= mixing.CERTAIN, 1.0, 0.0), n @ p
    target = start[0] / mixing.WEIGHTS["clean"] * np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    rate, ahead, speed = np.ones(len(n)), np.ones(len(n)), 1.0
    slope = lambda x: p @ (((n * x) @ p - target) / start) + mixing.NEAR * (x - 1)  # noqa: E731 - of the objective, by token
    bound = max(float(np.linalg.eigvalsh((p * n[:, None]).T @ p / np.sqrt(np.outer(start, start))).max()), 1e-9) + mixing.NEAR
    for _ in range(60_000):  # accelerated projected gradient on the rates themselves
        new = np.maximum(low, ahead - slope(ahead) / bound)
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead, rate, speed = new + (speed - 1) / faster * (new - rate), new, faster
    value = lambda x: (((n * x) @ p - target) ** 2 / start).sum() / 2 + mixing.NEAR / 2 * (n * (x - 1) ** 2).sum()
    mine = np.array([r.rate for r in got])
    assert (mine >= low - 1e-12).all() and value(mine) <= value(rate) * (1 + 1e-3) + 1e-6 * start.sum()
    key = lambda r: xxhash.xxh64((texts[r.doc_id] or "").encode(), seed=xxhash.xxh64(("" if r.doc_id is None else str(r.doc_id)).encode(), seed=42).intdigest()).intdigest()
    for r in got:
        draw = xxhash.xxh64(b"mix", seed=xxhash.xxh64(key(r).to_bytes(8, "little"), seed=42).intdigest()).intdigest() % 2**24 / 2**24
        assert r.copies == math.floor(r.rate) + (draw < r.rate - math.floor(r.rate))


def mixed64(x):
    x ^= x >> 31
    x = x * 0x9E3779B97F4A7C15 & MASK
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ (x >> 32)


def test_fingerprints_equal_a_second_version(spark, folder):
    path, rows, _ = folder
    words = lambda t: {xxhash.xxh3_64_intdigest(w) for w in (t or "").lower().encode().split()}
    counts = Counter(w for _, t in rows for w in words(t))
    lexicon = {w for w, n in counts.items() if max(2, fingerprints.LOW * len(rows)) <= n <= fingerprints.HIGH * len(rows)}

    def made(text):
        own = words(text) & lexicon or words(text)
        out = []
        for k, power in enumerate(fingerprints.POWERS):
            part = sorted(w for w in own if mixed64(w ^ mixed64(k + 1)) < MASK >> power)
            out.append(hashlib.blake2b(b"".join(w.to_bytes(8, "little") for w in part), digest_size=8).hexdigest() if part else "-")
        return out

    def alike(a, b):
        both = [x == y for x, y in zip(a, b) if not x == y == "-"]
        return sum(both) / len(both) if both else 1.0

    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], [-ord(c) for c in r[1] or ""]), reverse=True)
    got = op10_fingerprints(spark, path).collect()
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        third = len(t) // 3
        edit = t[: len(t) - third] + after[:third]
        a, b, c = made(t), made(edit), made(after)
        want.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), ",".join(a), ",".join(b), alike(a, b), alike(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_textual_ids_and_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    docs = spark.createDataFrame([("a", "one two three"), ("b", "four five six"), (None, "x")], "doc_id string, text string")
    assert {r.doc_id for r in fingerprints.edit_test(docs).collect()} == {"a", "b", None}
    spark.read.parquet(path + "/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(path + "/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for query in (op2_source_mix, op4_quality_classifier, op10_fingerprints):
        assert query(spark, str(tmp_path)).count() == 0
