import random

import numpy as np
import pytest

import corpus_pipeline
from gleaner.llm import near_dup
from gleaner.llm.queries import op6_near_duplicates


def exact_components(rows):
    """Brute force over all pairs of full sets."""
    sets = [(i, near_dup.shingle_set(t)) for i, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                label[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [least.get(find(a)) if sets[a][1] else sets[a][0] for a in range(len(sets))]


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "two words"), (6, "Two  Words")]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(12, 120))]
        for edits in range(rng.randint(1, 9)):
            new = list(base)
            for _ in range(edits * len(base) // 60):
                new[rng.randrange(len(new))] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(new)))
    chain = [rng.choice(words) for _ in range(60)]
    for step in range(25):
        chain[2 * step % 60] = f"c{step}"
        rows.append((len(rows) + 10, " ".join(chain)))
    rows += rows[10:14] + [(None, rows[12][1]), (None, "only here with a null id")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small, heavy, chunk, first", [(128, 64, 1 << 18, 4), (3, 2, 300, 1), (128, 2, 300, 4)])
def test_components_equal_brute_force(spark, monkeypatch, small, heavy, chunk, first):
    for name, value in (("SMALL", small), ("HEAVY", heavy), ("CHUNK", chunk), ("SKETCHES", max(2, chunk // 100)), ("FIRST_TREES", first)):
        monkeypatch.setattr(near_dup, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS u", "1 AS node")
    got = near_dup.near_duplicates(df).collect()
    key = lambda i, c: (i is None, i or 0, c is None, c or 0)
    expected = sorted((key(i, c) for (i, _), c in zip(rows, exact_components(rows))))
    assert sorted(key(r.doc_id, r.component_id) for r in got) == expected
    sizes = {i: len(near_dup.shingle_set(t)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)


def test_large_group_of_copies(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(600):
        new = list(base)
        for _ in range(rng.randint(0, 8)):
            new[rng.randrange(150)] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(new)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(zip(range(600), exact_components(rows)))


def test_keep_one_and_empty(spark):
    rows = [(3, "a b c d", 1), (2, "A b c d", 2), (9, "other text here", 3), (None, "a b c d", 4), (5, None, 5), (9, "other text here", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    kept = near_dup.keep_one(df).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in kept if r.doc_id is not None) == [(2, 2), (5, 5), (9, 3)]
    assert near_dup.near_duplicates(df.where("false")).count() == 0


def test_pairs_at_the_threshold_meet_at_the_last_depth():
    rng = np.random.default_rng(8)
    n, trees = 4000, near_dup.TREES + getattr(near_dup, "MORE_TREES", 0)
    a, b = (rng.integers(0, 2**16, (n, near_dup.POSITIONS)) for _ in range(2))
    b = np.where(rng.random(a.shape) < 0.8, a, b)
    node = np.repeat(near_dup.mix64(np.arange(1, trees + 1, dtype=np.uint64)), n)
    paths = []
    for tokens in (a, b):
        nodes, pair = near_dup.branch(node, np.tile(np.arange(n), trees), tokens, near_dup.DEPTH)
        paths.append(near_dup.mix64(nodes + pair.astype(np.uint64)))
    nodes, pair = near_dup.branch(node, np.tile(np.arange(n), trees), a, near_dup.DEPTH)
    met = np.isin(paths[0], paths[1])
    assert len(set(pair[met].tolist())) == n


def test_classes_of_large_nodes_enter_further_trees(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 3)
    tokens = np.arange(near_dup.POSITIONS).astype(np.uint16)
    classes = spark.createDataFrame([(i, i, bytearray(tokens.tobytes())) for i in range(8)], "u long, comp long, tokens binary")
    run = near_dup._Join(spark.createDataFrame([], "doc_id long, text string"))
    trees = near_dup.TREES + near_dup.MORE_TREES
    nodes, _ = near_dup.branch(near_dup.roots(0, trees), np.zeros(trees, int), tokens[None, :], near_dup.DEPTH)
    got = run.members(classes).collect()
    assert {r.node for r in got} == set(nodes.view(np.int64).tolist()) and all(r.size == 8 for r in got)


def scattered():
    base = [f"w{i}" for i in range(100)]
    few, many = ([f"n{i}" if i in at else w for i, w in enumerate(base)] for at in ({50}, {10, 30, 50, 70, 90}))
    return [(1, " ".join(base)), (2, " ".join(many)), (3, " ".join(few)), (4, "w0 w1 w2"), (5, "W0 W1  w2")]


def test_stage_links_five_word_shingles(spark):
    rows = scattered() + [(i + 100, t) for i, t in corpus() if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def runs(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    label, sets = list(range(len(rows))), [runs(t) for _, t in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    heads = {}
    for (i, _), c, s in zip(rows, label, sets):
        heads[c if s else -i - 1] = min(heads.get(c if s else -i - 1, i), i)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(heads.values())


def test_op6_links_two_word_shingles(spark, tmp_path):
    spark.createDataFrame(scattered(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in op6_near_duplicates(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 99), 2: (1, 99), 3: (1, 99), 4: (4, 2), 5: (4, 2)}
