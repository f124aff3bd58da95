"""The path study against enumeration."""

import random

from gleaner.operators import graph as G


def walk(seeds, edges, hops, most, all_edges):
    """Pages reached hop by hop: explicit edges first, then confidence, then id; only explicit ones lead on."""
    out, seen, frontier = [], set(seeds), set(seeds)
    for hop in range(hops):
        reach = {}
        for s, t, relation, c in edges:
            plain = "candidate_" not in relation
            if s in frontier and t not in seen and (plain or (all_edges and hop == 0)):
                reach[t] = max(reach.get(t, (False, 0.0)), (plain, c))
        best = sorted(reach, key=lambda t: (not reach[t][0], -reach[t][1], t))[:most]
        out += best
        seen |= set(best)
        frontier = {t for t in best if reach[t][0]}
    return out[:most]


def enumerated(gold, lists, edges, k, seeds, hops, most):
    out = {}
    for cid, need in gold.items():
        for arm, (channels, mode) in G.ARMS.items():
            score = {}
            for channel in channels:
                for place, i in enumerate(lists[cid].get(channel, []), 1):
                    score[i] = score.get(i, 0) + 1 / (60 + place)
            ranked = sorted(score, key=lambda i: (-round(score[i], 9), i))
            first = walk(ranked[:seeds], edges, hops, most, mode == "all") if mode else []
            pages = [*first, *[i for i in ranked if i not in first]][:k]
            out[cid, arm] = (len(need), len(need & set(pages)), need <= set(pages))
    return out


def test_arms_equal_enumeration(spark):
    rng = random.Random(6)
    ids = range(40)
    edges = [(a, b, rng.choice(["refers", "candidate_x"]), rng.choice([0.4, 0.6, 0.9])) for a in ids for b in rng.sample(ids, 3) if a != b]
    lists = {c: {ch: rng.sample(ids, rng.choice([0, 2, 6])) for ch in ("sparse", "dense")} for c in range(25)}
    gold = {c: set(rng.sample(ids, rng.choice([1, 2, 3]))) for c in range(25)}
    frames = (
        spark.createDataFrame([(c, i) for c, need in gold.items() for i in need], "cid long, id long"),
        spark.createDataFrame([(c, ch, i, p) for c, of in lists.items() for ch, x in of.items() for p, i in enumerate(x, 1)], "cid long, channel string, id long, place int"),
        spark.createDataFrame(edges, "source long, target long, relation string, confidence double"),
    )
    for k, seeds, hops, most in ((3, 4, 2, 8), (6, 1, 2, 2), (4, 2, 1, 8)):
        got = {(r.cid, r.arm): (r.n_gold, r.found, r.complete) for r in G.path_study(*frames, k=k, seeds=seeds, hops=hops, most=most).collect()}
        assert got == enumerated(gold, lists, edges, k, seeds, hops, most)
