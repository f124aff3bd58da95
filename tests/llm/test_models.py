"""Quality rules, the quality classifier and the source mix."""

import random
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import mixing, nbsvm, quality_rules
from gleaner.llm.features import indicator_codes


def make(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(["clean"] * 4 + ["symbols", "repeat", "toxic"])
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if kind == "symbols":
            text = [w + rng.choice(["###", "$$$", "&&&"]) for w in text]
        if kind == "repeat":
            text = [w for w in text[:6] for _ in range(15)]
        if kind == "toxic":
            text[::9] = ["vilename"] * len(text[::9])
        docs.append((i, " ".join(text), "en"))
        labels.append((i, int(kind in ("clean", "toxic")), int(kind == "toxic")))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = make()
    docs += [(900, None, "en"), (901, "", "en"), (0, docs[0][1], "en")]
    labels += [(None, 1, 0), (5, None, None), (77777, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def slow_counts(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é#", " ", " ", "\n", "\t", "$", "a b c d e ", " ", "\x1c"]) for _ in range(rng.randint(0, 60)))
        assert quality_rules.text_counts(text)[:5] == slow_counts(text), repr(text)


def test_rules_reject_junk(tables):
    docs, labels = tables
    rules = quality_rules.fit(docs, labels)
    assert rules
    rows = {r.doc_id: r for r in quality_rules.apply_rules(docs, rules).collect()}
    truth = {i: q for i, q, _ in make()[1]}
    right = sum(rows[i].kept == bool(q) for i, q in truth.items())
    assert right >= 0.97 * len(truth)
    assert not rows[900].kept and rows[900].base_failed and rows[901].n_words == 0
    assert quality_rules.fit(docs, labels.where("false")) == [] and quality_rules.apply_rules(docs.where("false"), rules).count() == 0


def test_conditions_equal_the_learned_tests(tables):
    docs, labels = tables
    rules = quality_rules.fit(docs, labels)
    for r in quality_rules.apply_rules(docs, rules).collect():
        n, lines = max(r.n_words, 1), max(r.n_lines, 1)
        stats = {"n_words": r.n_words, "word_length": r.word_chars / n, "symbol_ratio": r.n_symbols / n, "dup_line_ratio": r.n_dup_lines / lines, "repeat_ratio": r.n_repeat_words / n, "distinct_ratio": r.n_distinct / n, "capital_ratio": r.n_capital / n, "short_ratio": r.n_short / n, "line_words": r.n_words / lines}
        first = next((i for i, rule in enumerate(rules) if rule.covers({k: np.array([v]) for k, v in stats.items()})[0]), None)
        assert first == r.rule


def test_classifier_on_held_out_rows(tables):
    docs, labels = tables
    rows = nbsvm.classify(docs, labels).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {i: q for i, q, _ in make()[1]}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert nbsvm.classify(docs, labels.where("false")).where("score <> 0.5").count() == 0
    assert nbsvm.classify(docs.where("false"), labels).count() == 0


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(60)]
    y = np.where([3 in r or 7 in r for r in rows], 1.0, -1.0)
    values = [np.ones(6, np.float32) for _ in rows]
    w, b = nbsvm.dual_descent(rows, values, y, np.full(60, 1.0), 300)
    primal = 0.5 * (w @ w + b * b) + sum(max(0, 1 - t * (w[r].sum() + b)) for r, t in zip(rows, y))
    for _ in range(300):
        d, e = rng.normal(0, 0.05, 40), rng.normal(0, 0.05)
        v = w.copy()
        v[:40] += d
        assert 0.5 * (v @ v + (b + e) ** 2) + sum(max(0, 1 - t * (v[r].sum() + b + e)) for r, t in zip(rows, y)) >= primal - 1e-2
    assert len(indicator_codes(None)) == 0


def test_mix_meets_targets(tables):
    docs, labels = tables
    out = mixing.mixed(docs, labels, {"clean": 0.9, "poor": 0.06, "toxic": 0.04})
    rows = out.collect()
    assert len(rows) == 403 and all(r.rate >= 0 for r in rows)
    total = {d: sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS}
    clean = sum(r.n_tokens * r.p_clean for r in rows)
    for d, w in {"clean": 0.9, "poor": 0.06, "toxic": 0.04}.items():
        assert total[d] == pytest.approx(clean / 0.9 * w, abs=0.01 * clean)
    kept = {r.doc_id for r in mixing.mix_documents(docs, labels).collect()}
    truth = {i: mixing.domain_of(q, t) for i, q, t in make()[1]}
    assert {i for i, d in truth.items() if d == "clean"} <= kept
    assert mixing.mix_documents(docs, labels).columns == docs.columns
    assert mixing.mixed(docs.where("false"), labels).count() == 0


def test_projected_gradient_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1, 1], 30)
    n = rng.integers(1, 50, 30)
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, p_clean double, p_poor double, p_toxic double")
    fit = mixing.fit_rates(df, {"clean": 0.5, "poor": 0.3, "toxic": 0.2})
    r, s = np.ones(30), n @ p
    target = np.array([fit.targets[d] for d in mixing.DOMAINS])
    for _ in range(len(fit.gradients)):
        r = np.maximum(0, r - p @ (((n * r) @ p - target) / s))
    got = np.array([x[0] for x in df.select(mixing.replayed(fit.gradients)).collect()])
    assert np.allclose(np.sort(got), np.sort(r), atol=1e-6)


def members_frame(spark, n, p):
    rows = [(i, int(a), *map(float, b)) for i, (a, b) in enumerate(zip(n, p))]
    return spark.createDataFrame(rows, "row_key long, n_tokens long, p_clean double, p_poor double, p_toxic double")


@pytest.mark.parametrize("most", [float("inf"), 1.0])
@pytest.mark.parametrize("weights", [{"clean": 0.5, "poor": 0.3, "toxic": 0.2}, {"clean": 0.9, "poor": 0.02, "toxic": 0.08}])
def test_rates_are_optimal_within_their_bounds(spark, weights, most):
    rng = np.random.default_rng(1)
    p, n = rng.dirichlet([1, 0.4, 0.4], 60), rng.integers(1, 50, 60)
    df = members_frame(spark, n, p)
    fit = mixing.closest_rates(df, weights, most=most)
    s, target, least = n @ p, np.array([fit.targets[d] for d in mixing.DOMAINS]), np.where(p[:, 0] >= 0.5, 1.0, 0.0)
    loss = lambda r: (((n * r) @ p - target) ** 2 / s).sum() / 2
    r = np.ones(60)
    for _ in range(60_000):
        r = np.clip(r - p @ (((n * r) @ p - target) / s), least, most)
    got = np.array([x.rate for x in df.withColumn("rate", mixing.rate_of(fit.z, most)).orderBy("row_key").collect()])
    assert (got >= least).all() and (got <= most).all() and fit.error <= 1e-6 * target.sum()
    assert loss(got) <= loss(r) + 1e-3 * target.sum() * 1e-2
    assert np.allclose([fit.totals[d] for d in mixing.DOMAINS], (n * got) @ p)


def test_copies_and_kept_rows_have_the_fitted_totals(spark, monkeypatch):
    rng = np.random.default_rng(6)
    p, n = rng.dirichlet([2, 0.5, 0.5], 20_000), rng.integers(20, 60, 20_000)
    df = members_frame(spark, n, p)
    monkeypatch.setattr(mixing, "fit_posterior", lambda *a: None)
    monkeypatch.setattr(mixing, "posteriors", lambda *a: df)
    for weights, most in (({"clean": 0.6, "poor": 0.22, "toxic": 0.18}, float("inf")), (None, 1.0)):
        rows = mixing.mixed(df, None, weights, most).collect()
        fit = mixing.closest_rates(df, weights, most=most)
        for d in mixing.DOMAINS:
            drawn = sum(r.n_tokens * r.copies * r[f"p_{d}"] for r in rows)
            assert drawn == pytest.approx(fit.totals[d], rel=0.03)
            if most > 1:
                assert drawn == pytest.approx(fit.targets[d], rel=0.03)
        assert most > 1 or max(r.copies for r in rows) == 1
