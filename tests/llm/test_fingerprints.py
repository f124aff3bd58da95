import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import fingerprints as fp


def corpus():
    rng = random.Random(6)
    common = [f"c{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(rng.randint(0, 80))) + f" own{i}") for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "single"), (7, rows[7][1]), (103, rows[3][1]), (None, "null id text")]


@pytest.mark.parametrize("per", [5, 10_000])
def test_edit_test_equals_brute_force(spark, monkeypatch, per):
    monkeypatch.setattr(fp, "ROWS_A_BUCKET", per)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS ctx")
    got = fp.edit_test(df).collect()
    terms = fp.lexicon(df)
    count = {}
    for _, t in rows:
        for w in fp.words(t or ""):
            count[w] = count.get(w, 0) + 1
    import xxhash

    band = [w for w, n in count.items() if max(2, fp.LOW * len(rows)) <= n <= fp.HIGH * len(rows)]
    assert sorted(map(xxhash.xxh3_64_intdigest, band)) == terms.tolist()
    f = fp.Fingerprinter(terms)
    order = sorted(((-(i if i is not None else -(2**63))), t or "", i) for i, t in rows)
    expected = []
    for k, (_, text, i) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        new = fp.edited(text, following)
        own = f.hashes(text)
        expected.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), ",".join(own), ",".join(f.hashes(new)), fp.likeness(own, f.hashes(new)), fp.likeness(own, f.hashes(following))))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[3] == same[103] and same[100] == same[101]
    plain = {r.doc_id: r.fingerprint for r in fp.fingerprints(df, terms).collect()}
    assert plain == same


def test_empty_table_and_likeness(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fp.edit_test(df).count() == 0
    f = fp.Fingerprinter(np.zeros(0, np.uint64))
    a, b = f.hashes("some words here"), f.hashes("other things there")
    assert fp.likeness(a, a) == 1.0 and fp.likeness(a, b) < 0.2 and fp.likeness(f.hashes(""), f.hashes("")) == 1.0
