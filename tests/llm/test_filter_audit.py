"""The audit of filter orders against loops over rows."""

import random
import re
from itertools import permutations

from gleaner.llm import filter_audit


def brute(docs, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    texts, first, rows = [(i, t or "", p or "") for i, t, p in docs], {}, []
    for i, t, _ in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    for i, t, part in texts:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((part, {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                n_all = sum(f in r[1] for r in mine)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(here)
                out[part, order, step] = [len(left), len(here), n_all - len(here), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def made():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)] + ["A", "B#", "c|", "É", "\x0bx"]
    texts = [None, "", " \t\n", "X" * 300_000, "w " * 300]
    texts += [" ".join(rng.choices(words[: rng.choice([30, 505])], k=rng.choice([5, 199, 200, 260]))) for _ in range(60)]
    texts += [texts[i] for i in (5, 5, 5, 9, 10, 0, 1)]
    docs = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    docs += [docs[8]] * 3 + [(None, texts[6], "en"), (None, texts[6], "en"), (None, "alone", None), (3, texts[7], "de")]
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(50)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "2 AS n", "'q' AS part", "3 AS good")
    return d.repartition(6), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS lang")


def got(frame):
    return {(r.part, r.filter_order, r.step): [r[c] for c in (*filter_audit.COUNTS, "shapley")] for r in frame.collect()}


def test_audit_equals_loops(spark):
    docs, labels = made()
    out = filter_audit.audit(*frames(spark, docs, labels))
    assert out.count() == 600 * len({p or "" for *_, p in docs})
    assert got(out) == brute(docs, labels)
    kinds = dict(out.dtypes)
    assert kinds.pop("part") == kinds.pop("filter_order") == "string" and kinds.pop("step") == "int" and set(kinds.values()) == {"bigint"}


def test_empty_tables_and_other_ids(spark):
    docs, labels = made()
    d, n = frames(spark, docs, labels)
    assert filter_audit.audit(d.where("false"), n).count() == 0
    assert got(filter_audit.audit(d, n.where("false"))) == brute(docs, [])
    small = d.withColumn("doc_id", d.doc_id.cast("int"))
    assert got(filter_audit.audit(small, n)) == brute(docs, labels)


def test_fewer_filters(spark):
    cells = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 1, 2, 0, 2), ("p", 0, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    out = got(filter_audit.interactions(cells, "AB"))
    assert out == {("p", "AB", 1): [4, 7, 0, 2, 1, 2, 9], ("p", "AB", 2): [4, 0, 5, 0, 0, 0, 5], ("p", "BA", 1): [6, 5, 0, 0, 1, 0, 5], ("p", "BA", 2): [4, 2, 5, 2, 0, 2, 9]}
