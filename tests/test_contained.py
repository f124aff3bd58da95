"""Passages in documents against the plain test of every pair, and graph candidates without the groups that no candidate is in."""

import random

import pyarrow as pa
import pytest

from gleaner import registry
from gleaner.operators import contained
from gleaner.plans import graph_queries as Q


def made():
    rng = random.Random(5)
    words = ["de", "ciónñas", "ßé", "日本", "a", "the", "long-word", "x\n"]
    passages = [" ".join(rng.choices(words, k=rng.choice([1, 2, 4, 12, 40]))) for _ in range(60)]
    passages += [passages[3], passages[4] + " more", "aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaab", "", None]
    docs = [None, "", "a" * 300 + "b", " ".join(passages[:5])]
    docs += ["".join(rng.choice([p or "", " ", " ".join(rng.choices(words, k=9))]) for p in rng.choices(passages, k=rng.choice([1, 3, 9]))) for _ in range(150)]
    return list(enumerate(docs)), list(enumerate(passages))


@pytest.mark.parametrize("piece,block", [(contained.PIECE, contained.BLOCK), (64, 500)])
def test_as_every_pair(spark, monkeypatch, piece, block):
    monkeypatch.setattr(contained, "PIECE", piece)
    monkeypatch.setattr(contained, "BLOCK", block)
    docs, passages = made()
    got = contained.contained_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "item_id int, text string")).collect()
    want = {(i, j) for i, t in docs for j, p in passages if t and p and p in t}
    assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want


def test_a_part_of_an_array_and_the_edges_of_its_texts():
    block = contained._Block([7], [b"0123456789abcdefghij"])
    texts = pa.array(["0123456789abcdefghij", "0123456789abcde", "fghij", "x0123456789abcdefghij", None, "é0123456789abcdefghijé"])
    assert block.found(texts) == [(0, 0), (3, 0), (5, 0)]
    assert block.found(texts.slice(1, 4)) == [(2, 0)]
    assert block.found(pa.array([None, ""], pa.string())) == []


def test_words_are_not_shuffled(spark):
    plan = registry.queries()["st4_contained_passages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_only_groups_of_candidates_are_tagged(spark, monkeypatch):
    seen = []
    plain = Q.enrich
    monkeypatch.setattr(Q, "enrich", lambda pages: seen.append(pages) or plain(pages))
    rows = registry.queries()["gr6_graph_candidates"](spark, "/root/testdata/sf0.01")
    base = {r.id for r in rows.where("rrf < 0.05").collect()}
    assert [p.count() for p in seen] == [len(base)] and len(base) < 1_000
