"""Every conflict rule by a literal case."""

from gleaner.operators import conflicts as C

PAGE = "qid int, place int, source string, document_type string, primary_clause string, coverages array<string>, sections array<string>, forms array<string>, numeric boolean, relations array<struct<relation:string,page:string,coverages:array<string>,sections:array<string>,forms:array<string>>>"


def page(qid, place, source, kind="base_policy", clause="coverage", cov=(), sec=(), forms=(), numeric=False, relations=()):
    return qid, place, source, kind, clause, list(cov), list(sec), list(forms), numeric, list(relations)


def run(spark, pages, questions, **kw):
    q = spark.createDataFrame(questions, "qid int, needs_endorsement boolean, needs_exception boolean, needs_limit boolean")
    out = C.conflicts(spark.createDataFrame(pages, PAGE).repartition(3), q, **kw).orderBy("qid", "n").collect()
    return [(r.qid, r.type, r.severity, list(r.sources), list(r.coverages), list(r.sections), list(r.forms)) for r in out]


def test_each_type(spark):
    edge = ("reverse::candidate_overridden_by", "k9", ["water"], ["II"], ["F1"])
    pages = [
        page(1, 1, "x", clause="exclusion", cov=["water", "cyber"], sec=["II", "I"]), page(1, 2, "e", "endorsement", cov=["cyber"], sec=["I"], forms=["HO-1"]),
        page(2, 1, "x", clause="exclusion", cov=["water"], sec=["II"]), page(2, 2, "y"),
        page(3, 1, "q", clause="exception", cov=["water"], forms=["X"]), page(3, 2, "x", clause="exclusion", cov=["water"]),
        page(4, 1, "x", clause="exclusion"),
        page(5, 1, "d", "declarations", numeric=True, cov=["auto"]), page(5, 2, "t", numeric=True, cov=["auto"], forms=["T"]),
        page(6, 1, "p", relations=[edge, edge, ("candidate_qualified_by", "k8", [], [], [])]),
        page(7, 1, "d", "declarations", numeric=True), page(7, 2, "e", None, None),
    ]
    asked = [(1, True, True, True), (2, True, False, False), (3, False, True, False), (4, True, True, False), (5, False, False, True), (6, True, True, True), (7, True, True, True), (8, True, True, True)]
    assert run(spark, pages, asked) == [
        (1, "endorsement_override", "review", ["x", "e"], ["cyber"], ["I"], ["HO-1"]),
        (1, "missing_exception_evidence", "blocking", ["x"], ["water", "cyber"], ["II", "I"], []),
        (2, "missing_endorsement_evidence", "blocking", ["x"], ["water"], ["II"], []),
        (3, "exception_qualifies_exclusion", "review", ["x", "q"], ["water"], [], ["X"]),
        (4, "missing_endorsement_evidence", "blocking", ["x"], [], [], []),
        (4, "missing_exception_evidence", "blocking", ["x"], [], [], []),
        (5, "numeric_source_conflict", "review", ["d", "t"], ["auto"], [], ["T"]),
        (6, "graph_override_relation", "review", ["k9", "p"], ["water"], ["II"], ["F1"]),
        (6, "graph_exception_relation", "review", ["k8", "p"], [], [], []),
    ]


def test_only_the_first_pages_count(spark):
    pages = [page(1, i, f"p{i}") for i in range(1, 6)] + [page(1, 6, "x", clause="exclusion")]
    assert run(spark, pages, [(1, True, True, True)]) == []
    assert [r[1] for r in run(spark, pages, [(1, True, False, True)], top=6)] == ["missing_endorsement_evidence"]
