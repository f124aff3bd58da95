"""Conflicts among the first pages of a question: seven rules over one array of pages a question.

The pages travel as short structs, without texts.  Rules that need a pair take the first page of each kind inside the row, so
no pair of pages is ever a row of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Pages that are looked at.
TOP = 5
TEXTS = "array<string>"


def _conflict(kind: str, status: str, severity: str, sources: list[Column], coverages: Column, sections: Column, forms: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.array(*sources).alias("sources"),
        F.coalesce(coverages, F.array().cast(TEXTS)).alias("coverages"), F.coalesce(sections, F.array().cast(TEXTS)).alias("sections"), F.coalesce(forms, F.array().cast(TEXTS)).alias("forms"),
    )


def conflicts(pages: DataFrame, questions: DataFrame, top: int = TOP) -> DataFrame:
    """``(qid, n, type, status, severity, sources, coverages, sections, forms)``: conflicts of each question in the rules' order.

    ``pages``: qid, place, source, document_type, primary_clause, coverages, sections, forms (arrays), numeric (has table
    fields), relations (array of relation, page, coverages, sections, forms that led to the page).  ``questions``: qid, needs_endorsement,
    needs_exception, needs_limit.  Of conflicts that agree in type, sources, sections and coverages the first stays.
    """
    columns = ["place", "source", "document_type", "primary_clause", "coverages", "sections", "forms", "numeric", "relations"]
    first = Window.partitionBy("qid").orderBy("place", "source")
    head = pages.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= top)
    rows = head.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("pages")).join(questions, "qid")
    of = lambda cond: F.filter("pages", lambda p: F.coalesce(cond(p), F.lit(False)))
    kinds = {
        "declarations": of(lambda p: p["document_type"] == "declarations"),
        "endorsements": of(lambda p: (p["document_type"] == "endorsement") | F.coalesce(p["primary_clause"] == "endorsement", F.lit(False))),
        "exclusions": of(lambda p: p["primary_clause"] == "exclusion"),
        "exceptions": of(lambda p: p["primary_clause"] == "exception"),
        "others": of(lambda p: ~F.coalesce(p["document_type"] == "declarations", F.lit(False)) & p["numeric"]),
    }
    rows = rows.withColumns(kinds)
    has, page = lambda k: F.size(k) > 0, lambda k: F.get(F.col(k), F.lit(0))
    shared = lambda a, b, field: F.sort_array(F.array_intersect(page(a)[field], page(b)[field]))
    pair = lambda kind, status, a, b: _conflict(kind, status, "review", [page(a)["source"], page(b)["source"]], shared(a, b, "coverages"), shared(a, b, "sections"), page(b)["forms"])
    alone = lambda kind: _conflict(kind, "insufficient_counterevidence", "blocking", [page("exclusions")["source"]], page("exclusions")["coverages"], page("exclusions")["sections"], F.array().cast(TEXTS))
    limit = F.col("needs_limit") & F.exists("declarations", lambda p: p["numeric"]) & has("others")
    ruled = F.array(
        F.when(F.col("needs_endorsement") & has("endorsements") & has("exclusions"), pair("endorsement_override", "possible_override", "exclusions", "endorsements")),
        F.when(F.col("needs_endorsement") & ~has("endorsements") & has("exclusions"), alone("missing_endorsement_evidence")),
        F.when(F.col("needs_exception") & has("exceptions") & has("exclusions"), pair("exception_qualifies_exclusion", "possible_exception_carveout", "exclusions", "exceptions")),
        F.when(F.col("needs_exception") & ~has("exceptions") & has("exclusions"), alone("missing_exception_evidence")),
        F.when(limit, pair("numeric_source_conflict", "review_numeric_source", "declarations", "others")),
    )

    def of_relation(p, r):
        edge = lambda kind: _conflict(kind, "candidate_relation_requires_review", "review", [r["page"], p["source"]], r["coverages"], r["sections"], r["forms"])
        return F.array(F.when(r["relation"].contains("overridden_by"), edge("graph_override_relation")), F.when(r["relation"].contains("qualified_by"), edge("graph_exception_relation")))

    led = F.flatten(F.transform("pages", lambda p: F.flatten(F.transform(F.coalesce(p["relations"], F.array()), lambda r: of_relation(p, r)))))
    found = rows.select("qid", F.posexplode(F.array_compact(F.concat(ruled, led))).alias("at", "c")).select("qid", "at", "c.*")
    same = Window.partitionBy("qid", "type", "sources", "sections", "coverages").orderBy("at")
    once = found.withColumn("k", F.row_number().over(same)).where("k = 1")
    number = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    return once.select("qid", number.alias("n"), "type", "status", "severity", "sources", "coverages", "sections", "forms")
