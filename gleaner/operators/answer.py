"""Extractive answers, confidence and answer checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import tags, text as T


def sentence_terms(text: Column, least: int = 2, amounts: bool = False) -> Column:
    """``(i, s, own)`` of a text's sentences: place, sentence, distinct terms; only those with an amount if ``amounts``."""
    rows = F.transform(T.sentences(text), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    rows = F.filter(rows, lambda x: x["s"].rlike(T.AMOUNT)) if amounts else rows
    return F.transform(rows, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"), T.terms(x["s"], least).alias("own")))


def best_sentence(question: Column, text: Column) -> Column:
    """The sentence that shares most terms, the first among equals; null if none shares a key term."""
    asks = lambda w: F.lower(question).contains(w)
    return best_of(T.terms(question, 3), T.key_terms(question), asks("deductible"), asks("limit"), sentence_terms(text))


def best_of(q: Column, keys: Column, deductible: Column, limit: Column, sentences: Column) -> Column:
    """``best_sentence`` of a question's terms, key terms and words, and of ``sentence_terms``."""

    def scored(x: Column) -> Column:
        score = F.size(F.array_intersect(q, x["own"])).cast("double")
        score = score + F.when(deductible & x["s"].contains("$"), 2.0).otherwise(0.0) + F.when(limit & x["s"].contains("$"), 2.0).otherwise(0.0)
        score = score - F.when((F.size(keys) > 0) & ~F.arrays_overlap(keys, x["own"]), 1.5).otherwise(0.0)
        return F.struct((-score).alias("k"), x["i"].alias("i"), x["s"].alias("s"), F.arrays_overlap(keys, x["own"]).alias("hit"))

    return tags.bound(F.array_min(F.transform(sentences, scored)), lambda best: F.when((best["k"] < 0) & best["hit"], best["s"]))


def repaired_answer(question: Column, answer: Column, evidence: Column) -> Column:
    """For a numeric question answered without an amount, the evidence's best sentence with one."""
    wanted = tags.needs_numeric_evidence(question) & ~tags.is_abstention(answer) & ~F.coalesce(answer, F.lit("")).rlike(T.AMOUNT)
    return repaired_of(wanted, tags.field_groups(question), sentence_terms(evidence, amounts=True))


def repaired_of(wanted: Column, groups: Column, sentences: Column) -> Column:
    """``repaired_answer`` of a question's field groups and of ``sentence_terms`` with an amount."""

    def scored(x: Column) -> Column:
        own = x["own"]
        score = F.size(F.filter(groups, lambda g: F.arrays_overlap(g, own))) + F.when(F.array_contains(own, "limit") | F.array_contains(own, "deductible"), 1).otherwise(0)
        return F.struct((-score).alias("k"), x["i"].alias("i"), x["s"].alias("s"))

    return F.when(wanted, tags.bound(F.array_min(F.transform(sentences, scored)), lambda best: F.when(best["k"] < 0, best["s"])))


def confidence(top: Column, question: Column, answer: Column, evidence: Column) -> Column:
    """.55 of the top score, .20 of the terms answered, .25 of the key terms in evidence; four digits.

    A numeric question has at least .42 if the answer's amounts all stand in the evidence, else at most .19.  At most
    .19, too, where long key terms are missing and half or fewer are there, or where under a quarter are there.
    """
    return confidence_of(top, T.terms(question, 3), T.key_terms(question), tags.needs_numeric_evidence(question), T.terms(answer, 3), T.found(answer, T.AMOUNT), T.terms(evidence, 3), T.found(evidence, T.AMOUNT))


def confidence_of(top: Column, q: Column, keys: Column, numeric: Column, answered: Column, said: Column, known: Column, amounts: Column) -> Column:
    """``confidence`` of what a question (terms, key terms, whether it is numeric), an answer and evidence (terms, amounts) hold."""
    clamped, there = F.greatest(F.lit(0.0), F.least(F.lit(1.0), top)), share(keys, known)
    plain = 0.55 * clamped + 0.20 * share(q, answered) + 0.25 * there
    backed = (F.size(said) > 0) & (F.size(F.array_except(said, amounts)) == 0)
    checked = F.when(~numeric, plain).when(backed, F.greatest(plain, F.lit(0.42))).otherwise(F.least(plain, F.lit(0.19)))
    missing = F.exists(F.array_except(keys, known), lambda t: F.length(t) >= 7)
    weak = (missing & (there <= 0.5)) | ((F.size(keys) > 0) & (there < 0.25))
    return F.round(F.when(weak, F.least(checked, F.lit(0.19))).otherwise(checked), 4)


# Words of a question about versions (two are needed), and of one about given documents.
VERSION_WORDS = r"(?i)\b(?:compar|diff|version|drift|v1|v2|chang|updat)\w*\b"
GIVEN_DOCUMENTS = r"(?i)\b(?:documents?|polic(?:y|ies)|guides?|pdf|uploaded|files?)\b"


def route(question: Column, known: Column) -> Column:
    """Where a chat question goes; ``known`` says that the glossary has a term of it.

    One's own policy: ``abstain``, as a public corpus can't settle it.  Then ``diff``, ``knowledge`` unless the question
    is about given documents, and ``document``.
    """
    given = tags.is_personal(question) | question.rlike(GIVEN_DOCUMENTS) | question.rlike(tags.THIS_CONCEPT)
    versions = F.regexp_count(question, F.lit(VERSION_WORDS)) >= 2
    return F.when(tags.is_personal(question), "abstain").when(versions, "diff").when(known & ~given, "knowledge").otherwise("document")


def key_present(answer: Column, key: Column) -> Column:
    """A key stands in an answer: numbers by value, phrases between word boundaries."""
    plain, value = T.number_aware(answer), T.number_aware(key)
    numbers = F.transform(F.filter(F.split(plain, " "), lambda t: t.rlike(r"^[0-9]+(\.[0-9]+)?$")), lambda t: t.cast("decimal(38,10)"))
    number = F.when(value.rlike(r"^[0-9]+(\.[0-9]+)?$"), value).cast("decimal(38,10)")
    phrase = F.concat(F.lit(" "), plain, F.lit(" ")).contains(F.concat(F.lit(" "), value, F.lit(" ")))
    return (value != "") & F.when(number.isNotNull(), F.array_contains(numbers, number)).otherwise(phrase)


def answer_key_match(answer: Column, groups: Column) -> Column:
    """Every group has a key that stands in the answer."""
    return (F.size(groups) > 0) & F.forall(groups, lambda g: F.exists(g, lambda k: key_present(answer, k)))


def share(a: Column, b: Column) -> Column:
    """Share of the items of ``a`` that ``b`` has; 0 if there are none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def support_ratio(answer: Column, evidence: Column) -> Column:
    """Share of an answer's stemmed terms that the evidence supports."""
    return share(T.support_terms(answer), T.support_terms(evidence))
