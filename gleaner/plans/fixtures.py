"""Small relations in the domain's vocabulary, which the large tables do not hold."""

from gleaner.plans.base import Relation

PAGES = Relation(
    "fixture_pages",
    "doc_id string, page_number int, source string, packet_id string, policy_number string, text string",
    [
        ("ho1", 1, "ho1.pdf#page=1", "pk1", "P-1", "Policy Declarations\nCollision Deductible: $500\nComprehensive Deductible: $250\nAnnual premium | $1,200.50 | due\nPolicy period: 01/02/2024"),
        ("ho1", 2, "ho1.pdf#page=2", "pk1", "P-1", "SECTION II - LIABILITY COVERAGES\nCoverage E - Personal Liability\nWe do not cover electronic data loss. See Section III for exclusions."),
        ("ho1", 3, "ho1.pdf#page=3", "pk1", "P-1", "Cyber Liability Endorsement HO-123\nThis endorsement modifies the policy and provides cyber liability coverage up to $25,000, however conditions apply.\nLiability limit is 100,000"),
        ("ho1", 4, "ho1.pdf#page=4", "pk1", "P-1", "Section III - Definitions\nElectronic data means information stored on computers.\nIncludes policies and boxes."),
        ("ho2", 1, "ho2.pdf#page=1", "pk2", None, "Billing invoice\nPremium due 12% of amount\nThis policy excludes earthquake loss."),
        ("ho2", 2, "ho2.pdf#page=2", "pk2", None, "Schedule of coverage\nDwelling limit: 80%\nThe insured must promptly notify us after a loss. Medical Payments Coverage F pays at least $1,000 per person."),
        ("au3", 1, "au3.pdf#page=1", "pk3", "P-9", "AUTO POLICY\nUninsured Motorist: $50,000 | $100,000\nUmbrella and excess liability\nClaim number 77 proof of loss"),
        ("au3", 2, "au3.pdf#page=2", "pk3", "P-9", "general conditions of the policy\n\n   \nSECTION iv DUTIES\nnothing else here at all, no amounts."),
    ],
    "SELECT concat('d', doc_id) AS doc_id, 1 AS page_number, concat('doc', doc_id, '.txt#page=1') AS source, concat('own', doc_id) AS packet_id, CAST(NULL AS STRING) AS policy_number, text FROM {documents}",
)

QUESTIONS = Relation(
    "fixture_questions",
    "qid int, question string",
    [
        (1, "What is the collision deductible on my policy?"),
        (2, "Compare the version of the cyber endorsement HO-123 with Section II"),
        (3, "Is electronic data covered under Coverage E?"),
        (4, "How much is the annual premium?"),
        (5, "Define electronic data in the definitions"),
        (6, "Which exclusions does the schedule modify, per rider?"),
        (7, "Who wrote this guide?"),
        (8, "Are we covered for water backup after a loss?"),
        (9, "Do I have coverage for medical payments limits, and what does this specific plan pay?"),
        (10, ""),
    ],
    'SELECT CAST(item_id + 1000 AS INT) AS qid, text AS question FROM {benchmark}',
)

ANSWERS = Relation(
    "fixture_answers",
    "aid int, answer string",
    [
        (1, "The deductible is $500."),
        (2, "The provided documents do not state the deductible."),
        (3, "I don’t know."),
        (4, "Insufficient_evidence"),
        (5, "Therefore, it is impossible to determine the limit."),
        (6, "Do not assume it is impossible to determine the deductible."),
        (7, "No deductible amount is listed; the limit is $5."),
        (8, "No specific premium amount for the rider is stated."),
        (9, "Based on the information provided, there is no information about floods."),
        (10, "The policy does not cover floods."),
        (11, None),
        (12, "This text does not support a definitive answer."),
    ],
    'SELECT CAST(conv_id * 100 + turn + 1000 AS INT) AS aid, text AS answer FROM {conversations}',
)

SOURCES = Relation(
    "fixture_sources",
    "sid int, source string",
    [
        (1, "docs/a.pdf#page=3"),
        (2, "https://x.org/p#page=1"),
        (3, "https://x.org/p#page=02"),
        (4, "  plain name "),
        (5, "[C:\\files\\Guide.PDF#page=007]"),
        (6, "a#page=x"),
        (7, ""),
        (8, "Home Owners V2 (2021a).pdf"),
        (9, "ho00 3 form"),
        (10, "__--"),
        (11, "docs/big.pdf#page=12345"),
    ],
    "SELECT CAST(page_id + 1000 AS INT) AS sid, concat(url, '#page=', page_id % 40) AS source FROM {pages}",
)

TABLE_ROWS = Relation(
    "fixture_rows",
    "rid int, header array<string>, cells array<string>",
    [(1, ["", "2019", "2020"], ["net  income", "5", "7"]), (2, ["in millions", "2019"], ["debt", "12 %"]), (3, ["x"], ["y"])],
    "SELECT CAST(p_partkey + 1000 AS INT) AS rid, array('', 'key', 'size') AS header, array(p_name, CAST(p_partkey AS STRING), CAST(p_size AS STRING)) AS cells FROM {part}",
)

SFT = Relation(
    "fixture_sft",
    "rid int, instruction string, evidence string, question string, source string, answer string",
    [(1, "Answer.", "The deductible is $500.", " What? ", "a.pdf#page=1", " $500 "), (2, None, "", "Why?", None, "Because."), (3, "  ", "E", None, "s", None)],
    "SELECT CAST(doc_id + 1000 AS INT) AS rid, lang AS instruction, text AS evidence, concat('What is in ', source, '?') AS question, source, concat(' ', lang) AS answer FROM {documents}",
)

VALUES = Relation(
    "fixture_values",
    "vid int, value string",
    [(1, "$1,234.50"), (2, "about 12.5% or $3"), (3, "no number"), (4, "$,"), (5, ""), (6, "['a b', ' c ']"), (7, "nan"), (8, "[]"), (9, "  spaced   out "), (10, "$12,000–$15,000 — up"), (11, "“Quoted” … it’s • fine"), (12, "[not a list")],
    'SELECT CAST(doc_id + 1000 AS INT) AS vid, text AS value FROM {documents}',
)

HEADINGS = Relation(
    "fixture_headings",
    "hid int, line string",
    [(1, "SECTION II - LIABILITY"), (2, "section iv: duties -"), (3, "Mixed Case stays"), (4, "  HO  "), (5, "ABC DEFG hi"), (6, "US AND CANADA"), (7, ":-"), (8, "coverages")],
    "SELECT CAST(doc_id + 1000 AS INT) AS hid, explode(split(text, '\\n')) AS line FROM {documents}",
)
