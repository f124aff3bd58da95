"""Secret scan with DataFrame functions only.

Three fixed rules (assignments, access keys, long hex strings) give the base spans.  The
method adds candidate strings in which some window of ``WINDOW`` characters has a Shannon
entropy over its character class's threshold.  The entropy is ``log2 w - S / w`` with
``S = sum c log2 c``; the counts of the window are kept, and when it slides, ``S`` changes only by the
counts of the character that leaves and the one that enters, so a string is read once.  Strings that an
allow-list pattern matches, or that lie in a base span, are not added.

Null text counts as empty.  Rows keep their number, repeated ones and null ids too; positions are code
points, end exclusive.  The time is linear in the length of a text and in its number of matches.  An empty table
gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import first_free
from gleaner.llm.spans import cut_at, scanned, spans_of, sql_text

KINDS = ("assign", "access", "hex", "entropy")
# The patterns of the base rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

WINDOW = 20
#: An equals sign ends a candidate: a name before it is not part of the value.
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{WINDOW},}}={{0,2}}"
#: Character classes in order, each with the pattern of its strings and the least entropy in bits.
CLASSES = (
    ("digits", "^[0-9]+$", 2.9),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("letters", "^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)$", 3.9),
    ("one case", "^(?:[a-z0-9+/_=-]+|[A-Z0-9+/_=-]+)$", 3.7),
    ("mixed", ".", 3.8),
)
#: Strings that look random but are known not to be secrets.
ALLOWED = (
    r"(?i)(?<![a-z])(?:example|sample|placeholder)(?![a-z])|x{6,}",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)abcdefgh|01234567",
    r"^[-_=+/]+$",
    # possessive, as Java matches a repeated group that could give back by recursion, one frame a repetition
    r"^(?:[A-Za-z]{1,24}+[-_/=])++[A-Za-z]{1,24}+$",
)


#: Code of the first character that a candidate can hold; counts are kept by code from there on.
FIRST_CODE, SLOTS = 43, 80
#: Bits of one count (a window has ``WINDOW`` characters at most) and counts in one 64-bit word.
BITS, PER_WORD = 5, 12


def window_entropy(string: str, window: int = WINDOW) -> str:
    """SQL for the highest entropy, in bits, of any window of a string at least that long.

    The characters become slots, and a fold over them keeps the counts of the window, five bits
    each in a few words: the slot that leaves loses one, the slot that enters gains one.
    """
    table = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 1)) + ")"
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    count = lambda k: f"CAST(shiftright(element_at(c, CAST({k} DIV {PER_WORD} AS INT) + 1), {BITS} * ({k} % {PER_WORD})) & {2**BITS - 1} AS INT)"
    unit = lambda k, word: f"CASE WHEN {word} = {k} DIV {PER_WORD} THEN shiftleft(1L, {BITS} * ({k} % {PER_WORD})) ELSE 0L END"
    rise = lambda n: f"(element_at({table}, {n} + 2) - element_at({table}, {n} + 1))"
    # a slot that leaves as it enters changes nothing; else the two counts are not the same
    filled = f"named_struct('s', a.s + {rise(count('k'))}, 'c', transform(c, (w, i) -> w + {unit('k', 'i')}))"
    slid = f"named_struct('s', a.s + {rise(count('k'))} - {rise('(' + count('o') + ' - 1)')}, 'c', transform(c, (w, i) -> w + {unit('k', 'i')} - {unit('o', 'i')}))"
    moved = let("element_at(t, a.j - %d)" % (window - 1), "o", f"CASE WHEN o = k THEN named_struct('s', a.s, 'c', c) ELSE {slid} END")
    step = let(let("a.c", "c", f"CASE WHEN a.j < {window} THEN {filled} ELSE {moved} END"), "n", f"named_struct('j', a.j + 1, 's', n.s, 'least', CASE WHEN a.j >= {window - 1} THEN least(a.least, n.s) ELSE a.least END, 'c', n.c)")
    zero = f"named_struct('j', 0, 's', 0D, 'least', CAST('Infinity' AS DOUBLE), 'c', array_repeat(0L, {-(-SLOTS // PER_WORD)}))"
    slots = f"transform(split({string}, ''), x -> ascii(x) - {FIRST_CODE})"
    return let(slots, "t", f"aggregate(t, {zero}, (a, k) -> {step}, a -> {math.log2(window)!r}D - a.least / {window}D)")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``(id, base, found)``: arrays of ``(start, kind, end)`` sorted by start, then kind as listed."""
    t = first_free(docs.columns, "t")
    df = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias(t))
    rules = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("candidate", CANDIDATE))
    for name, pattern in rules:
        found, rest = cut_at(t, pattern)
        df = df.withColumns({f"{name}_m": found, f"{name}_p": rest})
    keep = {
        "assign": f"length(regexp_extract(x, {sql_text(ASSIGN)}, 2)) >= {ASSIGN_LEAST}",
        "access": f"length(x) >= {ACCESS_LEAST}",
        "hex": "true",
    }
    entropy = window_entropy("x")
    bar = "CASE " + " ".join(f"WHEN x RLIKE {sql_text(p)} THEN {bits!r}D" for _, p, bits in CLASSES) + " END"
    fine = " AND ".join(f"NOT x RLIKE {sql_text(p)}" for p in allowed) or "true"
    keep["candidate"] = f"CASE WHEN {fine} THEN {entropy} >= {bar} ELSE false END"
    df = df.withColumns({f"{name}_s": spans_of(f"{name}_m", f"{name}_p", i, keep[name]) for i, (name, _) in enumerate(rules)})
    df = df.withColumn("base", F.expr("array_sort(concat(assign_s, access_s, hex_s))"))
    # a candidate lies in a base span if the furthest end of those that open no later reaches its end
    items = "array_sort(concat(transform(base, b -> named_struct('start', b.start, 'new', 0, 'end', b.end)), transform(candidate_s, c -> named_struct('start', c.start, 'new', 1, 'end', c.end))))"
    element = f"named_struct('start', m.start, 'kind', {KINDS.index('entropy')}, 'end', m.end)"
    outside = scanned(items, "-1", "CASE WHEN m.new = 0 THEN greatest(s, m.end) ELSE s END", element, "m.new = 1 AND s < m.end", "struct<start:int,kind:int,end:int>")
    added = F.expr(f"CASE WHEN size(candidate_s) = 0 THEN candidate_s ELSE {outside} END")
    return df.select(id_column, "base", F.array_sort(F.concat("base", added)).alias("found"))


def spelled(column: str) -> F.Column:
    """Spans as ``kind:start:end`` joined by commas."""
    names = "array(" + ", ".join(map(sql_text, KINDS)) + ")"
    return F.expr(f"array_join(transform({column}, s -> concat_ws(':', element_at({names}, s.kind + 1), s.start, s.end)), ',')")
