"""Match positions in DataFrame functions: a text split at a pattern, and the matches between."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,kind:int,end:int>>"


def sql_text(value: str) -> str:
    """``value`` as a SQL literal that is taken as it stands."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cut_at(text: str, pattern: str) -> tuple[Column, Column]:
    """Columns for the matches of a pattern and for the pieces between them (one more)."""
    lit = sql_text(pattern)
    found = F.expr(f"CASE WHEN {text} RLIKE {lit} THEN regexp_extract_all({text}, {lit}, 0) ELSE CAST(array() AS array<string>) END")
    rest = F.expr(f"CASE WHEN {text} RLIKE {lit} THEN split({text}, {lit}, -1) ELSE array({text}) END")
    return found, rest


#: Items that a scan holds in one growing array; the arrays of all chunks are joined once.
CHUNK = 256


def scanned(items: str, zero: str, merge: str, element: str, keep: str, kind: str) -> str:
    """SQL: a running fold over an array that returns elements, in time linear in its length.

    The state ``s`` begins as ``zero`` and becomes ``merge`` with each item ``m``; where ``keep`` holds,
    ``element`` (of type ``kind``) is returned, made from the state before the item.  Growing one array item
    by item would copy it each time, so chunks are folded for their states first and returned on their own.
    """
    chunks = f"transform(sequence(0, CAST((size(i) - 1) DIV {CHUNK} AS INT)), c -> slice(i, c * {CHUNK} + 1, {CHUNK}))"
    begins = f"aggregate(h, named_struct('at', {zero}, 'out', array()), (a, g) -> named_struct('at', aggregate(g, a.at, (s, m) -> {merge}), 'out', concat(a.out, array(a.at))), a -> a.out)"
    empty = f"CAST(array() AS array<{kind}>)"
    begins = begins.replace("array())", f"slice(array({zero}), 1, 0))")
    one = f"aggregate(g, named_struct('at', b, 'out', {empty}), (a, m) -> named_struct('at', element_at(transform(array(a.at), s -> {merge}), 1), 'out', CASE WHEN element_at(transform(array(a.at), s -> {keep}), 1) THEN concat(a.out, transform(array(a.at), s -> {element})) ELSE a.out END), a -> a.out)"
    body = f"element_at(transform(array({chunks}), h -> flatten(zip_with(h, {begins}, (g, b) -> {one}))), 1)"
    return f"element_at(transform(array({items}), i -> {body}), 1)"


def spans_of(matches: str, pieces: str, kind: int, keep: str) -> Column:
    """Code point spans, end exclusive, of the matches ``x`` for which ``keep`` holds."""
    items = f"zip_with({matches}, slice({pieces}, 1, size({matches})), (x, y) -> named_struct('gap', length(y), 'len', length(x), 'ok', {keep}))"
    element = f"named_struct('start', s + m.gap, 'kind', {kind}, 'end', s + m.gap + m.len)"
    return F.expr(scanned(items, "0", "s + m.gap + m.len", element, "m.ok", "struct<start:int,kind:int,end:int>"))
