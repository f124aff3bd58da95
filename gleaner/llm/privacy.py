"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions only.

One pattern finds candidate values: e-mail addresses, IBANs, IPv4 addresses, dates, social
security numbers, telephone numbers and long account or card numbers.  Each is validated
(mod 97, octet range, calendar, number plan, Luhn) and permuted within its own format:

* strings: both halves take turns; each character of one half moves within its own class
  (digits, lower or upper case letters) by amounts hashed from the other half.  The class
  pattern and all separators stay, and the map is one to one;
* numbers with a check digit keep a right check digit (Luhn, mod 97); a long number whose
  Luhn sum is wrong is permuted as it is and not made right;
* IPv4 addresses: a Feistel network over two 16-bit halves;
* social security numbers: over the 898 areas, 99 groups and 9,999 serial numbers that are valid;
* dates: over the 146,097 days from 1800 to 2199, as pairs from 27 x 5,411.

The permutations depend on the key and the value alone, so equal values stay equal in all
documents.  A null text stays null and an empty one empty; repeated rows and extra columns, whatever their
names, are kept as they are, and an empty table stays empty.  A text is read once, whole, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import first_free
from gleaner.llm.spans import cut_at, sql_text

ROUNDS = 8
#: For tests and public examples; a deployment passes its own.
DEFAULT_KEY = "public example key"

_EDGE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IBAN = _EDGE + r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}" + _END
IP = r"(?<![A-Za-z0-9.])" + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + r"(?![A-Za-z0-9]|\.[0-9])"
DATE = _EDGE + r"(?:[0-9]{4}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-/.])(?:0[1-9]|[12][0-9]|3[01])\2[0-9]{4})" + _END
SSN = _EDGE + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _END
PHONE = r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?|[0-9]{1,4}[ .-])(?:[0-9]{2,4}[ .-]?){1,3}[0-9]{2,4}|\+[0-9]{8,15}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}([-. ])[0-9]{3}\3[0-9]{4})" + _END
NUMBER = _EDGE + r"(?:[0-9]{4}([ -])[0-9]{4}\4[0-9]{4}\4[0-9]{1,7}|[0-9]{12,19})" + _END
VALUE = "|".join((EMAIL, IBAN, IP, DATE, SSN, PHONE, NUMBER))


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it in ``body`` by name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _moved(part: str, other: str, key: str, turn: str) -> str:
    """SQL: each letter and digit of ``part`` moved within its class by a hash of ``other``."""
    rotate = lambda first, n: f"chr({first} + pmod(ascii(c) - {first} + v, {n}))"
    shift = f"CAST(conv(substring(h, 2 * pmod(k - 1, 32) + 1, 2), 16, 10) AS INT) + {turn}"
    one = _let(f"substring({part}, k, 1)", "c", _let(shift, "v", f"CASE WHEN c BETWEEN '0' AND '9' THEN {rotate(48, 10)} WHEN c BETWEEN 'a' AND 'z' THEN {rotate(97, 26)} WHEN c BETWEEN 'A' AND 'Z' THEN {rotate(65, 26)} ELSE c END"))
    moved = f"array_join(transform(sequence(1, length({part})), k -> {one}), '')"
    return f"CASE WHEN length({part}) = 0 THEN '' ELSE {_let(f'sha2(concat_ws(chr(31), {key}, {turn}, length({part}), {other}), 256)', 'h', moved)} END"


def permuted(value: str, key: str) -> str:
    """SQL: the string permuted within its pattern of character classes."""
    lit = sql_text(key)
    turn = f"CASE WHEN i % 2 = 1 THEN named_struct('l', {_moved('s.l', 's.r', lit, 'i')}, 'r', s.r) ELSE named_struct('l', s.l, 'r', {_moved('s.r', 's.l', lit, 'i')}) END"
    halves = "named_struct('l', substring(p, 1, CAST(length(p) / 2 AS INT)), 'r', substring(p, CAST(length(p) / 2 AS INT) + 1))"
    return _let(value, "p", f"aggregate(sequence(1, {ROUNDS}), {halves}, (s, i) -> {turn}, s -> concat(s.l, s.r))")


def _feistel_pair(left: str, right: str, a: int, b: int, key: str) -> str:
    """SQL: a struct (l, r) of integers below ``a`` and ``b``, permuted."""
    lit = sql_text(key)
    hashed = lambda x: f"CAST(conv(substring(sha2(concat_ws(chr(31), {lit}, {a}, {b}, i, {x}), 256), 1, 12), 16, 10) AS BIGINT)"
    turn = f"CASE WHEN i % 2 = 1 THEN named_struct('l', pmod(s.l + {hashed('s.r')}, {a}L), 'r', s.r) ELSE named_struct('l', s.l, 'r', pmod(s.r + {hashed('s.l')}, {b}L)) END"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', {left}, 'r', {right}), (s, i) -> {turn}, s -> s)"


def _luhn_sum(digits: str, doubled: int) -> str:
    """SQL: the Luhn sum; ``doubled`` is the parity, from the right and from 1, of doubled places."""
    one = _let(f"CAST(substring(reverse({digits}), k, 1) AS INT)", "d", f"CASE WHEN k % 2 = {doubled} THEN CASE WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END ELSE d END")
    return f"aggregate(transform(sequence(1, length({digits})), k -> {one}), 0, (n, d) -> n + d)"


def _mod97(string: str) -> str:
    """SQL: a string of digits and capitals (A is 10) as a number, mod 97."""
    place = "CASE WHEN c BETWEEN 'A' AND 'Z' THEN (m * 100 + ascii(c) - 55) % 97 ELSE (m * 10 + ascii(c) - 48) % 97 END"
    return f"aggregate(transform(sequence(1, length({string})), k -> substring({string}, k, 1)), 0, (m, c) -> {place})"


def _number(x: str, key: str) -> str:
    plain = "regexp_replace(n, '[^0-9]', '')"
    body = _let(permuted("substring(n, 1, length(n) - 1)", key), "b", _let("regexp_replace(b, '[^0-9]', '')", "g", f"concat(b, pmod(10 - {_luhn_sum('g', 1)} % 10, 10))"))
    return _let(x, "n", _let(plain, "d", f"CASE WHEN {_luhn_sum('d', 0)} % 10 = 0 THEN {body} ELSE {permuted('n', key)} END"))


def _iban(x: str, key: str) -> str:
    inner = _let(permuted("substring(n, 5)", key), "b", _let("substring(n, 1, 2)", "c2", f"concat(c2, lpad(CAST(98 - {_mod97('concat(b, c2, chr(48), chr(48))')} AS STRING), 2, '0'), b)"))
    return _let(x, "n", f"CASE WHEN {_mod97('concat(substring(n, 5), substring(n, 1, 4))')} = 1 THEN {inner} ELSE n END")


def _ip(x: str, key: str) -> str:
    octet = lambda i: f"CAST(element_at(o, {i}) AS BIGINT)"
    pair = _feistel_pair(f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", 65536, 65536, key)
    return _let(f"split({x}, '[.]')", "o", _let(pair, "q", "concat_ws('.', q.l DIV 256, q.l % 256, q.r DIV 256, q.r % 256)"))


def _date(x: str, key: str) -> str:
    """Year first, else day first where that is a date, else month first."""
    low, small, large = "DATE'1800-01-01'", 27, 5411

    def made(form: str) -> str:
        pair = _feistel_pair(f"CAST(datediff(d, {low}) DIV {large} AS BIGINT)", f"CAST(datediff(d, {low}) % {large} AS BIGINT)", small, large, key)
        return _let(pair, "q", f"date_format(date_add({low}, CAST(q.l * {large} + q.r AS INT)), {form})")

    mark = "CASE WHEN n RLIKE '^[0-9]{4}' THEN substring(n, 5, 1) ELSE substring(n, 3, 1) END"
    forms = "CASE WHEN n RLIKE '^[0-9]{4}' THEN concat_ws(m, 'yyyy', 'MM', 'dd') WHEN try_to_date(n, concat_ws(m, 'dd', 'MM', 'yyyy')) IS NOT NULL THEN concat_ws(m, 'dd', 'MM', 'yyyy') ELSE concat_ws(m, 'MM', 'dd', 'yyyy') END"
    body = _let("try_to_date(n, f)", "d", f"CASE WHEN d BETWEEN {low} AND DATE'2199-12-31' THEN {made('f')} ELSE n END")
    return _let(x, "n", _let(mark, "m", _let(forms, "f", body)))


def _ssn(x: str, key: str) -> str:
    area, skip = "CAST(substring(n, 1, 3) AS BIGINT)", 666  # an area that is not given out
    left = f"({area} - CASE WHEN {area} > {skip} THEN 2 ELSE 1 END) * 99 + CAST(substring(n, 5, 2) AS BIGINT) - 1"
    pair = _feistel_pair(left, "CAST(substring(n, 8) AS BIGINT) - 1", 898 * 99, 9999, key)
    new = f"q.l DIV 99 + CASE WHEN q.l DIV 99 >= {skip - 1} THEN 2 ELSE 1 END"
    padded = lambda value, n: f"lpad(CAST({value} AS STRING), {n}, '0')"
    return _let(x, "n", _let(pair, "q", f"concat_ws('-', {padded(new, 3)}, {padded('q.l % 99 + 1', 2)}, {padded('q.r + 1', 4)})"))


def _pseudonym(x: str, key: str) -> str:
    at = "instr(x, '@')"
    phone = _let("regexp_extract(x, '^[+][0-9]{1,3}', 0)", "cc", f"concat(cc, {permuted('substring(x, length(cc) + 1)', key)})")
    whole = lambda p: sql_text(f"^(?:{p})$")
    return f"""CASE WHEN {at} > 0 THEN concat({permuted(f'substring(x, 1, {at} - 1)', key)}, substring(x, {at}))
        WHEN {x} RLIKE '^[A-Z]' THEN {_iban(x, key)}
        WHEN {x} RLIKE {whole(IP)} THEN {_ip(x, key)}
        WHEN {x} RLIKE {whole(DATE)} THEN {_date(x, key)}
        WHEN {x} RLIKE {whole(SSN)} THEN {_ssn(x, key)}
        WHEN {x} RLIKE '^[0-9]{{4}}([ -])[0-9]{{4}}|^[0-9]{{12,19}}$' THEN {_number(x, key)}
        ELSE {phone} END"""


def pseudonymise(docs: DataFrame, text_column: str = "text", key: str = DEFAULT_KEY, count_column: str | None = None) -> DataFrame:
    """Replaces the values in ``text_column``; ``count_column`` adds how many were found."""
    m, p = (first_free(docs.columns, n) for n in ("found_values", "between_values"))
    found, rest = cut_at(f"`{text_column}`", VALUE)
    has = F.col(text_column).rlike("[0-9@]")
    df = docs.withColumn(m, F.when(has, found)).withColumn(p, F.when(has, rest))
    new = F.expr(f"array_join(flatten(zip_with(`{p}`, concat(transform(`{m}`, x -> {_pseudonym('x', key)}), array('')), (a, b) -> array(a, b))), '')")
    out = df.withColumn(text_column, F.when(F.size(F.coalesce(F.col(m), F.array())) > 0, new).otherwise(F.col(text_column)))
    if count_column:
        out = out.withColumn(count_column, F.size(F.coalesce(F.col(m), F.array())).cast("bigint"))
    return out.drop(m, p)
