"""Quality rules: a decision list learned by sequential covering.

Every document gets a fixed set of statistics.  On a bounded sample of labelled rows the
learner repeatedly grows a conjunction of threshold tests that picks low quality rows (the
gain in information over the rows covered decides each test), prunes it on rows held back,
and removes the rows that it covers.  The list is emitted as ordered Spark ``CASE WHEN``
conditions; rows that no rule rejects are kept.

Null text counts as empty (no words, base test failed).  Without labelled rows of both kinds
no rule is learned.  Repeated rows are kept; extra columns, whatever their names, are ignored; an empty table gives
no rows.  Of tests with equal gain the first by statistic and cut is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import batches
from gleaner.llm.features import bounded_labels, labelled_rows

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 5
MAX_LABELLED = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capital", "n_short")
#: Ratios that rules may test, as SQL over the counts.
STATS = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "distinct_ratio": "n_distinct / greatest(n_words, 1)",
    "capital_ratio": "n_capital / greatest(n_words, 1)",
    "short_ratio": "n_short / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else ([text] if n else [])
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            often, reach = Counter(windows), 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + WINDOW - max(reach, i)
                    reach = i + WINDOW
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(set(words)),
        sum(map(bytes.isupper, words)),
        sum([len(w) < 3 for w in words]),
    )


def count_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames):
        columns = list(zip(*map(text_counts, batch.column(1).to_pylist()))) or [[]] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS])


def document_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each whole text; a narrow map."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count_rows, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


@dataclass(frozen=True)
class Test:
    """``stat >= cut`` or ``stat < cut``."""

    stat: str
    at_least: bool
    cut: float

    def holds(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        return stats[self.stat] >= self.cut if self.at_least else stats[self.stat] < self.cut

    def sql(self) -> str:
        return f"({STATS[self.stat]}) {'>=' if self.at_least else '<'} {self.cut!r}D"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def covers(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        mask = np.ones(len(next(iter(stats.values()))), bool)
        for t in self.tests:
            mask &= t.holds(stats)
        return mask

    def sql(self) -> str:
        return " AND ".join(t.sql() for t in self.tests)


def _best_test(stats: dict[str, np.ndarray], bad: np.ndarray, mask: np.ndarray, cuts: int) -> tuple[float, Test | None]:
    """The test with the highest gain on the rows that ``mask`` still covers."""
    p0, n0 = int(bad[mask].sum()), int(mask.sum())
    base, best = np.log2(max(p0, 1) / max(n0, 1)), (0.0, None)
    for name, values in stats.items():
        v, y = values[mask], bad[mask]
        for cut in np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1], method="lower")):
            high = v >= cut
            for at_least, side in ((True, high), (False, ~high)):
                p = int(y[side].sum())
                if p and (gain := p * (np.log2(p / side.sum()) - base)) > best[0] + 1e-9:
                    best = gain, Test(name, at_least, float(cut))
    return best


def learn(stats: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_tests: int = 3, least_precision: float = 0.8, least_cover: int = 5, cuts: int = 48) -> list[Rule]:
    """Rules that pick ``bad`` rows, in the order in which they were learned.

    Every third row is held back for pruning.  A rule is kept if it is right for
    ``least_precision`` of the rows that it covers in each part, and covers ``least_cover``.
    """
    hold = np.arange(len(bad)) % 3 == 2
    left, rules = np.ones(len(bad), bool), []
    right = lambda m: (bad[m].mean() if m.any() else 0.0)
    for _ in range(max_rules):
        grow, tests = left & ~hold, ()
        if bad[grow].sum() < least_cover:
            break
        while len(tests) < max_tests and right(grow) < 1.0:
            _, test = _best_test(stats, bad, grow, cuts)
            if test is None:
                break
            tests += (test,)
            grow = grow & test.holds(stats)
        worth = lambda ts: (lambda m: (bad[m].sum() - (~bad[m]).sum()) / max(m.sum(), 1))(Rule(ts).covers(stats) & left & hold)
        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        if not tests:
            break
        covered = Rule(tests).covers(stats) & left
        if covered.sum() < least_cover or right(covered & ~hold) < least_precision or ((covered & hold).any() and right(covered & hold) < least_precision):
            break
        rules.append(Rule(tests))
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learns the list on at most ``max_labelled`` labelled documents."""
    sample = [tuple(r) for r in bounded_labels(labels, ["quality"], max_labelled).collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    rows = sorted(labelled_rows(docs, sample, count_rows, schema), key=tuple)
    known = dict(sample)
    rows = [r for r in rows if r[0] in known]
    bad = np.array([known[r[0]] != 1 for r in rows], bool)
    if not len(rows) or bad.all() or not bad.any():
        return []
    c = dict(zip(COUNTS, np.array([tuple(r)[1:] for r in rows], float).T))
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    top = {"word_length": "word_chars", "symbol_ratio": "n_symbols", "repeat_ratio": "n_repeat_words", "distinct_ratio": "n_distinct", "capital_ratio": "n_capital", "short_ratio": "n_short"}
    stats = {"n_words": c["n_words"]} | {k: c[v] / words for k, v in top.items()} | {"dup_line_ratio": c["n_dup_lines"] / lines, "line_words": c["n_words"] / lines}
    return learn(stats, bad)


def verdict(rules: list[Rule]) -> F.Column:
    """The index of the first rule that covers a row, null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules)) + " END").cast("int")


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts of each document, ``base_failed``, ``kept`` and the index of the rule that rejects."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = document_counts(docs).withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
