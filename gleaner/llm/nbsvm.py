"""Quality classifier: a linear hinge-loss model over naive Bayes scaled n-gram indicators.

Indicators are hashed into ``N_FEATURES`` slots.  Each slot is scaled by the log ratio of its
smoothed share in rows labelled 1 and 0, rows are brought to unit length, and dual
coordinate descent fits a linear support vector machine (hinge loss, cost ``C``).  A
logistic curve fitted to margins of rows held back from the descent turns a margin into a
score between 0 and 1.  The fit uses at most ``max_labelled`` labelled rows, collected as
hashed codes; scoring is a narrow map over all whole texts.

Null text counts as empty: no indicators, so its score is that of the intercept alone.
Without labelled rows of both kinds every score is the share of label 1 (0.5 without rows).
Repeated rows are scored each; where a labelled id is repeated, its least row is learned from, and of
contradicting labels the least.  An empty table gives no rows.  Columns that are kept may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import batches
from gleaner.llm.features import N_FEATURES, bounded_labels, code_rows, indicator_codes, labelled_rows

MAX_LABELLED = 8_000
KEEP_FROM = 0.7
#: Added under the root when rows are brought to unit length.
FLOOR = 20.0


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, codes: np.ndarray) -> float:
        if not len(codes):
            return self.bias
        r = self.ratios[codes]
        return float(r @ self.weights[codes]) / length(r) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicator_codes(text)) + self.offset, -40, 40))))


def length(values: np.ndarray) -> float:
    """Euclidean length, with a floor so that very short texts rest on the intercept."""
    return float(np.sqrt(values @ values + FLOOR))


def log_ratios(rows: list[np.ndarray], positive: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of (share of each indicator in class 1) / (its share in class 0), smoothed."""
    sums = np.full((2, N_FEATURES), alpha, np.float64)
    for codes, y in zip(rows, positive):
        sums[int(y), codes] += 1
    sums /= sums.sum(axis=1, keepdims=True)
    return np.log(sums[1] / sums[0]).astype(np.float32)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and intercept by dual coordinate descent over sparse rows."""
    w, bias = np.zeros(N_FEATURES, np.float32), 0.0
    alpha = np.zeros(len(rows))
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    q = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            g = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[rows[i]] += np.float32(step * y[i]) * values[i]
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, positive: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(h, x.T @ (p - target)), -2, 2)
    return max(float(beta[0]), 1e-3), float(beta[1])


def train(rows: list[np.ndarray], positive: np.ndarray, cost: float = 3.0, epochs: int = 15) -> Model:
    """Fits ratios and weights; every fifth row only fits the curve."""
    n = len(rows)
    if not n or positive.all() or not positive.any():
        share = (positive.sum() + 1) / (n + 2) if n else 0.5
        return Model(np.zeros(N_FEATURES, np.float32), np.zeros(N_FEATURES, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.arange(n) % 5 == 4
    if positive[held].all() or not positive[held].any() or positive[~held].all() or not positive[~held].any():
        held = np.zeros(n, bool)
    ratios = log_ratios([r for r, h in zip(rows, held) if not h], positive[~held])
    values = []
    for codes in rows:
        v = ratios[codes]
        values.append(v / length(v))
    y = np.where(positive, 1.0, -1.0)
    counts = {True: (positive & ~held).sum(), False: (~positive & ~held).sum()}
    weight = np.array([cost * (n - held.sum()) / (2 * counts[bool(p)]) for p in positive])
    fit = np.flatnonzero(~held)
    w, bias = dual_descent([rows[i] for i in fit], [values[i] for i in fit], y[fit], weight[fit], epochs)
    margins = np.array([float(w[r] @ v) + bias for r, v in zip(rows, values)])
    part = held if held.any() else ~held
    slope, offset = logistic_curve(margins[part], positive[part])
    return Model(ratios, w, bias, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", where=None, max_labelled: int = MAX_LABELLED) -> Model:
    """Trains on at most ``max_labelled`` labelled documents for which ``where`` holds."""
    sample = [tuple(r) for r in bounded_labels(labels, [label], max_labelled, where).collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(labelled_rows(docs, sample, code_rows, f"doc_id {kind}, codes binary"), key=lambda r: (r[0], bytes(r[1])))
    known = dict(sample)
    rows = [r for r in rows if r[0] in known]
    codes = [np.frombuffer(bytes(r[1]), np.int32) for r in rows]
    return train(codes, np.array([known[r[0]] == 1 for r in rows], bool))


def scores(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of each row, and the score as ``name``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size: two floats a slot
    names = [f"c{i}" for i in range(len(keep))]
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches(frames):
            found = [m.score(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.float64())], names=[*names, "score"])

    picked = docs.select(F.col("text").alias("whole"), *[F.col(c).alias(n) for n, c in zip(names, keep)])
    out = picked.mapInArrow(run, f"{fields}, score double")
    return out.toDF(*keep, name)


def held_out(id_column: str = "doc_id"):
    """True for the quarter of ids that is never learned from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document."""
    part = F.coalesce(held_out(), F.lit(False))
    model = fit(docs, labels, where=~part, max_labelled=max_labelled)
    out = scores(docs, model, ["doc_id"])
    return out.select("doc_id", part.alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
