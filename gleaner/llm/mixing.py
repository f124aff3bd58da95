"""Soft-membership mixing of sources to target token weights.

Domains come from the labelled table: ``toxic`` (toxic 1), ``poor`` (quality 0) and
``clean``.  A one-against-rest classifier fitted on a bounded sample gives each document a
posterior over the domains.  With ``n`` tokens and posterior ``p``, a document at rate ``r``
adds ``n * r * p[d]`` expected tokens to domain ``d``.  Rates minimise

    F(r) = 1/2 sum_d (A[d] - T[d])^2 / S[d] + NEAR/2 sum_i n_i (r_i - 1)^2,   A[d] = sum_i n_i r_i p_i[d]

over ``least_i <= r_i <= most``; ``S`` are the totals at rate 1.  The small second term picks,
of all rates that meet the targets (or come as near as the bounds allow), those nearest to 1.
A row that is in the anchored domain more likely than not has the bound ``least`` 1, all others 0;
as it is part of the fit, the other rows make up for it, and copies follow the rates alone.
The optimum has the form ``r = clip(1 - p . z)`` with one number ``z[d]`` a domain, found by
Newton steps on the dual: an iteration reads the posteriors (a table of a few numbers a
document) and sums ten numbers.  It ends when the dual's gradient is zero to ``TOLERANCE``,
and says so if it does not.

Null text counts as empty (no tokens; its rate follows its posterior and changes no total).
Repeated rows each have a rate, and equal ones the same draw.  Without labels all mass is ``clean``; an empty table
gives no rows.  Columns other than ``doc_id`` and ``text`` are not read, and ``mix_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import nbsvm
from gleaner.llm.common import batches, cut, first_free, row_key, shared_dir
from gleaner.llm.features import REPEATED, SHARES, bounded_labels, labelled_rows, word_codes

DOMAINS = ("clean", "poor", "toxic")
MAX_LABELLED = 8_000
#: Target shares of expected tokens; the anchor keeps the tokens that it has.
WEIGHTS = {"clean": 0.97, "poor": 0.02, "toxic": 0.01}
ANCHOR = "clean"
ITERATIONS, TOLERANCE = 40, 1e-4
#: Weight of the rates' distance from 1 beside that of the totals from their targets.
NEAR = 1e-4
#: Dual evaluations before the fit gives up, with a warning.
EVALUATIONS = 200
#: From this posterior of the anchor on, a row has a rate of 1 at least.
CERTAIN = 0.5
SYMBOLS = "#*$%&|!"


def codes(text: str | None) -> np.ndarray:
    """Word indicators, marks for repeated neighbours and for symbols that are frequent."""
    text = text or ""
    words = text.split()
    twice = sum(map(str.__eq__, words, words[1:]))
    marks = [REPEATED + i for i, share in enumerate(SHARES) if twice > share * len(words)]
    base = REPEATED + len(SHARES)
    marks += [base + i for i, c in enumerate(SYMBOLS) if text.count(c) > 0.02 * len(words)]
    return np.concatenate([word_codes(text), np.array(marks, np.int64)])


def code_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(frames):
        packed = [codes(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "codes"])


@dataclass
class Posterior:
    """One model a domain that has labelled rows; scores are brought to a sum of one."""

    models: dict[str, nbsvm.Model]

    def of(self, text: str | None) -> list[float]:
        if not self.models:
            return [1.0 if d == ANCHOR else 0.0 for d in DOMAINS]
        c = codes(text)
        s = []
        for d in DOMAINS:
            m = self.models.get(d)
            s.append(float(1 / (1 + np.exp(-np.clip(m.slope * m.margin(c) + m.offset, -40, 40)))) if m else 0.0)
        total = sum(s)
        return [x / total for x in s] if total else [1 / len(DOMAINS)] * len(DOMAINS)


def domain_of(quality: int, toxic: int) -> str:
    return "toxic" if toxic == 1 else "clean" if quality == 1 else "poor"


def fit_posterior(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Posterior:
    """Fits the domain models on at most ``max_labelled`` labelled documents."""
    sample = [tuple(r) for r in bounded_labels(labels, ["quality", "toxic"], max_labelled).collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(labelled_rows(docs, sample, code_rows, f"doc_id {kind}, codes binary"), key=lambda r: (r[0], bytes(r[1])))
    known = {s[0]: domain_of(s[1], s[2]) for s in sample}
    rows = [r for r in rows if r[0] in known]
    found = np.array([known[r[0]] for r in rows])
    packed = [np.frombuffer(bytes(r[1]), np.int32) for r in rows]
    return Posterior({d: nbsvm.train(packed, found == d) for d in DOMAINS if len(rows) and (found == d).any()})


def posteriors(docs: DataFrame, model: Posterior) -> DataFrame:
    """``doc_id, row_key, n_tokens, p_<domain>...``; tokens are words; a narrow map."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: two floats a slot and domain
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row_key", "n_tokens", *(f"p_{d}" for d in DOMAINS)]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            texts = batch.column(2).to_pylist()
            p = np.array([shared.value.of(t) for t in texts]).reshape(-1, len(DOMAINS))
            tokens = pa.array([len((t or "").split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens, *(pa.array(p[:, i]) for i in range(len(DOMAINS)))], names=names)

    schema = f"doc_id {kind}, row_key bigint, n_tokens bigint, " + ", ".join(f"p_{d} double" for d in DOMAINS)
    return docs.select("doc_id", row_key().alias("row_key"), F.col("text").alias("text")).mapInArrow(run, schema)


def replayed(gradients: list[list[float]]):
    """The rate of a row after these gradients."""
    if not gradients:
        return F.lit(1.0)
    steps = ", ".join("array(" + ", ".join(f"{g!r}D" for g in step) + ")" for step in gradients)
    dot = " + ".join(f"p_{d} * g[{i}]" for i, d in enumerate(DOMAINS))
    return F.expr(f"aggregate(array({steps}), 1D, (r, g) -> greatest(0D, r - ({dot})))")


@dataclass
class Fit:
    gradients: list[list[float]]
    targets: dict[str, float]
    totals: dict[str, float]


def fit_rates(members: DataFrame, weights: dict[str, float] | None = None, anchor: str = ANCHOR) -> Fit:
    """Plain projected gradient from r = 1 with r >= 0 only; ``closest_rates`` is what the mix uses."""
    weights = weights or WEIGHTS
    of = lambda r: [r[f"a_{d}"] or 0.0 for d in DOMAINS]
    total = lambda rate: of(members.agg(*[F.sum(F.col("n_tokens") * rate * F.col(f"p_{d}")).alias(f"a_{d}") for d in DOMAINS]).first())
    start = total(F.lit(1.0))
    budget = start[DOMAINS.index(anchor)] / weights[anchor]
    target = [budget * weights.get(d, 0.0) for d in DOMAINS]
    gradients: list[list[float]] = []
    now = start
    for _ in range(ITERATIONS):
        if max(abs(a - t) for a, t in zip(now, target)) <= TOLERANCE * max(sum(target), 1.0):
            break
        gradients.append([(a - t) / s if s > 0 else 0.0 for a, t, s in zip(now, target, start)])
        now = total(replayed(gradients))
    return Fit(gradients, dict(zip(DOMAINS, target)), dict(zip(DOMAINS, now)))


def least_rate():
    """The lower bound of a row's rate."""
    return F.when(F.col(f"p_{ANCHOR}") >= CERTAIN, F.lit(1.0)).otherwise(F.lit(0.0))


def rate_of(z: list[float], most: float):
    """The rate of a row at the dual point ``z``."""
    dot = " + ".join(f"p_{d} * {x!r}D" for d, x in zip(DOMAINS, map(float, z)))
    return F.least(F.lit(float(most)), F.greatest(least_rate(), F.expr(f"1D - ({dot})")))


@dataclass
class Rates:
    z: list[float]
    targets: dict[str, float]
    totals: dict[str, float]
    #: The largest component of the dual's gradient, in tokens; zero at the optimum.
    error: float


def closest_rates(members: DataFrame, weights: dict[str, float] | None = None, anchor: str = ANCHOR, most: float = float("inf")) -> Rates:
    """The optimal rates between ``least_rate`` and ``most``, by damped Newton steps on the dual."""
    weights, n, k = weights or WEIGHTS, F.col("n_tokens"), len(DOMAINS)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def at(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, their slope, and the rows' part of the dual."""
        rate = F.col("rate")
        rows = members.withColumn("rate", rate_of(list(z), most)).withColumn("dot", sum((c * float(x) for c, x in zip(p, z)), F.lit(0.0)))
        free = ((rate > least_rate()) & (rate < most)).cast("double")
        sums = [n * rate * c for c in p] + [n * free * p[i] * p[j] for i, j in pairs] + [n * (-F.col("dot") * rate - (rate - 1) * (rate - 1) / 2)]
        found = [x or 0.0 for x in rows.agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(sums)]).first()]
        slope = np.zeros((k, k))
        for (i, j), x in zip(pairs, found[k:-1]):
            slope[i, j] = slope[j, i] = x
        return np.array(found[:k]), slope, found[-1]

    z = np.zeros(k)
    now, slope, part = at(z)
    start = now  # all rates are 1
    budget = start[DOMAINS.index(anchor)] / weights[anchor]
    target = np.array([budget * weights.get(d, 0.0) for d in DOMAINS])
    here = start > 0
    aim = np.where(here, target, 0.0)  # nothing can add to a domain without tokens
    dual = lambda z, part: NEAR / 2 * (start * z * z).sum() + aim @ z + part
    value, used = dual(z, part), 1
    enough = TOLERANCE * 1e-2 * max(target.sum(), 1.0)
    while True:
        gradient = NEAR * start * z + aim - now
        error = float(np.abs(gradient).max())
        if error <= enough or used >= EVALUATIONS:
            break
        step = -np.linalg.lstsq(slope + NEAR * np.diag(start), gradient, rcond=None)[0]
        size = 1.0
        while used < EVALUATIONS:
            now, slope, part = at(z + size * step)
            used += 1
            if dual(z + size * step, part) <= value + 1e-4 * size * (gradient @ step) + 1e-12 * abs(value):
                break
            size /= 2
        z = z + size * step
        value = dual(z, part)
    if error > enough:
        warnings.warn(f"The rates are not optimal: the dual's gradient is {error:.3g} tokens of {target.sum():.3g}", stacklevel=2)
    return Rates([float(x) for x in z], dict(zip(DOMAINS, map(float, target))), dict(zip(DOMAINS, map(float, now))), error)


def copies():
    """How many copies of a row its rate gives: its whole part, and a hashed draw for the rest."""
    r = F.col("rate")
    draw = F.pmod(F.xxhash64("row_key", F.lit("mix")), F.lit(1 << 24)) / float(1 << 24)
    return (F.floor(r) + (draw < r - F.floor(r)).cast("int")).cast("bigint")


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, most: float = float("inf")) -> DataFrame:
    """Posteriors, ``rate`` (``most`` at most) and ``copies`` of each document."""
    folder = shared_dir(docs.sparkSession)
    members = cut(posteriors(docs, fit_posterior(docs, labels)), folder, "posteriors")
    fit = closest_rates(members, weights, most=most)
    return members.withColumn("rate", rate_of(fit.z, most)).withColumn("copies", copies())


def mix_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with their columns.

    Rows are kept or go, as the mix is for a corpus without duplicates; so rates are fitted
    with 1 as their upper bound, and what is kept has the fitted totals in expectation.
    The join is on a hash of id and text.
    """
    gone = first_free(docs.columns, "gone_key")
    chosen = mixed(docs, labels, weights, most=1.0).where("copies = 0").select(F.col("row_key").alias(gone)).distinct()
    return docs.join(chosen, row_key() == F.col(gone), "left_anti")
