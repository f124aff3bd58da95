"""Set operations over corpora: dedup, decontamination, isolation, leakage and validation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.functions import text as T
from gleaner.operators.contained import contained_passages  # noqa: F401
from gleaner.operators.order import in_order


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``, numbered anew from 1 in that order by key hash."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def merged_copies(docs: DataFrame, key, ident: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each normalised text: its hash, the least id, all ids' number and sources."""
    keyed = docs.select(F.sha2(key, 256).alias("key"), ident, source)
    return keyed.groupBy("key").agg(F.min(ident).alias(ident), F.count("*").alias("copies"), F.sort_array(F.collect_set(source)).alias("sources"))


def isolated(rows: DataFrame, held: DataFrame, ids: str, text: str, source: str) -> DataFrame:
    """Rows that share no id, no normalised text and no source with the held-out ones."""
    key = lambda df: df.withColumn("_key", T.alnum_key(F.col(text)))
    out = key(rows).join(held.select(ids), ids, "left_anti").join(key(held).select("_key"), "_key", "left_anti")
    return out.join(held.select(source), source, "left_anti").drop("_key")


def source_closure(rows: DataFrame, start: DataFrame) -> DataFrame:
    """Ids of the starting sources, and of every row that shares a text with one of those."""
    of_source = rows.join(start, "source", "left_semi")
    return rows.join(of_source.select("text"), "text", "left_semi").select("doc_id").distinct()


def seeded(seed: str, column: str):
    """The hash by which groups are shuffled; it depends on nothing but the seed and the name."""
    return F.sha2(F.concat_ws("|", F.lit(seed), F.col(column).cast("string")), 256)


def hash_split(groups: DataFrame, seed: str, shares: tuple[float, float] = (0.5, 0.25), column: str = "source") -> DataFrame:
    """Groups in the order of a seeded hash, cut at rounded shares (half to even); any number of groups."""
    placed, n = in_order(groups, [seeded(seed, column), F.asc(column)])
    first, second = round(n * shares[0]), round(n * (shares[0] + shares[1]))
    return placed.withColumn("split", F.when(F.col("place") <= first, "train").when(F.col("place") <= second, "valid").otherwise("test"))


def cumulative_split(counts: DataFrame, seed: str, column: str, share: float, least: int = 40, rest: int = 10) -> DataFrame:
    """``column, n, split``: groups in a seeded order are for validation until they have enough examples, then for the test.

    ``counts``: a group and its number ``n`` of examples.  Enough is ``share`` of all, at least ``least`` and at most all but
    ``rest``; a group is taken whole, and the last one is always for the test.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    target = min(max(int(total * share), least), max(1, total - rest))
    placed, groups = in_order(counts.select(column, "n"), [seeded(seed, column), F.asc(column)], ["n"])
    valid = (F.col("n_before") < target) & (F.col("place") < groups)
    return placed.select(column, "n", F.when(valid, "valid").otherwise("test").alias("split"))


#: Pairs of texts that a task compares before it hands their changes on.
COMPARED = 64


def _sentence_map(texts: bool):
    """An Arrow map from ``(key, old, new)`` to changes, ``COMPARED`` pairs at a time."""
    import difflib
    import re

    split = lambda t: [s.strip() for s in re.split(r"(?<=[.!?])\s+", (t or "").strip()) if s.strip()] or [(t or "").strip()]

    def changes(key, old, new):
        a, b = split(old), split(new)
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=True).get_opcodes():
            left, right = a[i1:i2], b[j1:j2]
            if op == "equal":
                yield from ((key, "unchanged", s, s, 1.0) for s in left)
                continue
            yield from ((key, "modified", x, y, difflib.SequenceMatcher(None, x, y).ratio()) for x, y in zip(left, right))
            yield from ((key, "removed", x, "", 0.0) for x in left[len(right) :])
            yield from ((key, "added", "", y, 0.0) for y in right[len(left) :])

    fields = [("key", pa.int64()), ("change", pa.string()), ("old", pa.string()), ("new", pa.string()), ("score", pa.float64())]
    kept = [i for i, (name, _) in enumerate(fields) if texts or name not in ("old", "new")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, COMPARED):
                rows = [r for pair in zip(*(c.to_pylist() for c in frame.slice(at, COMPARED).columns)) for r in changes(*pair)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], fields[i][1]) for i in kept], names=[fields[i][0] for i in kept])

    return run


def sentence_changes(pairs: DataFrame, texts: bool = True) -> DataFrame:
    """Rows ``(key, old, new)`` to sentence changes by the standard library's matcher; the sentences stay out if not asked for.

    ``difflib``'s ratio has no column expression, so this is an Arrow-batched Python map.
    """
    schema = "key bigint, change string, old string, new string, score double" if texts else "key bigint, change string, score double"
    return pairs.select("key", "old", "new").mapInArrow(_sentence_map(texts), schema)


def line_differences(pairs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Lines, trimmed and with one of the words, that stand on one side alone."""
    lines = lambda c: F.array_distinct(T.lines(F.col(c)))
    kept = (lambda arr: arr) if not words else (lambda arr: F.filter(arr, lambda x: F.lower(x).rlike("|".join(words))))
    change = lambda kind, a, b: F.transform(F.array_except(kept(lines(a)), kept(lines(b))), lambda x: F.struct(F.lit(kind).alias("change"), x.alias("line")))
    return pairs.select("key", F.explode(F.concat(change("added", "new", "old"), change("removed", "old", "new"))).alias("c")).select("key", "c.change", "c.line")


# The words that place a changed line in a group, groups in the order of the summary.
POLICY_GROUPS = {
    "deductible": ["deductible"],
    "coverage": ["coverage", "limit", "liability"],
    "endorsement": ["endorsement", "rider"],
    "exclusion": ["exclusion", "excludes"],
    "duties": ["insured must", "duties", "after a loss", "promptly notify"],
}


def policy_changes(pairs: DataFrame) -> DataFrame:
    """``key``, the number of changed lines in each group (a line may be in several) and a summary sentence."""
    alone = lambda a, b: F.array_except(T.lines(F.col(a)), T.lines(F.col(b)))
    changed = pairs.select("key", F.concat(alone("new", "old"), alone("old", "new")).alias("lines"))
    counts = {g: F.size(F.filter("lines", lambda x: F.lower(x).rlike("|".join(words)))).cast("bigint") for g, words in POLICY_GROUPS.items()}
    rows = changed.select("key", *[c.alias(g) for g, c in counts.items()])
    names = F.concat_ws(", ", *[F.when(F.col(g) > 0, F.lit(g)) for g in counts])
    none = F.lit("No material policy-rule changes detected.")
    return rows.withColumn("summary", F.when(names == "", none).otherwise(F.concat(F.lit("Detected changes in: "), names, F.lit("."))))


def training_groups(positives: DataFrame, negatives: DataFrame, presentations: int, quotas: dict[str, int], size: int = 5) -> DataFrame:
    """``(gid, presentation, slot, id)``: one positive (slot 0) and ``size`` negatives for each presentation.

    ``positives``: gid, id, taken in turn by id.  ``negatives``: gid, id, kind, distinct ids; each kind gives up to
    its quota, and what is then missing comes from all that is left.  Picks follow a hash of presentation, group and
    id, so they can be repeated.  A group without a positive or with fewer than ``size`` other negatives gives no rows.
    """
    turn = F.explode(F.sequence(F.lit(0), F.lit(presentations - 1))).alias("presentation")
    group = Window.partitionBy("gid")
    first = positives.select("gid", "id").distinct().withColumn("k", F.row_number().over(group.orderBy("id")) - 1).withColumn("n", F.count("*").over(group))
    first = first.select("gid", "id", "k", "n", turn).where(F.col("k") == F.col("presentation") % F.col("n"))
    rest = negatives.join(positives.select("gid", "id"), ["gid", "id"], "left_anti").select("gid", "id", "kind", turn)
    rest = rest.withColumn("h", F.sha2(F.concat_ws("|", "presentation", "gid", "id"), 256))
    quota = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in quotas.items()], F.lit(0))
    rest = rest.withColumn("own", F.row_number().over(Window.partitionBy("gid", "presentation", "kind").orderBy("h")) > quota)
    rest = rest.withColumn("slot", F.row_number().over(Window.partitionBy("gid", "presentation").orderBy("own", "h"))).where(F.col("slot") <= size)
    rows = first.select("gid", "presentation", F.lit(0).alias("slot"), "id").unionByName(rest.select("gid", "presentation", "slot", "id"))
    span = Window.partitionBy("gid", "presentation")
    whole = rows.withColumn("n", F.count("*").over(span)).withColumn("least", F.min("slot").over(span))
    return whole.where((F.col("n") == size + 1) & (F.col("least") == 0)).drop("n", "least")


def negative_confidence(score, positive, margin: float = 1.0):
    """.25 for a negative that a teacher scores within ``margin`` of the positive or above it, else 1."""
    return F.when(score >= positive - margin, 0.25).otherwise(1.0)


def split_sizes(n: int, train: float = 0.8, valid: float = 0.1) -> tuple[int, int]:
    """How many of ``n`` files are for training and validation; the rest is for the test.

    From three files on each part has one at least, and training gives way; two files are training and test.
    """
    if n < 3:
        return min(n, 1), 0
    held = max(1, int(n * valid))
    return max(1, min(max(1, int(n * train)), n - held - 1)), held


def document_split(groups: DataFrame, seed: str, column: str = "source") -> DataFrame:
    """``(column, split)``: groups in the order of a seeded hash, cut at ``split_sizes``; any number of groups."""
    placed, n = in_order(groups.select(column), [seeded(seed, column), F.asc(column)])
    train, valid = split_sizes(n)
    return placed.select(column, F.when(F.col("place") <= train, "train").when(F.col("place") <= train + valid, "valid").otherwise("test").alias("split"))
