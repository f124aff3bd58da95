"""A stored search index of immutable blocks, and exact top-k search that skips blocks under a bound.

A block holds some documents and, for each of their terms, the documents with it, how often, the term's hash bucket, and what
bounds its weight there: the most occurrences in one document and the least length of one that has it.  Nothing in a block
depends on the rest of the corpus, so a block never changes when documents are added; document frequencies and the mean
length, which do change, are a table of their own.

Questions go out in blocks of a bounded number of terms.  The first pass reads only terms and bounds, and picks the blocks
that promise most to each question; scoring those gives the score that a document must reach to be among the best ``k``.
The second pass leaves out (question, block) pairs whose bound is below it, and documents that do not reach it.
Each task keeps the ``k`` best of a question, so what is shuffled does not grow with the documents of a task.
What a task holds is bounded as well: blocks by documents and tokens, row groups of the stored table by bytes, blocks of
questions by terms and number, and the pairs that are scored at once by ``PAIRS``.
Lexical scores (BM25) and cosines of hashed counts come from the same pass over the same blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.functions import text as T
from gleaner.operators.index import B, DIMENSIONS, K1, idf
from gleaner.operators.order import in_order
from gleaner.session import shared_folder

#: Documents of one block, terms of one block of questions, and blocks that are tried first for a question.
BLOCK, MOST_TERMS, TRIED = 128, 16_384, 2
#: Bytes of the joined tokens of a block and of a row group of the stored table, questions of a block, postings scored at once.
BLOCK_BYTES, ROW_GROUP, MOST_QUESTIONS, PAIRS = 1 << 20, 4 << 20, 256, 1 << 19
CHANNELS = ("sparse", "dense")


def bucket_of(term: str) -> int:
    return int(hashlib.sha256(term.encode()).hexdigest()[-3:], 16) % DIMENSIONS


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of runs of at most ``BLOCK`` texts and, but for the last of a run, ``BLOCK_BYTES``."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        full = int(np.searchsorted(ends, ends[at] - size[at] + BLOCK_BYTES)) + 1
        n = min(BLOCK, full - at, len(size) - at)
        yield at, n
        at += n


def _packed(kind: pa.DataType):
    """An Arrow map from ``(id, tokens joined by blanks)`` to blocks."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for frame in frames:
            for at, size in _slices(frame.column(1)):
                ids, joined = frame.column(0).slice(at, size), frame.column(1).slice(at, size)
                tokens = pc.split_pattern(joined, " ")
                lengths = np.where(pc.equal(joined, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(tokens).to_numpy(zero_copy_only=False)).astype(np.int64)
                flat = tokens.flatten()
                codes = pc.dictionary_encode(flat.filter(pc.not_equal(flat, "")))
                terms, n = codes.dictionary, len(ids)
                owner = np.repeat(np.arange(n), lengths)
                key, tf = np.unique(codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + owner, return_counts=True)
                of_term, docs = np.divmod(key, n)
                ends = np.searchsorted(of_term, np.arange(1, len(terms) + 1))
                starts = np.concatenate([[0], ends])
                some = len(terms) > 0
                most = np.maximum.reduceat(tf, starts[:-1]) if some else tf
                least = np.minimum.reduceat(lengths[docs], starts[:-1]) if some else tf
                buckets = []
                for term in terms.to_pylist():
                    if (b := memo.get(term)) is None:
                        b = bucket_of(term)
                        if len(memo) < 200_000:
                            memo[term] = b
                    buckets.append(b)
                one = lambda x, t: pa.array([x], pa.list_(t))
                columns = [one(ids.to_pylist(), kind), *[one(x, pa.int32()) for x in (lengths, starts, docs, tf)], one(terms.to_pylist(), pa.string()), *[one(x, pa.int32()) for x in (np.diff(starts), most, least, buckets)]]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "lengths", "starts", "docs", "tf", "terms", "df", "most_tf", "least_length", "buckets"])

    return run


class BlockIndex:
    """An index in a folder: ``blocks``, ``terms`` (term, df) and ``corpus`` (n, total length)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.blocks, self.terms = spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/terms")
        corpus = spark.read.parquet(f"{folder}/corpus").first()
        self.n, self.mean = corpus["n"], corpus["total"] / corpus["n"] if corpus["n"] else 0.0

    @classmethod
    def build(cls, units: DataFrame, folder: str | None = None, ident: str = "doc_id", text: str = "text") -> BlockIndex:
        """One tokenised scan writes the blocks; the tables of terms and of the corpus are summed from those."""
        spark, folder = units.sparkSession, folder or shared_folder(units.sparkSession, "blocks")
        kind = units.schema[ident].dataType.simpleString()
        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
        array = lambda name: f"{name} array<int>"
        schema = f"ids array<{kind}>, {', '.join(map(array, ('lengths', 'starts', 'docs', 'tf')))}, terms array<string>, {', '.join(map(array, ('df', 'most_tf', 'least_length', 'buckets')))}"
        tokens = units.select(ident, F.array_join(T.tokens(F.coalesce(F.col(text), F.lit(""))), " ").alias("tokens"))
        stored = tokens.mapInArrow(_packed(arrow), schema).withColumn("block", F.monotonically_increasing_id())
        # else Parquet looks at sizes after 100 rows first, which are 100 blocks here
        stored.write.options(**{"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1}).parquet(f"{folder}/blocks")
        blocks = spark.read.parquet(f"{folder}/blocks")
        counts = blocks.select(F.inline(F.arrays_zip("terms", "df")).alias("term", "df"))
        counts.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/terms")
        total = F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))
        blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("bigint").alias("n"), total.alias("total")).write.parquet(f"{folder}/corpus")
        return cls(spark, folder)

    def search(self, questions: DataFrame, k: int, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
        """``(qid, channel, id, score, rank)``: the ``k`` best of each question (``qid``, ``text``) in each channel.

        A lexical list has only documents with a term of the question; ties go to the smaller id.  Scores have six digits.
        """
        kinds = (questions.schema["qid"].dataType.simpleString(), self.blocks.schema["ids"].dataType.elementType.simpleString())
        out = self.spark.createDataFrame([], f"qid {kinds[0]}, channel string, id {kinds[1]}, score double")
        for asked in self._question_blocks(questions):
            least = self._thresholds(asked, k) if "sparse" in channels else None
            out = out.unionByName(self._scored(self.blocks, asked, k, channels, least, kinds))
        w = Window.partitionBy("qid", "channel").orderBy(F.desc("score"), F.asc("id"))
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _question_blocks(self, questions: DataFrame) -> Iterator[_Asked]:
        """Blocks of questions with about ``MOST_TERMS`` terms and ``MOST_QUESTIONS`` at most, read one after another."""
        tokens = questions.where("qid IS NOT NULL").select("qid", T.tokens(F.coalesce(F.col("text"), F.lit(""))).alias("ts"))
        placed, _ = in_order(tokens.withColumn("n", F.greatest(F.lit(max(1, MOST_TERMS // MOST_QUESTIONS)), F.size("ts"))), [F.asc("qid")], ["n"])
        blocked = placed.select("qid", "ts", F.floor(F.col("n_before") / MOST_TERMS).alias("b"))
        numbers = [r.b for r in blocked.select("b").distinct().orderBy("b").collect()]
        for b in numbers:
            counted = blocked.where(F.col("b") == b).select("qid", F.explode_outer("ts").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
            rows = counted.join(self.terms, "term", "left").select("qid", "term", "qtf", F.coalesce(idf(F.col("df"), F.lit(self.n)), F.lit(0.0)).alias("idf")).collect()
            yield _Asked(sorted({r.qid for r in rows}), [r for r in rows if r.term is not None], self.mean)

    def _thresholds(self, asked: _Asked, k: int) -> np.ndarray:
        """For each question a lexical score that its ``k``-th best document has at least; 0 if fewer documents were tried."""
        shared, tried = self.spark.sparkContext.broadcast(asked), max(TRIED, -(-2 * k // BLOCK))

        def bounds(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, made = shared.value, []
            for frame in frames:
                for i in range(frame.num_rows):
                    terms, most_tf, least_length = (frame.column(c)[i].values for c in ("terms", "most_tf", "least_length"))
                    made.append((frame.column("block")[i].as_py(), a.bounds(terms, most_tf, least_length)))
                    if len(made) > 64:
                        made = a.most_promising(made, tried)
            made = a.most_promising(made, tried)
            pairs = [(q, block, float(bound[q])) for block, bound in made for q in np.flatnonzero(bound > 0)]
            q, block, bound = zip(*pairs) if pairs else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(block, pa.int64()), pa.array(bound, pa.float64())], names=["q", "block", "bound"])

        narrow = self.blocks.select("block", "terms", "most_tf", "least_length")
        best = Window.partitionBy("q").orderBy(F.desc("bound"), F.asc("block"))
        picked = narrow.mapInArrow(bounds, "q int, block bigint, bound double").withColumn("at", F.row_number().over(best)).where(F.col("at") <= tried)
        # at most as many as questions times blocks tried, whatever the corpus
        chosen = F.broadcast(picked.select("block").distinct())
        first = self._scored(self.blocks.join(chosen, "block", "left_semi"), asked, k, ("sparse",), None, ("int", self.blocks.schema["ids"].dataType.elementType.simpleString()), numbered=True)
        reached = first.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id")))).where(F.col("at") == k)
        least = np.zeros(len(asked.ids))
        for r in reached.select("qid", "score").collect():
            least[r.qid] = r.score
        return least

    def _scored(self, blocks: DataFrame, asked: _Asked, k: int, channels, least, kinds, numbered: bool = False) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((asked, least))
        kind = kinds[1]

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, floor = shared.value
            kept = {c: _Best(k, len(a.ids), floor if c == "sparse" else None) for c in channels}
            for frame in frames:
                for i in range(frame.num_rows):
                    block = {c: frame.column(c)[i].values for c in frame.schema.names}
                    block["starts"] = pa.array(np.concatenate([[0], np.cumsum(block["df"].to_numpy(zero_copy_only=False))]).astype(np.int32))
                    ids = np.array(block["ids"].to_pylist(), object if kind == "string" else np.int64)
                    if "sparse" in kept:
                        for part in a.lexical_parts(block, kept["sparse"].least):
                            kept["sparse"].add(ids, *part)
                    if "dense" in kept:
                        kept["dense"].add(ids, *a.cosines(block))
            for channel, best in kept.items():
                q, ids, score = best.rows()
                qids = pa.array(q, pa.int32()) if numbered else pa.array(a.ids).take(pa.array(q, pa.int64()))
                yield pa.RecordBatch.from_arrays([qids, pa.array([channel] * len(q), pa.string()), pa.array(ids.tolist(), {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), pa.array(score, pa.float64())], names=["qid", "channel", "id", "score"])

        wanted = {"ids", "lengths", "docs", "tf", "df"} | ({"terms", "most_tf", "least_length"} if "sparse" in channels else set()) | ({"buckets"} if "dense" in channels else set())
        return blocks.select(*[c for c in blocks.columns if c in wanted]).mapInArrow(run, f"qid {'int' if numbered else kinds[0]}, channel string, id {kind}, score double")


class _Asked:
    """A block of questions as arrays: their terms, and for each term the questions that have it."""

    def __init__(self, ids: list, rows: list, mean: float):
        self.ids, self.mean = ids, max(mean, 1e-10)
        at = {q: i for i, q in enumerate(ids)}
        terms = sorted({r.term for r in rows})
        code = {t: i for i, t in enumerate(terms)}
        self.vocabulary, self.idf = pa.array(terms, pa.string()), np.zeros(len(terms))
        flat = sorted((code[r.term], at[r.qid], r.qtf) for r in rows)
        self.of, self.qtf = np.array([x[1] for x in flat], np.int64), np.array([x[2] for x in flat], float)
        self.first = np.searchsorted([x[0] for x in flat], np.arange(len(terms) + 1))
        for r in rows:
            self.idf[code[r.term]] = r.idf
        self.vectors = np.zeros((len(ids), DIMENSIONS))
        for r in rows:
            self.vectors[at[r.qid], bucket_of(r.term)] += r.qtf
        self.vectors /= np.sqrt((self.vectors**2).sum(axis=1, keepdims=True)) + 1e-10

    def saturated(self, tf, length):
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def _known(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of a block's terms that some question has, and their codes."""
        codes = pc.fill_null(pc.index_in(terms, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(codes >= 0)
        return places, codes[places]

    def _spread(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each code once for every question that has the term: its place among ``codes``, the question, its count there."""
        n = self.first[codes + 1] - self.first[codes]
        place = np.repeat(np.arange(len(codes)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[codes], n)
        return place, self.of[at], self.qtf[at]

    def bounds(self, terms: pa.Array, most_tf: pa.Array, least_length: pa.Array) -> np.ndarray:
        """For each question a score that no document of a block exceeds."""
        places, codes = self._known(terms)
        most, least = (x.to_numpy(zero_copy_only=False)[places] for x in (most_tf, least_length))
        place, of, qtf = self._spread(codes)
        return np.bincount(of, (self.idf[codes] * self.saturated(most.astype(float), least))[place] * qtf, len(self.ids))

    def most_promising(self, made: list, tried: int) -> list:
        """The blocks that are among the first ``tried`` of any question."""
        if len(made) <= tried:
            return made
        order = np.argsort(-np.stack([b for _, b in made]), axis=0, kind="stable")[:tried]
        return [made[i] for i in np.unique(order)]

    def lexical(self, block: dict, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, question, score)`` of a block's pairs that share a term, where the bound lets the question in."""
        parts = list(self.lexical_parts(block, least))
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))

    def lexical_parts(self, block: dict, least: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As ``lexical``, some questions at a time: about ``PAIRS`` postings, or those of one question if it has more."""
        places, codes = self._known(block["terms"])
        get = lambda name: block[name].to_numpy(zero_copy_only=False)
        starts, docs, tfs, lengths = get("starts"), get("docs"), get("tf"), get("lengths")
        place, of, qtf = self._spread(codes)
        if least is not None:
            open_ = (self.bounds(block["terms"], block["most_tf"], block["least_length"]) >= least - 1e-6)[of]
            place, of, qtf = place[open_], of[open_], qtf[open_]
        order = np.argsort(of, kind="stable")
        place, of, qtf = place[order], of[order], qtf[order]
        sizes = (starts[places + 1] - starts[places])[place].astype(np.int64)
        start, weight, ends = starts[places][place], self.idf[codes][place] * qtf, np.cumsum(sizes)
        at, firsts = 0, np.searchsorted(of, np.arange(len(self.ids) + 1))
        while True:
            # whole questions only: the last boundary within the size, or else the next one
            full = np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")
            end = int(firsts[max(np.searchsorted(firsts, full, "right") - 1, 0)])
            if end <= at:
                end = int(firsts[min(np.searchsorted(firsts, at, "right"), len(self.ids))])
            yield self._summed(start[at:end], sizes[at:end], weight[at:end], of[at:end], docs, tfs, lengths)
            at = end
            if at >= len(of):
                return

    def _summed(self, start, n, weight, of, docs, tfs, lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = (of[0], of[-1] + 1) if len(of) else (0, 0)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        tf, doc = tfs[at].astype(float), docs[at].astype(np.int64)
        part = np.repeat(weight, n) * self.saturated(tf, lengths[doc])
        total = np.bincount(doc * (high - low) + np.repeat(of - low, n), part, len(lengths) * (high - low))
        found = np.flatnonzero(total > 0)
        return (found // (high - low), found % (high - low) + low, total[found]) if len(found) else (found, found, total[:0])

    def cosines(self, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, question, cosine)`` of every pair of a block, of term counts by hash bucket."""
        get = lambda name: block[name].to_numpy(zero_copy_only=False)
        starts, n = get("starts"), len(block["lengths"])
        bucket = np.repeat(get("buckets"), np.diff(starts)).astype(np.int64)
        m = np.bincount(get("docs") * np.int64(DIMENSIONS) + bucket, get("tf"), n * DIMENSIONS).reshape(n, DIMENSIONS)
        m /= np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-10
        # nine digits, then six, halves up
        scores = (np.rint(m @ self.vectors.T * 1e9) + 500) // 1000 / 1e6
        return *np.divmod(np.arange(scores.size), len(self.ids)), scores.ravel()


class _Best:
    """The ``k`` best of each question that a task has seen."""

    def __init__(self, k: int, questions: int, least: np.ndarray | None):
        self.k, self.questions = k, questions
        self.least = None if least is None else least.copy()
        self.q, self.ids, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, ids: np.ndarray, doc: np.ndarray, q: np.ndarray, score: np.ndarray) -> None:
        score = np.round(score, 6)
        if self.least is not None:
            reach = score >= self.least[q]
            doc, q, score = doc[reach], q[reach], score[reach]
        new = ids[doc]
        self.q, self.score = np.concatenate([self.q, q]), np.concatenate([self.score, score])
        self.ids = new if self.ids is None else np.concatenate([self.ids, new])
        if len(self.q) > 2 * self.k * self.questions:
            self._cut()

    def _cut(self) -> None:
        if self.ids is None:
            return
        order = np.lexsort((np.unique(self.ids, return_inverse=True)[1], -self.score, self.q))
        q = self.q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < self.k]
        self.q, self.ids, self.score = self.q[order], self.ids[order], self.score[order]
        if self.least is None:
            self.least = np.full(self.questions, -np.inf)
        full = np.flatnonzero(np.bincount(self.q, minlength=self.questions) == self.k)
        last = np.searchsorted(self.q, full, "right") - 1
        self.least[full] = np.maximum(self.least[full], self.score[last])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._cut()
        return self.q, np.zeros(0, object) if self.ids is None else self.ids, self.score
