"""Exact token counts at every prefix, by dynamic programming over a BPE piece vocabulary.

A sequence of pieces is the BPE encoding of its text exactly if every adjacent pair is the
encoding of the pair's text.  So the last piece of each prefix is found from shorter
prefixes alone: among the pieces that end there, the one that is compatible with the last
piece of the prefix before it.  ``count[i] = count[i - len(piece)] + 1`` then holds the
exact count of every prefix, and truncation or budget questions are lookups.

White space opens pieces and never stands inside one after another character, and line
breaks are never part of a piece; the text is cut there, each part is solved once and its
prefix counts are kept in a bounded cache.  Characters outside the vocabulary cost their
UTF-8 bytes (byte fallback).  Null text counts as empty; an empty text has no tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import TwoGenerationCache, batches

SPACE = "▁"
CACHE_WORDS = 300_000
CACHE_PARTS = 50_000
CACHE_PAIRS = 400_000


class PieceCounter:
    """Prefix counts for a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = sentencepiece_model_pb2.ModelProto.SentencePiece.NORMAL
        self.scores = {p.piece: p.score for p in model.pieces if p.type == normal}
        #: Pieces that merging can reach at all; only these end an encoding.
        self.reached = {p for p in self.scores if self._merged(p) == [p]}
        #: Every ending of such a piece: a longer one need not be tried where this breaks off.
        self.tails = {p[i:] for p in self.reached for i in range(len(p))}
        self.dummy = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        self.words = TwoGenerationCache(CACHE_PARTS)
        self.totals = TwoGenerationCache(CACHE_WORDS)
        self.pairs = TwoGenerationCache(CACHE_PAIRS)
        self.parts = re.compile(f"\\n|{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+")

    def _merged(self, text: str) -> list[str]:
        """The BPE pieces of a short text: the best-scored pair first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        known = self.pairs.get(key := (left, right))
        if known is None:
            known = self._merged(left + right) == [left, right]
            self.pairs.put(key, known)
        return known

    def part_counts(self, part: str) -> list[int]:
        """Token count of each prefix of a part, the empty one first."""
        known = self.words.get(part)
        if known is not None:
            return known
        reached, fits, known = self.reached, self._fits, self.pairs.young
        tails, last, counts = self.tails, [""], [0]  # last piece of each prefix, "" where anything may follow
        for end in range(1, len(part) + 1):
            start, found = end - 1, -1
            while start >= 0 and (piece := part[start:end]) in tails:
                if piece in reached:
                    left = last[start]
                    if not left or (known.get((left, piece)) if (left, piece) in known else fits(left, piece)):
                        found = start
                        break
                start -= 1
            if found >= 0:
                last.append(piece)
                counts.append(counts[start] + 1)
            elif part[end - 1] not in reached:
                last.append("")
                counts.append(counts[-1] + len(part[end - 1].encode("utf-8", "surrogatepass")))
            else:  # not known to happen for a vocabulary whose pieces are made by merges; merge the prefix itself
                merged = self._merged(part[:end])
                last.append(merged[-1])
                counts.append(sum(1 if p in self.scores else len(p.encode("utf-8", "surrogatepass")) for p in merged))
        if len(part) <= 64:
            self.words.put(part, counts)
        return counts

    def _split(self, text: str) -> list[str]:
        return self.parts.findall(self.dummy + text.replace(" ", SPACE)) if text else []

    def count(self, text: str | None) -> int:
        """Tokens of a whole text: the count at its last prefix."""
        if not text:
            return 0
        if not self.dummy or SPACE in text or "  " in text or text[0] == " ":
            return sum(self.part_counts(part)[-1] for part in self._split(text))
        words = text.split(" ")
        totals = list(map(self.totals.young.get, words))
        if None in totals:
            for i, word in enumerate(words):
                if totals[i] is None:
                    total = self.totals.get(word)
                    if total is None:
                        total = sum(self.part_counts(part)[-1] for part in self.parts.findall(SPACE + word))
                        if len(word) <= 64:
                            self.totals.put(word, total)
                    totals[i] = total
        return sum(totals)

    def prefix_counts(self, text: str | None) -> list[int]:
        """Exact token count of ``text[:i]`` for every ``i`` from 0 to its length."""
        out, base = [], 0
        for part in self._split(text or ""):
            counts = self.part_counts(part)
            out += [base + c for c in counts[1:]]
            base = out[-1]
        return [0, *out[len(self.dummy) :]] if out else [0]

    def longest_prefix(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens; counts need not be monotone."""
        counts = self.prefix_counts(text)
        if counts[-1] <= budget:
            return text
        return text[: max(i for i, c in enumerate(counts) if c <= budget)]

    def fits_budget(self, counts: list[int], budget: int) -> int:
        """How many leading texts with these counts fit a budget together."""
        sums, total = [], 0
        for c in counts:
            sums.append(total := total + c)
        return bisect_right(sums, budget)


_loaded: dict[str, PieceCounter] = {}


def load(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int | None = None) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for each row, with ``limit`` also the longest prefix within it.

    A narrow map without a shuffle over whole texts; repeated rows and null ids are kept, an empty table
    gives no rows, and further columns, whatever their names, are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches(frames):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array([counter.count(t) for t in texts], pa.int64()),
            ]
            names = ["id", "n_bytes", "n_tokens"]
            if limit is not None:
                columns.append(pa.array([counter.longest_prefix(t, limit) for t in texts], pa.string()))
                names.append("truncated")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, n_bytes bigint, n_tokens bigint" + (", truncated string" if limit is not None else "")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
    return rows.withColumnRenamed("id", id_column)
