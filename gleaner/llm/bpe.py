"""BPE encoding and decoding with a contiguous rank array per short word.

The tokenizer file is a public one in the ``tokenizers`` JSON format; its path is a
parameter.  Text is cut at the file's special strings, normalised (NFC, white space to one
space, lower case), split into words by the file's pattern, and every word is merged on its
own: a list holds the part boundaries, a second list of the same shape holds the rank of the
pair that begins at each boundary.  The smallest rank is found by a scan, its inner boundary
is deleted and the two neighbouring ranks are refreshed.  Words longer than ``LONG_WORD``
bytes go through a heap over linked parts, which gives the same result in O(n log n).

Null text counts as empty: no ids, empty decoding.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import TwoGenerationCache, batches

LONG_WORD = 96
CACHE_WORDS = 200_000
NO_RANK = 1 << 40


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for the 256 bytes, as byte-level tokenizers define them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder for a ``tokenizers`` file of the word-end BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in self.ids.items()}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.specials.items()})
        alphabet = byte_alphabet()
        self.byte_ids = [self.ids[alphabet[b]] for b in range(256)]
        self.last_ids = [self.ids[alphabet[b] + self.end] for b in range(256)]
        #: (left id, right id) -> (rank, id of the merged token)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split)
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.cache = TwoGenerationCache(CACHE_WORDS)

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one word."""
        parts = [self.byte_ids[b] for b in data]
        parts[-1] = self.last_ids[data[-1]]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        merges, none = self.merges, (NO_RANK, -1)
        ranks = [merges.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best[0] == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = merges.get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (hit := self.merges.get((parts[i], parts[j]))):
                heapq.heappush(heap, (hit[0], i, parts[i], parts[j], hit[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], live[j], after[i] = merged, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p, keep in zip(parts, live) if keep]

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.merge(word.encode("utf-8"))
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.names.__getitem__, ids))

    def _words(self, text: str) -> list[tuple[int, str, str]]:
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        words = self.word.findall(text)
        found = list(map(self.cache.young.get, words))
        if None in found:
            for i, word in enumerate(words):
                if found[i] is None:
                    hit = self.cache.get(word)
                    if hit is None:
                        hit = self._word(word)
                        if len(word) <= LONG_WORD:
                            self.cache.put(word, hit)
                    found[i] = hit
        return found

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """For each word or special string: number of ids, ids and tokens joined by spaces."""
        if self.special is None or not self.special.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._words(text[at : m.start()])
            out.append((1, str(self.specials[m[0]]), m[0]))
            at = m.end()
        return out + self._words(text[at:])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text or "") for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One tokenizer per worker process, so that its word cache lasts from task to task."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` for each row, or digests of the two if not ``with_ids``.

    One narrow map without a shuffle; every text is encoded whole.  Rows keep their number:
    repeated rows give repeated results, null ids stay null, other columns are dropped.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    tail = "ids array<int>, decoded string" if with_ids else "ids_sha256 string, decoded_sha256 string"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches(frames):
            counts, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                found = bpe.pieces(text or "")
                counts.append(sum(p[0] for p in found))
                ids, decoded = " ".join([p[1] for p in found]), " ".join([p[2] for p in found])
                first.append([int(i) for i in ids.split()] if with_ids else sha(ids))
                second.append(decoded if with_ids else sha(decoded))
            names = ["ids", "decoded"] if with_ids else ["ids_sha256", "decoded_sha256"]
            kinds = [pa.list_(pa.int32()) if with_ids else pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])],
                names=["id", "n_tokens", *names],
            )

    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, {tail}")
    return out.withColumnRenamed("id", id_column)


def decode_column(df: DataFrame, path: str, ids_column: str = "ids", out_column: str = "decoded") -> DataFrame:
    """Adds the decoded text of an ``array<int>`` column; a null array decodes to null."""

    @F.pandas_udf("string")
    def decoded(series):
        bpe = load(path)
        return series.map(lambda ids: None if ids is None else bpe.decode(list(ids)))

    return df.withColumn(out_column, decoded(F.col(ids_column)))
