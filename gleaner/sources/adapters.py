"""Adapters for what the box cannot read itself: PDF, OCR, encoders, rerankers, generators.

Each adapter wraps a function that is loaded once a partition and gets Arrow batches; a name
that is not registered fails at once and is never replaced by another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Loader = Callable[[], Callable]
_encoders: dict[str, Loader] = {}
_readers: dict[str, Loader] = {}
_scorers: dict[str, Loader] = {}


def register(kind: str, name: str, loader: Loader) -> None:
    {"encoder": _encoders, "reader": _readers, "scorer": _scorers}[kind][name] = loader


def resolve(kind: str, name: str) -> Loader:
    known = {"encoder": _encoders, "reader": _readers, "scorer": _scorers}[kind]
    if name not in known:
        raise ValueError(f"no {kind} named {name!r}; known: {sorted(known)}")
    return known[name]


def read_files(files: DataFrame, reader: str) -> DataFrame:
    """``(path, content)`` of a binary source to ``(path, page_number, text, status)``."""
    load = resolve("reader", reader)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages_of = load()
        for pdf in frames:
            # one file at a time, as its pages are held as objects
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = list(pages_of(content))
                    rows = [(path, i, t, "blank" if not t.strip() else "readable") for i, t in enumerate(found, 1)]
                except Exception as error:
                    rows = [(path, 0, "", f"unreadable: {type(error).__name__}")]
                yield pd.DataFrame(rows, columns=["path", "page_number", "text", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string, status string")


def encode(rows: DataFrame, encoder: str, ident: str, text: str, instruction: str = "") -> DataFrame:
    """``(id, vector)`` of unit length; a vector that is zero or not finite is an error."""
    load, kind = resolve("encoder", encoder), rows.schema[ident].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for pdf in frames:
            m = np.asarray(embed([instruction + (t or "") for t in pdf["text"]]), float)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            if not np.isfinite(m).all():
                raise ValueError("an encoder gave a value that is not finite")
            yield pd.DataFrame({"id": pdf["id"], "vector": list(m / np.maximum(norm, 1e-10))})

    picked = rows.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    return picked.mapInPandas(run, f"id {kind}, vector array<double>").withColumnRenamed("id", ident)


def score_pairs(pairs: DataFrame, scorer: str) -> DataFrame:
    """``(qid, id, question, text)`` to ``(qid, id, cross)``; order in is order out."""
    load = resolve("scorer", scorer)
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("qid", "id")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for pdf in frames:
            yield pd.DataFrame({"qid": pdf["qid"], "id": pdf["id"], "cross": [float(x) for x in score(list(pdf["question"]), list(pdf["text"]))]})

    return pairs.select("qid", "id", "question", "text").mapInPandas(run, f"qid {kinds[0]}, id {kinds[1]}, cross double")


def _hashing_encoder():
    from gleaner.operators.index import hash_vector

    memo: dict[str, int] = {}
    return lambda texts: np.stack([hash_vector(t, memo) for t in texts])


def _overlap_scorer():
    def score(questions, texts):
        out = []
        for q, t in zip(questions, texts):
            a, b = set((q or "").lower().split()), set((t or "").lower().split())
            out.append(len(a & b) / max(1, len(a)))
        return out

    return score


register("encoder", "local_hash", _hashing_encoder)
register("scorer", "overlap", _overlap_scorer)
register("reader", "plain_text", lambda: lambda content: bytes(content).decode("utf-8").split("\f"))


def _ended_pages(content) -> list[str]:
    pages = bytes(content).decode("utf-8").split("\f")
    return pages if pages[-1] else pages[:-1]


# a form feed ends a page, so none stands after the last one: a text can be in any number of files
register("reader", "ended_text", lambda: _ended_pages)
