"""The two tokenizers against their libraries, on generated and on given texts."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gleaner.llm import bpe, token_counts

LETTERS = "aAbB  \n\t'sSΣσς<|endoftext|>éÉé中文字😀🤖½²Ⅷ\x1c\x85\xa0 ▁▁İıſK0123_-…\x00​ही가ㄱ"


def texts(n=1500):
    rng = random.Random(1)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    made += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    return made + ["", " ", "<|endoftext|>a<|startoftext|>", " " * 50, "a" * 300, "ab" * 500, " " * 17 + "the", "x <s> </s> <unk> <0x0A>", "  two  spaces  "]


def library_bpe():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_and_decoding_equal_the_library():
    own, lib = bpe.WordBpe(P.path("word_bpe_49k.json")), library_bpe()
    for text in texts():
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_long_words_merge_as_short_ones(monkeypatch):
    own = bpe.WordBpe(P.path("word_bpe_49k.json"))
    word = b"internationalisation" * 4
    short = own.merge(word)
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    assert own.merge(word) == short


def test_prefix_counts_equal_the_library_at_every_prefix():
    own = token_counts.PieceCounter(P.path("piece_bpe_32k.model"))
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for text in texts(300):
        counts = [len(x) for x in lib.encode([text[:i] for i in range(len(text) + 1)])]
        assert own.prefix_counts(text) == counts
        assert own.count(text) == counts[-1]


def test_budget_questions():
    own = token_counts.PieceCounter(P.path("piece_bpe_32k.model"))
    text = "an ordinary sentence of several words"
    counts = own.prefix_counts(text)
    cut = own.longest_prefix(text, 4)
    assert own.count(cut) <= 4 and all(c > 4 for c in counts[len(cut) + 1 :])
    assert own.longest_prefix(text, 10_000) == text
    assert own.fits_budget([3, 3, 3], 7) == 2


@pytest.fixture
def docs(spark):
    rows = [(1, "One text", 5), (2, None, 6), (3, "", 7), (1, "One text", 5), (None, "x" * 5000, 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_encode_documents(docs):
    lib = library_bpe()
    rows = bpe.encode_documents(docs, P.path("word_bpe_49k.json")).collect()
    assert len(rows) == 5
    by_id = {r.doc_id: r for r in rows}
    assert list(by_id[1].ids) == lib.encode("One text", add_special_tokens=False).ids
    assert by_id[2].n_tokens == by_id[3].n_tokens == 0 and by_id[2].decoded == ""
    digest = bpe.encode_documents(docs, P.path("word_bpe_49k.json"), with_ids=False).where("doc_id = 1").first()
    assert digest.ids_sha256 == hashlib.sha256(" ".join(map(str, by_id[1].ids)).encode()).hexdigest()
    again = bpe.decode_column(bpe.encode_documents(docs, P.path("word_bpe_49k.json")), P.path("word_bpe_49k.json"), out_column="back")
    assert again.where("back <> decoded").count() == 0


def test_count_tokens(docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), limit=2).collect()
    assert len(rows) == 5
    for r in rows:
        if r.doc_id == 1:
            assert r.n_tokens == len(lib.encode("One text")) and r.n_bytes == 8 and len(lib.encode(r.truncated)) <= 2
    empty = docs.where("false")
    assert token_counts.count_tokens(empty, P.path("piece_bpe_32k.model")).count() == 0
    assert bpe.encode_documents(empty, P.path("word_bpe_49k.json")).count() == 0
