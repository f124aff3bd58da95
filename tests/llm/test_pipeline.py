import zlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from gleaner.llm import mixing, nbsvm, near_dup, privacy
from gleaner.llm.bpe import WordBpe
from tests.llm.test_models import make
from tests.llm.test_near_dup import exact_components


@pytest.fixture
def folder(spark, tmp_path):
    docs, labels = make(300, seed=9)
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t, _ in docs]
    rows += [(i + 1000, t + " end", "en", "src0", len(t) + 4) for i, t, _, _, _ in rows[:40]]
    rows += [(2000, "mail word.1@mail3.example.com word5 word9 now " + rows[1][1], "en", "src1", 9), (2001, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows, labels


def test_each_stage_against_its_input(spark, folder):
    path, rows, labels = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {"start": docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == columns
        seen[name] = out.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    model = nbsvm.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"), where=~nbsvm.held_out())
    good = {r.doc_id for r in seen["start"] if model.score(r.text) >= 0.7}
    assert {r.doc_id for r in seen["quality classifier"]} == good
    clean = {i for i, q, t in labels if q == 1 and t == 0}
    assert len(clean & good) >= 0.97 * len(clean)
    before = [(r.doc_id, r.text) for r in seen["quality classifier"]]
    heads = {i for (i, _), c in zip(before, exact_components(before)) if i == c}
    assert {r.doc_id for r in seen["near duplicates"]} == heads
    private = {r.doc_id: r.text for r in seen["private data"]}
    assert set(private) == heads and not any("word.1@mail3" in (t or "") for t in private.values())
    kept = {r.doc_id for r in seen["source mix"]}
    assert kept <= set(private) and clean & set(private) <= kept and len(kept) < len(private)


def test_stages_bear_columns_named_like_their_own(spark, folder):
    path, rows, _ = folder
    clashing = ["row", "kept_row", "gone_key", "row_key", "score", "copies", "rate", "u", "comp", "found", "n_shingles", "held_out", "codes", "p", "t"]
    docs = spark.createDataFrame(rows[:120] + [(3000, "w " * 150_000, "en", "src0", 9)] + rows[:5], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(clashing)])
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns and docs.count()
    assert all(r[c] == i for r in docs.collect() for i, c in enumerate(clashing))
    assert docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    assert corpus_pipeline.token_ids(spark, docs, path).count() == docs.count()


def test_run_encodes_what_is_left(spark, folder):
    path, _, _ = folder
    out = corpus_pipeline.run(spark, path).collect()
    bpe = WordBpe(P.path("word_bpe_49k.json"))
    assert out and all(r.decoded == bpe.decode(list(r.ids)) and r.n_tokens == len(r.ids) for r in out)
    assert len({r.doc_id for r in out}) == len(out)
    assert zlib.crc32(b"1") and mixing.DOMAINS and near_dup.TREES and privacy.ROUNDS
