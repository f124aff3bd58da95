"""What a task's Python holds at once."""

from urllib.parse import unquote

import duckdb
import pyarrow as pa

from gleaner.operators import sets
from gleaner.plans import answer_queries, extra_queries
from gleaner.sources import adapters


def test_sentences_are_compared_some_pairs_at_a_time():
    n = 3 * sets.COMPARED + 5
    frame = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["One. Two."] * n), pa.array(["One. Three."] * (n - 1) + [None])], names=["key", "old", "new"])
    parts = list(sets._sentence_map(True)(iter([frame])))
    assert [len(set(p["key"].to_pylist())) for p in parts] == [sets.COMPARED] * 3 + [5]
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(r["change"], r["old"], r["new"]) for r in rows[:2]] == [("unchanged", "One.", "One."), ("modified", "Two.", "Three.")]
    short = [r for p in sets._sentence_map(False)(iter([frame])) for r in p.to_pylist()]
    assert short == [{k: r[k] for k in ("key", "change", "score")} for r in rows]


def test_pages_are_stored_in_files_of_a_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extra_queries, "scratch", lambda _: str(tmp_path / "pages"))
    few = {tuple(r) for r in extra_queries.paged_files(spark, "/root/testdata/sf0.01").collect()}
    monkeypatch.setattr(extra_queries, "FILE_BYTES", 100_000, raising=False)
    monkeypatch.setattr(extra_queries, "scratch", lambda _: str(tmp_path / "more"))
    many = {tuple(r) for r in extra_queries.paged_files(spark, "/root/testdata/sf0.01").collect()}
    sizes = [f.stat().st_size for f in (tmp_path / "more").glob("*.txt")]
    assert many == few and len(sizes) > 10 and max(sizes) < sum(sizes) / 4


def test_a_form_feed_ends_a_page():
    read = adapters.resolve("reader", "ended_text")()
    assert [read(x) for x in (b"", b"a", b"a\f", b"a\f\fb\f", b"\f")] == [[], ["a"], ["a"], ["a", "", "b"], [""]]


def test_a_scanned_folder_holds_its_texts_in_ordered_parts(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}\r\n" * (i % 5) + "é", ("en", "de", "zh-Hant +ü/x", None)[i % 4]) for i in range(400, 0, -1)]
    rows += [(401, None, "en"), (402, "", "en"), (403, None, "none"), (404, "", "empty"), (405, "a\n", ""), (None, "last", "de")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(answer_queries, "scratch", lambda _: str(tmp_path / "found"))
    monkeypatch.setattr(answer_queries, "PART_BYTES", 1_000, raising=False)
    got = {tuple(r) for r in answer_queries.folder_scan(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(answer_queries.ORACLE_SQL["src1_folder_scan"]).fetchall())
    whole = {name: "" if text is None else text for name, text in con.sql("SELECT 'lang=' || lang, string_agg(text, chr(10) ORDER BY doc_id) FROM documents WHERE lang IS DISTINCT FROM 'none' GROUP BY lang").fetchall()}
    for folder in (tmp_path / "found").glob("folder=*/held=true"):
        parts = sorted(folder.glob("*.txt"))
        name = unquote(folder.parent.name.removeprefix("folder="))
        assert "".join(p.read_bytes().decode() for p in parts) == whole[None if name == "lang" else name] + "\n"
        assert max(p.stat().st_size for p in parts) < 3_000
