import brute
import fixtures
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rows = fixtures.documents(90) + fixtures.odd()
    plain = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
        if name != "packing":
            assert docs.columns == columns
    language, single, cut, mix, packed = kept
    assert language.count() > single.count() >= cut.count() > 0
    assert single.select("doc_id").distinct().count() == single.count()
    assert {r["doc_id"] for r in mix.select("doc_id").distinct().collect()} <= {r["doc_id"] for r in cut.select("doc_id").collect()}
    # the second and third stage against plain versions, each on its own input
    rows = [(r["doc_id"], r["text"]) for r in language.collect()]
    groups = brute.components(rows, 5, 80)
    assert {r["doc_id"] for r in single.collect()} - {None} == {c if n else i for i, n, c in groups} - {None}
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    want = sorted((i, kept) for i, n, gone, _, kept in brute.removed(rows) if i is not None and kept)
    assert sorted((r["doc_id"], brute.words(r["text"], False)) for r in cut.collect() if r["doc_id"] is not None) == want
    assert packed.agg({"length": "sum"}).first()[0] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
