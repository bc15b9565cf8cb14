import corpus_pipeline
from itemloom.llm import packing, pii, quality, simhash, suffix

from .cases import documents, prose, texts


def test_stages_are_whole(spark, tmp_path):
    rows = [*texts(), (40, prose(50, 100) + " write to joe@mail.example.com"), (41, prose(51, 90) + " " + prose(52, 60)), (42, prose(53, 80) + " " + prose(52, 60))]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "simhash near-dedup", "suffix-array dedup", "pii", "best-fit packing"]
    seen, df = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns
        seen.append({r.doc_id: r for r in df.collect()})
    good = {r.doc_id for r in quality.op1(docs).collect() if r.kept}
    assert set(seen[0]) == good and 0 in good and 6 not in good and 10 not in good
    assert 1 not in seen[1] and 0 in seen[1] and set(seen[1]) <= good
    assert set(seen[2]) == set(seen[1]) and prose(52, 60) not in seen[2][42].text and prose(52, 60) in seen[2][41].text and seen[2][42].text.startswith(prose(53, 80))
    assert seen[3][40].text.endswith("write to [email]") and seen[3][40].n_chars == len(seen[3][40].text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({repr(r.doc_id) for r in packed}) == sorted(repr(k) for k in seen[3])
    assert {packing, pii, simhash, suffix}


def test_an_empty_corpus(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
