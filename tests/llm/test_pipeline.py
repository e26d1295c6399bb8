import sys

sys.path.insert(0, __file__.rpartition("/")[0])
import corpus_pipeline
from helpers import DOCS, deduped_lines, near_duplicates

from quern.llm import language_id, packing, quality

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality", "line_dedup", "ngram_join", "packing"]
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF).cache()
        assert out.columns == docs.columns
        kept[name], now = out, out
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    first, second, third, fourth = (rows(kept[n]) for n in names[:4])
    # classifiers: the stages follow the operators' scores on their own input
    said = {r["doc_id"]: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert set(first) == {i for i, r in said.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_LANGUAGE_SCORE} and len(first) > 0.9 * docs.count()
    scores = {r.doc_id: r.score for r in quality.score(kept["language_id"], quality.fit(kept["language_id"], spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert set(second) == {i for i, s in scores.items() if s >= quality.THRESHOLD} and 0.5 < len(second) / len(first) < 1
    # line dedup and near-duplicates: exactly
    want = deduped_lines([(i, r.text) for i, r in second.items()])
    assert {i: r.text or "" for i, r in third.items()} == {i: t for i, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for i, r in third.items() if want[i][1])
    groups = near_duplicates([(i, r.text) for i, r in third.items()])
    assert set(fourth) == {i for i, (_, c) in groups.items() if c == i}
    final = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    own = packing.encoder(packing.tokenizer_path()).library
    length = {}
    for r in final:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {i: len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in fourth.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in final)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", *[None] * 6), (None, "the text and more of it", "en", *[None] * 6), (2, "", None, *[None] * 6), (3, "the text and the text", "en", *[None] * 6)], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).collect()
