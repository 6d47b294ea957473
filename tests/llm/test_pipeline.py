"""The pipeline's stages, each on what the one before it kept."""

import re
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from tracemill.llm import bpe, common, decontaminate, labelled, ngram_join, toxicity

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def test_stages_over_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
            assert out.count() > 0
        if name == "toxicity":
            rows, counts = labelled.sample(before, spark.read.parquet(f"{SF}/labels.parquet"), "toxic", toxicity.TRAIN_ROWS)
            rows = [tuple(r) for r in rows.collect()]
            weights, offset = toxicity.fit(rows)
            scorer = toxicity.Scorer(weights, offset + labelled.share_shift(counts, [sum(y == k for _, y in rows) for k in (0, 1)]))
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in before.collect() if scorer.score(r.text) < 0.5}
        if name == "repeated_passages":
            # no run of 28 words of a text is left in two places
            whole = {r.doc_id: words_of(r.text) for r in before.collect()}
            windows = {i: {tuple(w[k : k + 28]) for k in range(len(w) - 27)} for i, w in whole.items()}
            left = Counter(x for r in out.collect() for w in [words_of(r.text)] for k in range(len(w) - 27) if (x := tuple(w[k : k + 28])) in windows[r.doc_id])
            assert left and max(left.values()) == 1
            assert all(len(words_of(r.text)) <= len(whole[r.doc_id]) for r in out.collect())
        if name == "near_copies":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            wanted = {i for i, (n, c) in ngram_join.brute_force(rows, 5, 80).items() if i == c}
            assert {r.doc_id for r in out.collect()} == wanted
        if name == "benchmark_passages":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert all(decontaminate.brute_force(r.text, items)[1] == 0 or r.text is None for r in out.limit(30).collect())
            last = {r.doc_id: r.text for r in out.collect()}
        before = out
    t = bpe.tokenizer(bpe.default_path())
    assert {r.doc_id: r.n_tokens for r in before.collect()} == {i: len(t.encode(x or "")) // 4 for i, x in last.items()}


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert "ids_sha256" in out.columns and 0 < out.count() <= 200


def test_stages_on_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "a"), (1, words, "a"), (None, words, None), (2, None, "b"), (3, "", "c"), (4, words + " more", "d"), (5, "w " * 100_000, "e"), (6, "\t", None)]
    docs = spark.createDataFrame([(*r, None, None, 5, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, marks string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        texts = [r.text for r in out.collect()]
        assert texts.count(None) == 1 and "" in texts and "\t" in texts
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [1, 2, 3, 5, 6]
    assert corpus_pipeline.encode(spark, docs, SF).count() == len(rows) and corpus_pipeline.encode(spark, docs.limit(0), SF).count() == 0


def test_what_a_stage_returns_passes_texts_in_small_batches(spark):
    keys = [k for k in common.WRITING if ".arrow." in k]
    before = {k: spark.conf.get(k).removesuffix("b") for k in keys}
    sizes = lambda df: [r.n for r in df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long").collect()]
    try:
        for k in keys:
            spark.conf.unset(k)
        corpus_pipeline.drop_repeated_passages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
        rows = spark.range(0, 9_000, 1, 1)
        assert sum(sizes(rows)) == 9_000 and max(sizes(rows)) <= 2_000
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # less than that stays
        common.lean_workers(spark)
        assert max(sizes(rows)) <= 500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
