"""Each stage of the pipeline against brute force on its own input."""

import zlib

import corpus_pipeline
import public_tokenizers
from assaya.llm import language_id, secrets
from test_llm import brute_similar, low

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "SimHash near-dedup", "secret scans", "packing"]
    before = {r.doc_id: r for r in docs.collect()}
    steps = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == columns
        rows = out.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        steps.append({r.doc_id: r for r in rows})
    spoken, single, apart, clean = steps
    assert {d for d, r in before.items() if r.lang and any(c.isalpha() for c in r.text)} >= set(spoken)
    assert len(spoken) > 0.98 * sum(any(c.isalpha() for c in r.text) for r in before.values())
    best = {}
    for d, r in spoken.items():
        best[low(r.text)] = max(best.get(low(r.text), d), d)
    assert set(single) == set(best.values())
    rows = [(d, r.text) for d, r in single.items()]
    comp = brute_similar(rows)
    assert set(apart) == {rows[k][0] for k, c in comp.items() if rows[k][0] == c}
    assert len(apart) < len(single)
    assert set(clean) == set(apart)
    ranks = secrets.ranked(secrets.vocabulary_words(public_tokenizers.path("word_bpe_49k.json")))
    for d, r in clean.items():
        assert r.text == secrets.redacted(apart[d].text, secrets.spans(apart[d].text, ranks=ranks))
        assert r.n_chars == len(r.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(clean)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert got.count() > 0


def test_run_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (5, "the house of the sea", "en", "s", 20), (8, "The House of the sea", "en", None, None), (None, "la maison de la mer", "fr", "s", 1)]
    rows = [(*r, 0.5, "x") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, digest string")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} == {8, None}
    assert {(r.score, r.digest) for r in docs.collect()} == {(0.5, "x")}
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0
    assert zlib.crc32(b"5") and language_id.BITS


def test_repeated_rows(spark):
    rows = [(1, "the house of the sea", "en", "s", 20), (1, "The house of the sea", "en", "s", 20), (1, "another text", "en", "s", 12), (None, "no id here", "en", "s", 10), (None, "No id here", "en", "s", 10), (None, "nor here", "en", "s", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.exact_copies(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text.lower()) for r in out.collect()), key=str) == [(1, "another text"), (1, "the house of the sea"), (None, "no id here"), (None, "nor here")]


def test_a_corpus_without_labels_stays(spark):
    rows = [(1, "the house of the sea", None, "s", 20), (2, None, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.languages(spark, docs, SF).collect()} == {1, 2}


def test_a_long_text_goes_through_all_stages(spark):
    long = " ".join(f"the house {k} of the sea" for k in range(40_000)) + " password=abcdefgh"
    rows = [(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", None), (3, "la maison de la mer", "fr", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} == {1, 3}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.length for r in packed if r.doc_id == 1) == next(r.doc_tokens for r in packed if r.doc_id == 1) > 4096
