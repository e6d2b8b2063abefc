from collections import Counter

import corpus_pipeline
from tarnwater.llm import bpe, mixing, suffixes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        sizes[name] = docs.count()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sizes["SimHash near-dedup"] <= sizes["quality classifier"] < before
    assert sizes["suffix-array dedup"] == sizes["SimHash near-dedup"]
    drawn = Counter(r.doc_id for r in docs.collect())
    assert sum(truth.get(i) == 0 for i in drawn) <= 3 and max(drawn.values()) <= mixing.REPEATS
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    coder = bpe.Codec(bpe.vocabulary())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert Counter(r.doc_id for r in last.collect()) == drawn
    for r in last.collect():
        assert bytes(r.ids) == coder.encode(texts[r.doc_id]).tobytes()
    again = corpus_pipeline.run(spark, SF)
    assert Counter(again.select("doc_id", "n_tokens", "decoded_sha256").collect()) == Counter(last.select("doc_id", "n_tokens", "decoded_sha256").collect())


def test_repeated_passages_go(spark):
    """Passages of over 50 words that stand in several documents go, and documents that share none are left alone."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    after = {r.doc_id: r for r in corpus_pipeline.repeated_strings(spark, docs, folder).collect()}
    assert after.keys() == before.keys() and all(r.n_chars == len(r.text) for r in after.values())
    passages = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if len(r.text.split()) > 50]
    lines = Counter(x for t in before.values() for x in set(t.split("\n")))
    passages += [x for x, n in lines.items() if n > 1 and len(x.split()) > 50]
    planted = [p for p in passages if sum(p in t for t in before.values()) > 1]
    assert len(planted) > 20 and not any(p in r.text for p in planted for r in after.values())
    size = suffixes.PASSAGE
    seen = Counter(hash(b[i : i + size]) for b in (t.encode() for t in before.values()) for i in range(len(b) - size + 1))
    for i, t in before.items():
        b = t.encode()
        if all(seen[hash(b[k : k + size])] == 1 for k in range(len(b) - size + 1)):
            assert after[i].text == t


def test_columns_that_clash_and_a_very_long_text(spark, table):
    rows = [(i, f"words of text number {i} and some more of them", "en", "s", 40, 3, "x", "row") for i in range(5)] + [(9, "long words " * 100_000, "en", "s", 1, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, predicted int, score string, row string")
    folder = table("labels", spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "predicted", "score", "row"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.tokens(spark, docs, folder).count() == docs.count() > 0


def test_cases(spark, table):
    docs = spark.createDataFrame([(None, None, None, None, None, "k"), (1, "", "en", None, 0, "k"), (1, "", "en", None, 0, "k"), (2, "some words here", None, "a", 15, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint, raw string")
    table("documents", docs)
    folder = table("labels", spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() >= 2
    folder = table("documents", docs.limit(0))
    assert corpus_pipeline.run(spark, folder).count() == 0
