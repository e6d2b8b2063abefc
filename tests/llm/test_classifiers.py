import re
import zlib

import numpy as np
import pytest

from tarnwater.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    return {r.doc_id: r for r in docs.select("doc_id", "text", "quality", "toxic").collect()}


@pytest.mark.parametrize("query,column,rest,mod", [(quality.op10_quality_ranking, "quality", 1, 3), (toxicity.op4_toxicity_bigru, "toxic", 0, 5)])
def test_held_out_accuracy(spark, truth, query, column, rest, mod):
    got = query(spark, SF).collect()
    assert len(got) == 10_000
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id][column])
    assert np.mean(right) > 0.95


def test_gradients():
    net = toxicity.Network(np.arange(1, 40, dtype=np.uint64))
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    random = np.random.default_rng(1)
    vectors = random.standard_normal((99, toxicity.D))
    at, mask = net.gather(99, np.array([0, 5, 90]), np.array([32, 20, 7]))
    x = vectors[at]
    keep, slope = {}, np.array([0.3, -0.5, 0.7])
    net.forward(x, mask, keep)
    grad, _ = net.backward(keep, slope)
    for k, g in grad.items():
        i = np.unravel_index(abs(g).argmax(), g.shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-4
        up = net.forward(x, mask) @ slope
        net.p[k][i] = old - 1e-4
        down = net.forward(x, mask) @ slope
        net.p[k][i] = old
        assert g[i] == pytest.approx((up - down) / 2e-4, rel=1e-3)
    assert np.allclose(net.forward(x, mask), net.logits(net.gates(vectors), at, mask), atol=1e-5)


def test_words_and_trigrams_by_definition():
    raws = [b"The cat's  hat", b"", b"  hat xABCDEFGHIJKLMNOPQRSTUVWXYZy xabcdefghijkl-nopqrstuvwxyzy \xc3\xa9t\xc3\xa9 a", b"cat", b"x" * 9000]
    w = toxicity.Words(raws)
    words = [re.findall(rb"[a-z\x80-\xff]+", r.lower()) for r in raws]
    assert w.sizes.tolist() == [len(x) for x in words]
    flat = [x for row in words for x in row]
    assert len(set(w.of[:-1].tolist())) == len(set(flat)) == len(set(w.hashes[:-1].tolist()))
    for i, word in enumerate(flat):
        same = [j for j, x in enumerate(flat) if x == word]
        assert {j for j in range(len(flat)) if w.of[j] == w.of[i]} == set(same)
        edged = b" " + word + b" "
        grams = [int.from_bytes(edged[k : k + 3], "little") for k in range(len(word))]
        assert w.trigrams(w.of[i : i + 1])[0].tolist() == [(g * int(toxicity._MIX) % 2**64) >> (64 - toxicity._SLOT_BITS) for g in grams]
    assert toxicity.Words([]).sizes.tolist() == [] and toxicity.Words([b"", b"."]).sizes.tolist() == [0, 0]


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i)) for i in range(50)] * 2, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 2 + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    from pyspark.sql import functions as F

    got = quality.labelled(docs, labels, "toxic", F.lit(True), (10, 20)).collect()
    assert sorted(r.label for r in got) == [0] * 10 + [1] * 20 and len({r.doc_id for r in got}) == 30
    some = quality.labelled(docs, labels, "toxic", F.lit(True), (10, 20), 45, 400).collect()
    assert 0 < sum(len(r.raw) for r in some) <= 400 and max(len(r.raw) for r in some) <= 45 and {r.doc_id for r in some} <= {r.doc_id for r in got}


def test_phrase_of_several_words_at_any_place():
    """A phrase whose words are all common in clean texts, over window edges as well."""
    random = np.random.default_rng(4)
    common = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(8)]
    phrase = [common[i] for i in (3, 17, 29, 8)]

    def text(n, toxic):
        words = list(random.choice(common, n))
        for _ in range(toxic):
            k = random.integers(n - 4)
            words[k : k + 4] = phrase
        return " ".join(words).encode()

    y = np.arange(700) % 2
    net = toxicity.fit([text(120, int(t)) for t in y], y.astype(np.float32), epochs=14)
    truth = np.arange(300) % 2
    assert (((net.scores([text(150, int(t)) for t in truth]) >= 0.5) == truth).mean()) > 0.85


def test_windows_cover_the_text():
    for n in (0, 1, 32, 33, 60, 1000):
        starts = toxicity.windows_of(n)
        assert {i for s in starts for i in range(s, min(s + toxicity.WINDOW, n))} == set(range(n))


def test_one_toxic_window_in_a_very_long_text():
    clean = [b"the cat sat on the mat and the dog lay down by the door " * 3] * 30
    toxic = [b"the cat sat on the zorble mat and the zorble dog lay down by the door " * 3] * 30
    net = toxicity.fit(clean + toxic, np.array([0] * 30 + [1] * 30, np.float32))
    s = net.scores([clean[0] * 500, clean[0] * 250 + toxic[0] + clean[0] * 250, b"", b"..."])
    assert s[0] < 0.5 <= s[1] and s[2] == s[3]


CASES = [(1, None), (2, ""), (3, "word " * 60_000), (3, "word " * 60_000), (None, "x"), (4, "ÀÉ 漢字")]


@pytest.mark.parametrize("query", [quality.op10_quality_ranking, toxicity.op4_toxicity_bigru])
def test_cases(spark, table, query):
    table("documents", spark.createDataFrame([(*c, "s", 0.5) for c in CASES], "doc_id bigint, text string, score string, predicted double"))
    for labels in ([], [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 7, 7), (3, 1, 1), (3, 0, 0)]):
        folder = table("labels", spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        assert len(query(spark, folder).collect()) == len(CASES)
    folder = table("documents", spark.createDataFrame([], "doc_id bigint, text string"))
    assert query(spark, folder).count() == 0


def test_ranking_orders_pairs():
    random = np.random.default_rng(3)
    x = random.standard_normal((400, 5))
    y = (x[:, 0] - 0.5 * x[:, 1] > 0.6).astype(int)
    m = quality.fit(x, y)
    s = m.score(x)
    assert ((s >= 0.5) == y).mean() > 0.95 and np.corrcoef(m.raw(x), x[:, 0] - 0.5 * x[:, 1])[0, 1] > 0.95


def test_ranking_learns_from_every_labelled_row(spark, table, monkeypatch):
    from pyspark.sql import functions as F

    random = np.random.default_rng(6)
    words = ["one", "Two", "3", "four.", "five,", "Six", "77", "eight!"]
    texts = [" ".join(random.choice(words, random.integers(1, 12))) for _ in range(15_000)]
    y = np.array([int(t.count("7") + random.random() * 3 > 2) for t in texts])
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(3, None), (None, 1), (99_999, 1)], "doc_id int, quality int")
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "x"), (50_000, "x")], "doc_id bigint, text string")
    rows = quality.training_rows(docs, labels, F.lit(True))
    assert rows.count() == len(texts) and rows.agg(F.sum("label")).first()[0] == y.sum() and y.sum() > 6000
    x = np.array([quality.features(t.encode()) for t in texts])
    monkeypatch.setattr(quality, "RESULTS", 1)  # sums of sums
    got, want = quality.train(docs.repartition(5), labels, F.lit(True)), quality.fit(x, y)
    assert np.allclose(got.centre, x.mean(axis=0)) and np.allclose(got.scale[x.std(axis=0) > 1e-9], x.std(axis=0)[x.std(axis=0) > 1e-9])
    assert np.allclose(got.weights, want.weights, atol=1e-6) and np.isclose(got.threshold, want.threshold) and np.isclose(got.spread, want.spread)
    assert np.isclose(got.threshold, np.quantile(got.raw(x), 1 - y.mean()))


def test_files_of_training_rows_follow_rows(spark, monkeypatch):
    """Many shuffle partitions that are not coalesced make no small files."""
    from pyspark.sql import functions as F

    made, write = {}, quality.durable
    monkeypatch.setattr(quality, "durable", lambda df, name: made.update({name: write(df, name)}) or made[name])
    monkeypatch.setattr(quality, "release", lambda df: None)
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    docs = spark.createDataFrame([(i % 900, f"word {i}") for i in range(1000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(950)], "doc_id bigint, quality int")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = quality.training_rows(docs, labels, F.lit(True))
        assert rows.count() == 1000 and rows.agg(F.sum("label")).first()[0] == sum(i % 900 % 2 for i in range(1000))
        assert made["quality-labels"].count() == 950
        assert {name: len(df.inputFiles()) for name, df in made.items()} == {"quality-labels": 4, "quality-rows": 4}
        monkeypatch.setattr(quality, "FILE_BYTES", 1 << 10)
        assert quality.files(spark, 950, 16) == 15 and quality.files(spark, 10, 16) == 4
        assert len(quality.training_rows(docs, labels, F.lit(True)).inputFiles()) > 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ranking_slope_over_all_pairs_is_zero():
    random = np.random.default_rng(8)
    x = random.standard_normal((3000, 6))
    y = (x[:, 0] - x[:, 1] + random.standard_normal(3000) > 0.8).astype(int)
    m = quality.fit(x, y)
    z, s = m.standard(x), m.raw(x)
    lost = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0]))
    slope = lost.mean(axis=0) @ z[y == 0] / (y == 0).sum() - lost.mean(axis=1) @ z[y == 1] / (y == 1).sum() + quality.DECAY * m.weights
    assert abs(slope).max() < 1e-5


def test_order_of_scores_is_exact(monkeypatch):
    monkeypatch.setattr(quality, "MANY", 5)
    random = np.random.default_rng(9)
    x = np.concatenate([random.standard_normal(500), np.full(300, 0.123), 0.123 + random.random(200) * 1e-9, [-1e3, 1e3]])[:, None]
    y = np.arange(len(x)) % 2
    ranker = quality.Ranker(np.zeros(1), np.ones(1), np.ones(1), 0.0, 1.0)
    s = ranker.raw(x)
    total = lambda f: quality.added(f(x[a : a + 100], y[a : a + 100]) for a in range(0, len(x), 100))
    asked = [((0, 1), k) for k in range(0, len(x), 37)] + [((1,), k) for k in (0, 200, 400, 500)]
    assert quality.smallest(total, ranker, asked) == [np.sort(s[np.isin(y, sides)])[k] for sides, k in asked]
