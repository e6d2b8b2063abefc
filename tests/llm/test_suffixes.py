import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tarnwater.llm import suffixes as m

L = m.LENGTH


def noise(r, n):
    return "".join(r.choice("abcdefgh é") for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    passage = [noise(r, 900) for _ in range(4)]
    texts = [None, "", "short", "x" * 399, "y" * 400, "z" * 1500, "ab" * 700, passage[0], passage[0]]
    for i in range(60):
        p = r.choice(passage)
        a, n = r.randrange(300), r.choice([50, 390, 400, 401, 450, 600])
        texts.append(noise(r, r.randrange(500)) + p[a : a + n] + noise(r, r.randrange(500)))
    near = noise(r, 2500)
    for _ in range(8):
        k = r.randrange(2500)
        texts.append(near[:k] + "#" + near[k + 1 :])
    texts.append(near[:1200] + noise(r, 10) + near[:1200])
    return texts


def brute_runs(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        yield r, m._runs(gone[:-1])


def brute(texts):
    shared = [sum(b - a for a, b in runs) for _, runs in brute_runs(texts, m.PASSAGE)]
    return [(len(r), sum(b - a for a, b in runs), len(runs), hashlib.sha256(m.cut(r, runs)).hexdigest(), n) for (r, runs), n in zip(brute_runs(texts, L), shared)]


@pytest.mark.parametrize("text", ["z" * 900, "ab" * 700, noise(random.Random(1), 700), noise(random.Random(2), 3000) + "q" * 900])
def test_every_window_has_one_owner(text):
    raw = text.encode()
    owned = [s for start, n, _, _ in m.spans(raw) for s in range(start, start + n)]
    assert sorted(owned) == list(range(len(raw) - L + 1))
    h = m.gram_hashes(raw)
    for start, n, place, value in m.spans(raw):
        for s in range(start, start + n):
            assert place == s + int(h[s : s + m.reach(L)].argmin()) and h[place] == value


def test_refine_against_counting():
    r = random.Random(3)
    p = noise(r, 1000)
    raw = (noise(r, 300) + p + noise(r, 77) + p[100:800] + noise(r, 30)).encode()
    w = np.arange(len(raw) - L + 1)
    seen = Counter(raw[i : i + L] for i in w)
    assert m.refine(np.frombuffer(raw, np.uint8), w).tolist() == [seen[raw[i : i + L]] > 1 for i in w]


@pytest.mark.parametrize("hot", [m.HOT, 2])
def test_query_against_brute_force(spark, table, monkeypatch, hot):
    monkeypatch.setattr(m, "HOT", hot)
    texts = corpus(hot)
    rows = [(i if i != 3 else None, t, "k", "th", "raw") for i, t in enumerate(texts)] + [(20, texts[20], "k", "th", "raw")]
    folder = table("documents", spark.createDataFrame(rows, "doc_id bigint, text string, a string, th string, raw string"))
    got = m.op5_suffix_array_dedup(spark, folder).collect()
    want = brute([r[1] for r in rows])
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted((-1 if row[0] is None else row[0], *w) for row, w in zip(rows, want))
    if hot == 2:
        return
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = m.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert {r.doc_id: r.text for r in kept.collect()}[5] == "" and kept.where("doc_id = 0").first().text is None


def test_periodic_texts_are_few_rows(spark, table):
    r = random.Random(4)
    line = noise(r, 9)
    texts = ["z" * 3000, "z" * 401, line * 500, noise(r, 300) + line * 90 + noise(r, 300), noise(r, 700) + line * 60, line * 44 + "##", noise(r, 450)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = m.anchored(docs).collect()
    assert len(rows) == len({(x.th, x.a, x.sh) for x in rows}) < 100
    assert sum(x.times * x.n for x in rows) == sum(max(0, len(t.encode()) - L + 1) for t in texts)
    got = m.op5_suffix_array_dedup(spark, table("documents", docs)).collect()
    assert [tuple(x)[1:] for x in sorted(got)] == brute(texts)


@pytest.mark.parametrize("hot", [m.HOT, 2])
def test_shorter_strings_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(m, "HOT", hot)
    r = random.Random(5)
    passages = [noise(r, n) for n in (250, 300, 390)]
    texts = [None, "", "z" * 500, *(noise(r, r.randrange(200, 900)) for _ in range(20))]
    for p in passages * 4:
        texts.append(noise(r, r.randrange(300)) + p + noise(r, r.randrange(300)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.text for x in m.deduplicate(docs, 240).collect()}
    for i, (raw, runs) in enumerate(brute_runs(texts, 240)):
        assert (got[i] or "") == m.cut(raw, runs).decode("utf-8", "ignore")
    assert all(p not in (t or "") for p in passages for t in got.values())
    assert all(got[i] == texts[i] for i in range(3, 23))


def test_empty(spark, table):
    folder = table("documents", spark.createDataFrame([], "doc_id bigint, text string"))
    assert m.op5_suffix_array_dedup(spark, folder).count() == 0
