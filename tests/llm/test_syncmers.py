import hashlib
import random

import pytest

from tarnwater.llm import syncmers as m

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, top string, range string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgéß漢") for _ in range(r.randint(1, 8))) for _ in range(n))


def brute(text):
    found = []
    if 0 < len(text) < m.K:
        return [0]
    for i in range(len(text) - m.K + 1):
        inner = [text[i + j : i + j + m.S] for j in range(m.K - m.S + 1)]
        hashes = [hash_of(x) for x in inner]
        if min(hashes) in (hashes[0], hashes[-1]):
            found.append(i)
    return found


def hash_of(smer):
    h = 0
    for c in smer:
        h = (h * int(m._B) + ord(c) + 1) % 2**64
    import numpy as np

    return int(m._mix(np.array([h], np.uint64))[0])


@pytest.mark.parametrize("text", ["", "a", "abc" * 5, "x" * 40, prose(1, 60), prose(2, 9)])
def test_anchors_match_brute_force(text):
    assert m.anchors(text)[0].tolist() == brute(text)


def test_likeness_and_matches():
    a = prose(3, 400)
    b = m.edited(a, prose(4, 400))
    assert m.likeness(m.fingerprint(a), m.fingerprint(a)) == 1
    assert 0.35 < m.likeness(m.fingerprint(a), m.fingerprint(b)) < 0.65
    assert m.likeness(m.fingerprint(a), m.fingerprint(prose(5, 400))) < 0.1
    assert m.likeness(m.fingerprint(""), m.fingerprint(None)) == 1 and m.likeness(m.fingerprint(""), m.fingerprint(a)) == 0
    start, other, length = max(m.matches("zz" + a, b), key=lambda x: x[2])
    assert start - other == 2 and length > len(a) // 2
    for x, y, n in m.matches("zz" + a, b):
        assert ("zz" + a)[x : x + n] == b[y : y + n]


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_query_against_brute_force(spark, table, n):
    texts = {i * 7: prose(i, i % 40) if i % 9 else None for i in range(n)}
    if n > 3:
        texts[21] = "y" * 50_000
    folder = table("documents", spark.createDataFrame([(i, t, None, None, None, "c", "d") for i, t in texts.items()], DOCS))
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in m.op1_syncmer_fingerprints(spark, folder).collect()}
    assert sorted(got) == sorted(texts)
    for i, d in enumerate(order):
        text, after = texts[d] or "", texts[order[(i + 1) % n]] or ""
        changed = m.edited(text, after)
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[d].fingerprint == m.fingerprint(text) and got[d].edited_fingerprint == m.fingerprint(changed)
        assert got[d].near_next == m.likeness(m.fingerprint(text), m.fingerprint(after))


def test_repeated_rows_and_null_ids(spark, table):
    rows = [(5, "b" * 30), (5, "a" * 30), (5, "a" * 30), (None, "c" * 30), (None, None)]
    folder = table("documents", spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOCS))
    got = m.op1_syncmer_fingerprints(spark, folder).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2
    assert m.fingerprints(spark.read.parquet(f"{folder}/documents.parquet")).count() == 5
