import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnwater.llm import simhash as m
from tarnwater.llm.components import connected_components


def brute_fp(text):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "A b", "The É x  quick\x0bbrown FOX", "a b c d " * 50])
def test_fingerprint(spark, text):
    assert m.simhash((text or "").encode()) == brute_fp(text)
    one = spark.createDataFrame([(text,)], "t string").select(F.xxhash64(F.coalesce("t", F.lit(""))).alias("h")).first()
    assert one.h == m.signed(xxhash.xxh64_intdigest((text or "").encode(), 42))


def cluster(r, n):
    centres = [r.getrandbits(64) for _ in range(3)]
    out = set()
    while len(out) < n:
        x = r.choice(centres)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


def test_index_search():
    r = random.Random(1)
    fps = np.array(cluster(r, 500), np.uint64)
    index = m.GrayIndex(fps)
    q, at = index.search(fps)
    got = {(int(fps[i]), int(index.fps[j])) for i, j in zip(q, at)}
    assert got == {(int(a), int(b)) for a in fps for b in fps if int(a ^ b).bit_count() <= 2}
    assert not len(m.GrayIndex(fps[:0]).search(fps)[0])


def test_index_of_wide_fingerprints(monkeypatch):
    """The pipeline's candidates are searched in Gray order from the top of an index over both words, which prunes groups."""
    r = random.Random(11)
    fps = [r.getrandbits(128) for _ in range(150)]
    fps += [x ^ sum(1 << b for b in r.sample(range(128), r.randint(1, 45))) for x in fps[:40] * 5] + [0, 1, 2**128 - 1, fps[0]]
    hi, lo = (np.array([x >> shift & 2**64 - 1 for x in fps], np.uint64) for shift in (64, 0))

    def place(x):
        for shift in (1, 2, 4, 8, 16, 32, 64):
            x ^= x >> shift
        return x

    index = m.GrayIndex(np.stack([hi, lo], axis=1))
    assert [place(fps[i]) for i in index.order] == sorted(map(place, fps))
    near = {(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if (a ^ b).bit_count() <= m.RADIUS}
    q, at = index.search(index.fps, m.RADIUS)
    assert set(zip(index.order[q].tolist(), index.order[at].tolist())) == near and len(q) == len(near)
    searches, search = [], m.GrayIndex.search
    monkeypatch.setattr(m.GrayIndex, "search", lambda *a: searches.append(a) or search(*a))
    monkeypatch.setattr(m, "PAIRS_AT_ONCE", 4096)
    n = np.array([r.randint(60, 100) for _ in fps])
    pairs = [(i, j) for x, y in m.near_pairs(hi, lo, n, 0.8) for i, j in zip(x.tolist(), y.tolist())]
    want = {(i, j) for i, j in near if i < j and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) - 1e-6}
    assert sorted((min(p), max(p)) for p in pairs) == sorted(want) and len(searches) > 5
    for few in (0, 1):
        assert all(not len(x) for x, _ in m.near_pairs(hi[:few], lo[:few], n[:few], 0.8))


def test_links_find_every_component(spark):
    r = random.Random(2)
    fps = cluster(r, 900) + [0, 2**64 - 1, 2**63]
    edges = m.links(spark.createDataFrame([(m.signed(x),) for x in fps], "fp bigint"))
    roots = {x.node: x.root for x in connected_components(edges).collect()}
    want = brute_components(fps)
    by_root = {}
    for f, w in zip(fps, want):
        by_root.setdefault(w, set()).add(roots.get(m.signed(f), m.signed(f)))
    assert all(len(v) == 1 for v in by_root.values()) and len({min(v) for v in by_root.values()}) == len(by_root)


def test_components_of_a_path_and_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (3, 4)], "src bigint, dst bigint")
    assert {(x.node, x.root) for x in connected_components(path).collect()} == {(i, 0) for i in range(41)}
    assert connected_components(path.limit(0)).count() == 0


def test_query_against_brute_force(spark, table):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeé") for _ in range(4)) for _ in range(300)]
    texts = [None, "", " ", "x", "x y"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(3, 900))]
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    rows = [(len(texts) - i, t, "en", "s", 0, "k") for i, t in enumerate(texts)] + [(None, "x", "en", None, None, None)]
    folder = table("documents", spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, fp bigint, component_id string"))
    got = m.op2_simhash_near_dedup(spark, folder).collect()
    fps = [brute_fp(t) for t in [x[1] for x in rows]]
    roots = brute_components(fps)
    ids = {w: min(row[0] for row, x in zip(rows, roots) if x == w and row[0] is not None) for w in roots}
    assert sorted((x.doc_id or 0, x.fingerprint, x.component_id) for x in got) == sorted((row[0] or 0, f"{f:016x}", ids[w]) for row, f, w in zip(rows, fps, roots))
    assert len(set(roots)) < len(rows) - 30
    kept = m.keep_one(spark.read.parquet(f"{folder}/documents.parquet"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(ids.values()))
    twice = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL")
    assert m.keep_one(twice.union(twice)).count() == len(set(ids.values()))
    empty = table("documents", spark.createDataFrame([], "doc_id bigint, text string"))
    assert m.op2_simhash_near_dedup(spark, empty).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "A b c d  e f"), (None, "a b c d e f"), (1, "other words than those there"), (7, "other words than those there"), (None, "nobody knows this one"), (None, "nobody knows this one")]
    docs = spark.createDataFrame([(*x, "k", "row") for x in rows], "doc_id bigint, text string, key string, stays string")
    kept = m.keep_one(docs, 5, 0.8)
    assert kept.columns == docs.columns
    got = sorted((x.doc_id or 0, " ".join(x.text.lower().split())) for x in kept.collect())
    assert got == [(0, "nobody knows this one"), (1, "a b c d e f"), (1, "other words than those there")]


def test_marked_rows_hold_all_matches(spark, monkeypatch):
    from tarnwater.llm import common

    for most in (common.MARK_BITS, 1 << 15):
        monkeypatch.setattr(common, "MARK_BITS", most)
        rows = common.marked(spark.range(0, 60000).select(F.col("id").alias("k")), F.col("k"), spark.range(0, 60000, 7).toDF("x"), "some")
        got = rows.groupBy((F.col("k") % 7 == 0).alias("hit"), "some").count().collect()
        n = {(x.hit, x.some): x["count"] for x in got}
        assert (True, False) not in n and (n[False, True] < 6000 or most == 1 << 15)


def test_planted_near_copies(spark):
    """The pipeline's stage drops near copies of 0.8 of the five-word shingles, and what is less alike stays."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    texts, near, far = [], [], []
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.randint(150, 400))]
        texts.append(" ".join(base))
        for kept, share in ((near, 0.015), (far, 0.1)):
            copy = list(base)
            for i in r.sample(range(len(copy)), round(len(copy) * share)):
                copy[i] = r.choice(words)
            a, b = m.shingle_set(texts[-1].encode(), 5), m.shingle_set(" ".join(copy).encode(), 5)
            assert (len(a & b) >= 0.8 * len(a | b)) == (kept is near)
            kept.append(" ".join(copy))
    crowd = [" ".join(["crowd"] + [f"w{j}" for j in range(200)] + [f"own{i}"]) for i in range(300)]
    rows = [*enumerate(texts + far + near + crowd), (9000, None), (9001, ""), (9002, texts[0].upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {*range(120), 180, 9000}
    import corpus_pipeline

    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
    old = m.NODE, m.GROUP
    m.NODE, m.GROUP = 16, 64  # several tables, and a crowd in parts
    try:
        assert len(m.table_masks(len(rows))) >= 8
        assert {x.doc_id for x in m.keep_one(docs, 5, 0.8).collect()} == want
    finally:
        m.NODE, m.GROUP = old
    assert m.keep_one(docs.limit(0), 5, 0.8).count() == 0


def test_only_own_tables_are_released(spark, tmp_path):
    from tarnwater.llm.common import durable, release

    spark.range(5).write.parquet(f"{tmp_path}/in.parquet")
    docs = spark.read.parquet(f"{tmp_path}/in.parquet")
    own = durable(docs, "own")
    for wrong in (docs, docs.join(own, "id")):
        with pytest.raises(ValueError, match="durable"):
            release(wrong)
    release(own.select("id"))
    assert docs.count() == 5


def test_inputs_outlive_the_search(spark, table):
    """Without a group over ``GROUP`` nothing of the candidates is a table of its own, and the input stays as it is."""
    folder = table("documents", spark.createDataFrame([(i, "a b c d e f g h i j " * 9 + f"own{i % 7}") for i in range(40)], "doc_id bigint, text string"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [x.doc_id for x in m.keep_one(docs, 5, 0.8).collect()] == [0] and docs.count() == 40


def test_large_groups_meet_by_pivots(spark, monkeypatch):
    """Crowds, crowds that only a chain joins, and a chain without middle link as brute force says, in groups of many parts."""
    monkeypatch.setattr(m, "GROUP", 8)
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]

    def changed(base, share):
        copy = list(base)
        for i in r.sample(range(len(copy)), round(len(copy) * share)):
            copy[i] = r.choice(words)
        return copy

    base = [r.choice(words) for _ in range(400)]
    lists = []
    for distance in (0, 0.04, 0.06, 0.08):  # crowds about middles that are themselves near to each other
        middle = changed(base, distance)
        lists += [changed(middle, r.choice((0.002, 0.01))) for _ in range(30)]
    step = changed(base, 0.05)
    for _ in range(40):
        lists.append(step := changed(step, 0.02))
    texts = [" ".join(x) for x in lists] + [" ".join(lists[0]).upper(), "", "a b"]
    r.shuffle(texts)
    sets = [m.shingle_set(t.lower().encode(), 5) for t in texts]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and len(a & b) >= 0.8 * len(a | b)]
    want = list(range(len(texts)))
    for i, j in pairs * 2:  # smallest id of each component
        low, high = sorted((want[i], want[j]))
        want = [low if w == high else w for w in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    judged = []
    keep = m.against_pivot
    monkeypatch.setattr(m, "against_pivot", lambda *a: judged.append(keep(*a)) or judged[-1])
    got = {x.doc_id: x.component_id for x in m.near_duplicates(docs, 5, 0.8).collect()}
    assert got == dict(enumerate(want)) and 4 <= len(set(want)) < 60
    assert len(judged) > 1
