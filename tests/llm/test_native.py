"""The operators that SQL expresses, against their SQL: on a table and on rows of defined cases."""

import math
import os
import random
from collections import Counter

import duckdb
import pytest

from tarnwater.llm import chat, licenses, mixing

SF = "/root/testdata/sf0.01"
NAMES = {"op3_mixing_temperature": mixing, "op7_license_scan": licenses, "op8_chat_snapshots": chat}


def same(spark, name, folder, tables=("documents", "conversations")):
    con = duckdb.connect()
    for t in tables:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    df = NAMES[name].QUERIES[name](spark, folder)
    want = con.execute(NAMES[name].ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    rows = want.fetchall()
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(rows, key=key)
    return rows


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    assert same(spark, name, SF)


DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, epoch string, license string, _src string"


def test_documents_cases(spark, table):
    r = random.Random(1)
    lines = [t for _, t in licenses.TEMPLATES]
    rows = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (3, "Released under the MIT License.", "b"), (3, "Released under the MIT License.", "b")]
    rows += [(10 + i, "\n".join([" ".join(r.choice("abcdef") for _ in range(r.randint(0, 60))), r.choice(lines).upper().replace(" the ", r.choice([" the ", " "]))]), r.choice(["big", "big", "big", "s", "ü", None])) for i in range(300)]
    rows += [(999, "long " * 50_000, "long"), (1000, "licensed under " * 30_000, "long")]
    folder = table("documents", spark.createDataFrame([(i, t, None, s, 0, "c", "c", "c") for i, t, s in rows], DOC))
    assert len(same(spark, "op3_mixing_temperature", folder)) >= 200
    assert len(same(spark, "op7_license_scan", folder)) >= 200
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == mixing.draws(docs).count()
    assert max(x["epoch"] for x in mixing.draws(docs).collect()) < mixing.REPEATS
    folder = table("documents", spark.createDataFrame([], DOC))
    assert not same(spark, "op3_mixing_temperature", folder) and not same(spark, "op7_license_scan", folder)


def test_weights_meet_target_and_budget(spark):
    """Temperature mixing by its definition: entropy, repetition limit, and what the schedule gives each source."""
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), s) for i, s in enumerate(r.choices("abcde", [60, 25, 10, 4, 1], k=4000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    totals = Counter()
    for _, text, s in rows:
        totals[s] += len(text.split())
    everything = sum(totals.values())
    entropy = lambda ws: -sum(w * math.log(w) for w in ws if w)
    natural = entropy([t / everything for t in totals.values()])
    for evenness, repeats in ((0.5, 100), (0.9, 100), (1.0, 2), (0.0, 4)):
        sources = spark.createDataFrame(list(totals.items()), "_src string, total bigint")
        got = {x["_src"]: x for x in mixing.weights(sources, evenness, repeats).collect()}
        weights = [x.weight for x in got.values()]
        assert abs(sum(weights) - 1) < 1e-6
        target = natural + evenness * (math.log(len(totals)) - natural)
        most = max(x.weight * everything / x.total for x in got.values())
        assert most <= repeats + 1e-3
        assert abs(entropy(weights) - target) < 1e-6 or abs(most - repeats) < 1e-3 and entropy(weights) < target
        drawn = Counter()
        for x in mixing.draws(docs, evenness, repeats).collect():
            drawn[x.source] += x.n_tokens
        for s, x in got.items():
            assert x.budget - 41 < drawn[s] <= x.budget and x.budget == int(x.weight * everything)


def test_wrapped_and_whole_licences(spark, table):
    t = dict(licenses.TEMPLATES)
    mit = "Copyright (c) 2020 Some One\n\n" + t["mit-text"]
    odd = licenses.normalise(t["isc-text"])
    rows = [
        (1, "some words first.\nThis work is licensed under the GNU\nGeneral Public License,\n * version 3.\nand more"),
        (2, "Short one. Released under the MIT License. Another short one."),
        (3, mit), (4, "intro words " * 5000 + mit + " more words" * 5000), (5, t["mit-text"] * 3),
        (6, " ".join(w for i, w in enumerate(odd) if i % 20)), (7, " ".join(odd[: len(odd) * 3 // 4])), (8, " ".join(odd[: len(odd) // 2])), (9, "license software copyright permission"),
        (10, t["bsd-2-clause-text"]), (None, t["zlib-text"].upper()), (None, t["zlib-text"].upper()),
    ]
    folder = table("documents", spark.createDataFrame([(*x, "k", 0) for x in rows], "doc_id bigint, text string, license string, p int"))
    got = same(spark, "op7_license_scan", folder)
    found = sorted((g[0] or 0, g[3]) for g in got)
    assert found == sorted(
        [(0, "zlib-text")] * 2 + [(1, "gpl-3.0"), (2, "mit"), (3, "mit-text"), (4, "mit-text")] + [(5, "mit-text")] * 3 + [(6, "isc-text"), (7, "isc-text"), (10, "bsd-2-clause-text"), (10, "bsd-3-clause-text")]
    )
    assert next(g for g in got if g[0] == 4)[1] == 10_000 + 5 and all(0.8 <= g[4] <= 1 for g in got)
    crowd = spark.createDataFrame([(1, "Released under the MIT License. " * 3000)], "doc_id bigint, text string")
    assert licenses.scan(crowd).where("license = 'mit' AND dice = 1").count() == 3000


def test_very_many_equal_turns(spark, table):
    """Turns of one number, or of none, spread over the tasks and keep the order of role and text."""
    n = 100_000
    rows = spark.range(n).selectExpr("7 AS conv_id", "if(id % 2 = 0, 3, null) AS turn", "'user' AS role", "if(id % 4 < 2, 'same', concat('t', id)) AS text")
    folder = table("conversations", rows)
    got = {r.chunk: r for r in chat.op8_chat_snapshots(spark, folder).collect()}
    assert len(got) == -(-n // chat.CHUNK) and sum(r.n_turns for r in got.values()) == n
    texts = "".join(got[k].rendered for k in sorted(got)).split("<|im_start|>user\n")[1:]
    want = sorted((("same" if i % 4 < 2 else f"t{i}") for i in range(1, n, 2))) + sorted((("same" if i % 4 < 2 else f"t{i}") for i in range(0, n, 2)))
    assert [t.removesuffix("<|im_end|>\n") for t in texts] == want
    parts = chat._in_order(chat._light(rows).drop("text").withColumn("s", chat.F.monotonically_increasing_id()), ["cid", "turn", "role", "s"])
    sizes = [r["count"] for r in parts.groupBy(chat.F.shiftright("at", 33)).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * n


def test_conversation_cases(spark, table, monkeypatch):
    r = random.Random(2)
    rows = []
    for c in range(60):
        n = r.randint(1, 6)
        rows += [(c, i, ["user", "assistant"][i % 2], r.choice("ab") if i else "hi", None) for i in range(n)]
    rows += [(100, i, "user", "x", "e") for i in range(700)] + [(101, i, "user", "x", "e") for i in range(600)]
    rows += [(None, 0, None, None, None), (None, None, "user", "", None), (200, 0, None, None, None), (201, 0, "", "", None), (202, 5, "user", "hi", None), (202, 5, "user", "hi", None)]
    folder = table("conversations", spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, chunk string"))
    got = same(spark, "op8_chat_snapshots", folder)
    assert len({g[0] for g in got}) < 40 and sum(g[0] == 100 for g in got) == 3 and not any(g[0] == 101 for g in got)
    monkeypatch.setattr(chat, "LONG", 10)  # both ways of rendering
    assert len(same(spark, "op8_chat_snapshots", folder)) == len(got)
    folder = table("conversations", spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert not same(spark, "op8_chat_snapshots", folder)
