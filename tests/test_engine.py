import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from tarnwater import cli
from tarnwater.engine import BadQuery, Engine, QueryResult, UnknownTable
from tarnwater.plans import suite
from tarnwater.plans.shape import plan_shape
from tarnwater.session import from_environment
from tarnwater.sources import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    for t in ("orders", "nation", "customer", "events"):
        e.register(t.upper(), f"{SF}/{t}.parquet")
    return e


def test_query_and_stats(engine):
    r = engine.query('SELECT n_name AS "value", n_regionkey FROM Nation ORDER BY n_nationkey LIMIT 2;')
    assert r.columns == ["value", "n_regionkey"] and len(r.rows) == 2 and r.stats["mergeStrategy"] == "TOP_K"
    assert engine.recent[-1]["phase"] == "DONE" and not engine.active and engine.status()["status"] == "UP"


@pytest.mark.parametrize(
    "sql,shape",
    [
        ("SELECT * FROM nation", "CONCATENATE"),
        ("SELECT count(*) AS n FROM nation", "PARTIAL_AGG"),
        ("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", "GROUP_BY_MERGE"),
        ("SELECT n, count(*) AS m FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n", "NESTED_GROUP_BY_MERGE"),
        ("WITH r AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT max(n) AS n FROM r", "WITH_CTE_MERGE"),
    ],
)
def test_shapes(engine, sql, shape):
    assert engine.query(sql).stats["mergeStrategy"] == shape


LABELS = {
    "CONCATENATE": (), "WITH_CTE_MERGE": (15,), "NESTED_GROUP_BY_MERGE": (13,), "PARTIAL_AGG": (6, 14, 17, 19), "TOP_K": (2, 20),
    "GROUP_BY_MERGE": (1, 3, 4, 5, 7, 8, 9, 10, 11, 12, 16, 18, 21, 22),
}


@pytest.mark.parametrize("number,label", [(n, label) for label, numbers in LABELS.items() for n in numbers])
def test_shapes_of_the_suite(spark, number, label):
    assert plan_shape(suite.QUERIES[f"q{number:02}"](spark, SF)) == label


@pytest.mark.parametrize("sql", ["", "  ;", "DROP TABLE nation", "CREATE TEMP VIEW x AS SELECT 1", "SELEC 1", "SELECT nope FROM nation", "INSERT INTO nation SELECT * FROM nation"])
def test_refused(engine, sql):
    with pytest.raises(BadQuery):
        engine.query(sql)


def test_unknown_table(engine):
    with pytest.raises(UnknownTable, match="Known tables: customer"):
        engine.query("SELECT * FROM nowhere")


def test_nulls_stay_nulls(spark, engine):
    spark.createDataFrame([("", 1), (None, 2), ("", 3)], "k string, v int").createOrReplaceTempView("nulls")
    assert sorted(engine.query("SELECT k, count(*) AS n, min(v) AS v FROM nulls GROUP BY k").rows, key=str) == [("", 2, 1), (None, 1, 2)]
    assert engine.query("SELECT k FROM nulls WHERE v NOT IN (SELECT CAST(NULL AS INT))").rows == []
    assert engine.query("SELECT sum(v) AS s, count(v) AS n FROM nulls WHERE v > 9").rows == [(None, 0)]


def test_ingest(spark, tmp_path):
    rows = ingest.demo_rows(spark, 50)
    assert rows.where("id = 3").first() == (3, "event-3", 30, "A")
    rows.coalesce(1).write.option("header", True).csv(f"{tmp_path}/demo.csv")
    back = ingest.read_file(spark, f"{tmp_path}/demo.csv")
    assert sorted(back.collect()) == sorted(rows.collect())
    manifest = ingest.write_sharded(back, f"{tmp_path}/shards.parquet", "id", 6)
    assert sum(manifest["rows"].values()) == 50 and manifest["shards"] == 6
    with pytest.raises(ValueError, match="unsupported"):
        ingest.read_file(spark, "x.orc")


def test_shards(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id % 100 AS k", "id AS v")
    first, second = f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"
    manifest = ingest.write_sharded(rows, first, "k", 6)
    shards = {}
    for r in spark.read.parquet(first).collect():
        shards.setdefault(r.k, set()).add(r[ingest.SHARD])
    assert len(shards) == 100 and all(len(s) == 1 for s in shards.values())
    assert len(manifest["rows"]) == 6 and max(manifest["rows"].values()) < 2.5 * 1000 / 6
    assert all(len([f for f in p.iterdir() if f.suffix == ".parquet"]) == 1 for p in (tmp_path / "a.parquet").iterdir() if p.is_dir())
    assert ingest.redistribute(spark, first, second, 4)["shards"] == 4
    back, said = ingest.read_sharded(spark, second)
    assert sorted(back.collect()) == sorted(rows.collect()) and said["key"] == "k" and len(said["rows"]) == 4
    with pytest.raises(ValueError, match="another folder"):
        ingest.redistribute(spark, first, first, 3)


def test_tasks_write_one_file_of_a_large_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FILE_ROWS", 100, raising=False)
    rows, path = spark.range(1000).selectExpr("id AS k", "id AS `v.w`", "map('a', id) AS m"), f"{tmp_path}/a.parquet"
    runs = spark._jsparkSession.sharedState().statusStore()
    manifest = ingest.write_sharded(rows, path, "k", 6)
    files = {p.name: [f.name for f in p.iterdir() if f.suffix == ".parquet"] for p in (tmp_path / "a.parquet").iterdir() if p.is_dir()}
    assert {s: len(f) for s, f in files.items()} == {f"{ingest.SHARD}={s}": -(-n // 100) for s, n in manifest["rows"].items()}
    tasks = [f.split("-")[1] for names in files.values() for f in names]
    assert len(set(tasks)) == len(tasks)
    plans = [runs.executionsList().apply(i).physicalPlanDescription() for i in range(runs.executionsList().size())]
    writes = [p for p in plans if path in p and "Execute InsertIntoHadoopFsRelationCommand" in p]
    assert writes and not any("Sort" in p for p in writes) and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    back, _ = ingest.read_sharded(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_placement_groups_after_rows_met_by_key(spark, monkeypatch):
    monkeypatch.setattr(ingest, "FILE_ROWS", 100, raising=False)
    placed = ingest._placement(ingest.with_shard(spark.range(2000).selectExpr("id % 1000 AS k", "id AS v"), "k", 6), "k")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k") == 1 and "20), REPARTITION_BY_NUM" in plan
    assert placed.first() == (2000, 1000, 6, 1000, True)


def test_refresh_sees_new_files(spark, tmp_path):
    engine, path = Engine(spark), f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    engine.register("grows", path)
    assert engine.query("SELECT count(*) AS n FROM grows").rows == [(3,)]
    spark.range(2).write.mode("append").parquet(path)
    engine.refresh("grows")
    assert engine.query("SELECT count(*) AS n FROM grows").rows == [(5,)]


def test_concurrent_queries_match(engine):
    sql = ["SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", "SELECT count(*) AS n FROM customer", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 3"]
    want = [sorted(engine.query(q).rows) for q in sql]
    with ThreadPoolExecutor(10) as pool:
        got = list(pool.map(lambda i: (i, sorted(engine.query(sql[i % 3]).rows)), range(30)))
    assert all(rows == want[i % 3] for i, rows in got) and not engine.active and len(engine.recent) <= engine.RECENT


def test_large_results_are_streamed_or_refused(spark, caplog):
    engine = Engine(spark, most_rows=10, log_plans=True)
    with caplog.at_level("INFO", "tarnwater"):
        assert len(engine.query("SELECT id FROM range(10)").rows) == 10
    assert "Physical Plan" in caplog.text
    with pytest.raises(BadQuery, match="over 10 rows"):
        engine.query("SELECT id FROM range(11)")
    columns, rows = engine.stream("SELECT id FROM range(1000) ORDER BY id")
    assert columns == ["id"] and [r[0] for r in rows] == list(range(1000))


def test_names_workers_and_partitions(engine):
    assert engine.query("SELECT count(*), max(n_nationkey) FROM nation").columns == ["count", "max(n_nationkey)"]
    assert engine.query("SELECT count(*), count(*) FROM nation").columns == ["count(1)", "count(1)"]
    assert all(w["address"] and w["tasks"] >= 0 and w["load"] >= 0 for w in engine.workers()) and engine.workers()
    seen = engine.monitor()
    assert seen["partitions"]["nation"][0]["partition"] == 0 and seen["status"]["workers"] == len(seen["workers"])


def test_settings_from_environment():
    assert from_environment({"TARNWATER_MASTER": "local[2]", "TARNWATER_BROADCAST_BYTES": "1m", "TARNWATER_EXECUTORS": "", "HOME": "x"}) == {"spark.master": "local[2]", "spark.sql.autoBroadcastJoinThreshold": "1m"}


def test_validation_runs_nothing(engine, capsys):
    before = len(engine.recent)
    assert cli.show(engine, "SELECT * FROM nowhere", "table") == 1 and len(engine.recent) == before
    assert "unknown table" in capsys.readouterr().err
    assert cli.show(engine, "SELECT * FROM nowhere", "table", validate=False) == 1 and engine.recent[-1]["phase"] == "FAILED"


def test_command_line(engine, capsys, tmp_path):
    nation = ["--table", f"nation={SF}/nation.parquet", "--format", "json"]
    assert cli.main([*nation, "query", "SELECT count(*) AS n FROM nation"]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == [[25]]
    (tmp_path / "q.sql").write_text("SELECT 7 AS n;")
    assert cli.main([*nation, "query", "-f", str(tmp_path / "q.sql")]) == 0 and "7" in capsys.readouterr().out
    assert cli.main([*nation, "status"]) == 0 and json.loads(capsys.readouterr().out)["status"] == "UP"
    assert cli.main([*nation, "workers"]) == 0 and json.loads(capsys.readouterr().out)
    assert cli.main([*nation, "query", "SELECT * FROM nowhere"]) == 1
    for wrong in (["--table", "nation", "status"], ["query", "-f", f"{tmp_path}/none.sql"], ["query", " "], []):
        assert cli.main(wrong) == 2
    capsys.readouterr()
    assert cli.shell(engine, "json", ["SELECT 1 AS a\n", "\\workers\n", "\\nope\n", "SELECT\n", "2 AS b\n", ";\n", "exit\n", "SELECT 3 AS c;\n"]) == 0
    out = capsys.readouterr()
    assert '"rows": [[1]]' in out.out and '"rows": [[2]]' in out.out and "[[3]]" not in out.out and "unknown command" in out.err
    wide = cli.as_table(QueryResult("x", ["a" * 30, "b"], [("y" * 90, "z" * 90), (None, "l\nm")]), screen=50)
    assert max(map(len, wide.splitlines()[:-1])) <= 50 and "NULL" in wide and "..." in wide and len(wide.splitlines()) == 5


def test_cli(engine, capsys):
    assert cli.show(engine, "SELECT 1 AS a, NULL AS b", "table") == 0
    assert "NULL" in (out := capsys.readouterr().out) and "(1 row in" in out
    assert cli.show(engine, "SELECT 1 AS a", "json", True) == 0 and json.loads(capsys.readouterr().out)["rows"] == [[1]]
    assert cli.show(engine, "nonsense", "table") == 1
    assert cli.shell(engine, "table", ["\\tables\n", "SELECT\n", "1 AS a;\n", "\\q\n"]) == 0
    assert "orders" in capsys.readouterr().out
