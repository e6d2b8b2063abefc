"""Reading files by their extension, and writing them hash-partitioned."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DatetimeType, NumericType, StringType

from tarnwater.session import table

SHARD = "_shard"
#: Rows for which a shard gets one more file, and a grouping one more task: what a task handles does not grow with the table.
FILE_ROWS = 1 << 20
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A ``.csv`` file (header, inferred types) or a ``.parquet`` file or folder."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {kind or '(none)'} of {path}: csv or parquet expected")


def with_shard(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with the number of the shard to which its key hashes."""
    return df.withColumn(SHARD, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def write_sharded(df: DataFrame, path: str, key: str, n: int) -> dict:
    """Write ``n`` hash partitions as folders and return the manifest, which lies beside them.

    A folder holds one file, or one for each ``FILE_ROWS`` rows begun, to which
    its rows are dealt by a hash of all their values.  A task writes one file as
    its rows come: tasks of several shards would have to sort them in memory first.
    """
    spark, sharded = df.sparkSession, with_shard(df, key, n)
    files = [1] * n
    for r in sharded.groupBy(SHARD).count().collect():
        files[r[SHARD]] = -(-r["count"] // FILE_ROWS)
    firsts = [sum(files[:i]) for i in range(n)]
    values = [F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema if isinstance(f.dataType, (NumericType, StringType, DatetimeType, BinaryType))]
    file = F.get(F.lit(firsts), F.col(SHARD)) + F.pmod(F.xxhash64(F.lit("file"), *values), F.get(F.lit(files), F.col(SHARD)))
    dealt = sharded.repartitionById(sum(files), file.cast("int"))
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, "1")  # with none, Spark sorts the rows of a task by the folder even where it is one
    try:
        dealt.write.partitionBy(SHARD).mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_WRITERS, before)
    rows = spark.read.parquet(path).groupBy(SHARD).count().collect()
    manifest = {"key": key, "shards": n, "rows": {str(r[SHARD]): r["count"] for r in sorted(rows)}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.manifest")
    return manifest


def read_sharded(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows of :func:`write_sharded` without the shard's number, and the manifest."""
    manifest = json.loads(spark.read.text(f"{path.rstrip('/')}.manifest").first().value)
    return spark.read.parquet(path).drop(SHARD), manifest


def redistribute(spark: SparkSession, path: str, target: str, n: int) -> dict:
    """Write the shards of ``path`` anew as ``n`` shards of the same key in ``target``, without the source of the rows."""
    if target.rstrip("/") == path.rstrip("/"):
        raise ValueError("the target must be another folder than the source")
    rows, manifest = read_sharded(spark, path)
    return write_sharded(rows, target, manifest["key"], n)


def demo_rows(spark: SparkSession, n: int) -> DataFrame:
    """id, name, score, category of n made-up events."""
    i = F.col("id").cast("int")
    category = F.when(i % 3 == 0, "A").when(i % 3 == 1, "B").otherwise("C")
    return spark.range(1, n + 1).select(i.alias("id"), F.concat(F.lit("event-"), i.cast("string")).alias("name"), (i * 10).alias("score"), category.alias("category"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the warehouse, which all executors share; it goes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get('spark.sql.warehouse.dir')}/tarnwater-scratch/{uuid.uuid4().hex}{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def _placement(sharded: DataFrame, key: str) -> list:
    """Aggregates of shard and key: rows, keys, shards, keys of one shard only, and whether no shard holds 1.5 times its share.

    Rows meet by key before they are grouped, as grouping what a scan reads would hold all keys of its part of a file.
    """
    tasks = max(sharded.sparkSession.sparkContext.defaultParallelism, -(-sharded.count() // FILE_ROWS))
    keys = sharded.select(key, SHARD).repartition(tasks, key).groupBy(key).agg(F.count("*").alias("n"), F.min(SHARD).alias("low"), F.max(SHARD).alias("high"))
    shards = keys.groupBy("low").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.when(F.col("low") == F.col("high"), 1).otherwise(0)).alias("one"))
    return shards.agg(
        F.sum("n").alias("row_count"), F.sum("k").alias("key_count"), F.count("*").alias("shards"), F.sum("one").alias("keys_in_one_shard"),
        (F.max("k") < 1.5 * F.avg("k")).alias("even"),
    )


def hash_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tables lie in six shards: every key in one shard only, and the shards alike."""
    parts = [_placement(with_shard(table(spark, sf_dir, t), k, 6), k).select(F.lit(t).alias("name"), "*") for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))]
    return parts[0].union(parts[1])


def redistribute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in six shards, dealt anew to four, as read back from the files."""
    first, second = _scratch(spark, ".parquet"), _scratch(spark, ".parquet")
    write_sharded(table(spark, sf_dir, "orders"), first, "o_orderkey", 6)
    redistribute(spark, first, second, 4)
    return _placement(spark.read.parquet(second), "o_orderkey")


def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations through a CSV file, whose types are inferred."""
    path = _scratch(spark, ".csv")
    table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    return read_file(spark, path).select("n_nationkey", "n_name", "n_regionkey")


def source_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_file(spark, f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")


def source_demo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_rows(spark, 50)


QUERIES = {f.__name__: f for f in (hash_partition_counts, redistribute_counts, source_csv, source_parquet, source_demo_rows)}
_PLACED = "SELECT {name}count(*) AS row_count, count(DISTINCT {k}) AS key_count, {n} AS shards, count(DISTINCT {k}) AS keys_in_one_shard, true AS even FROM {t}"
ORACLES = {
    "hash_partition_counts": " UNION ALL ".join(_PLACED.format(name=f"'{t}' AS name, ", k=k, n="6::BIGINT", t=t) for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))),
    "redistribute_counts": _PLACED.format(name="", k="o_orderkey", n="4::BIGINT", t="orders"),
    "source_csv": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "source_parquet": "SELECT r_regionkey, r_name FROM region",
    "source_demo_rows": "SELECT i::INTEGER AS id, 'event-' || i AS name, (i * 10)::INTEGER AS score, CASE i % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS category FROM range(1, 51) t(i)",
}
