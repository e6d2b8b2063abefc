"""Session settings and tables."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Adaptive execution sizes partitions and splits skewed ones; quoted names are identifiers; times are UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Environment variables and the settings that they give.
VARIABLES = {
    "TARNWATER_MASTER": "spark.master",
    "TARNWATER_APP_NAME": "spark.app.name",
    "TARNWATER_DRIVER_MEMORY": "spark.driver.memory",
    "TARNWATER_EXECUTOR_MEMORY": "spark.executor.memory",
    "TARNWATER_EXECUTOR_CORES": "spark.executor.cores",
    "TARNWATER_EXECUTORS": "spark.executor.instances",
    "TARNWATER_SHUFFLE_PARTITIONS": "spark.sql.shuffle.partitions",
    "TARNWATER_PARTITION_BYTES": "spark.sql.files.maxPartitionBytes",
    "TARNWATER_BROADCAST_BYTES": "spark.sql.autoBroadcastJoinThreshold",
    "TARNWATER_TASK_RETRIES": "spark.task.maxFailures",
    "TARNWATER_HEARTBEAT": "spark.executor.heartbeatInterval",
    "TARNWATER_CHECKPOINT_DIR": "spark.checkpoint.dir",
    "TARNWATER_WAREHOUSE_DIR": "spark.sql.warehouse.dir",
}


def from_environment(environment: Mapping[str, str] = os.environ) -> dict[str, str]:
    """The settings that environment variables give; empty ones give none."""
    return {setting: environment[name] for name, setting in VARIABLES.items() if environment.get(name)}


def build(master: str | None = None, **settings: str) -> SparkSession:
    """A session: own settings, over them the environment's, over these the caller's."""
    builder = SparkSession.builder.appName("tarnwater").config(map={**SETTINGS, **from_environment(), **settings})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder.  Its schema is read once in a session, its files are listed anew each time."""
    path = f"{sf_dir}/{name}.parquet"
    known = spark.__dict__.setdefault("_tarnwater_schemas", {})
    if path not in known:
        known[path] = spark.read.parquet(path).schema
    return spark.read.schema(known[path]).parquet(path)


#: A table's name standing as a word of its own: not part of another one, no column of something and no text.
_NAMED = re.compile(rf"(?<![\w.{{'])({'|'.join(TABLES)})(?![\w}}'])")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the tables of a folder without leaving views behind: each is a parameter of the query."""
    names = set(_NAMED.findall(sql))
    return spark.sql(_NAMED.sub(r"{\1}", sql), **{n: table(spark, sf_dir, n) for n in names})
