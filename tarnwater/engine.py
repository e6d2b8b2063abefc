"""A session-like front: register tables, run a SELECT, get typed rows and statistics."""

from __future__ import annotations

import logging
import os
import re
import time
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from tarnwater.plans.shape import plan_shape
from tarnwater.sources.ingest import read_file

log = logging.getLogger("tarnwater")


class QueryError(Exception):
    """A query that was not run or did not end; ``status`` is what an HTTP front would answer."""

    status = 500


class BadQuery(QueryError):
    status = 400


class UnknownTable(BadQuery):
    pass


class Unavailable(QueryError):
    status = 503


@dataclass
class QueryResult:
    query_id: str
    columns: list[str]
    rows: list[tuple]
    stats: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"queryId": self.query_id, "columns": self.columns, "rows": [list(r) for r in self.rows], "stats": self.stats}


def default_names(df: DataFrame) -> DataFrame:
    """``df`` with counts of rows that have no name of their own called ``count``, unless that would clash."""
    names = ["count" if c == "count(1)" else c for c in df.columns]
    return df.toDF(*names) if len(set(names)) == len(names) else df


class Engine:
    """Tables by lower-cased name, queries over them, and a record of the last fifty.

    ``most_rows`` bounds what :meth:`query` brings to the driver: a larger result is
    refused and not cut, and :meth:`stream` gives it row by row.  ``log_plans`` (or
    TARNWATER_LOG_PLANS) logs each query's plan.  Queries may run in several threads.
    """

    RECENT = 50

    def __init__(self, spark: SparkSession, most_rows: int | None = None, log_plans: bool | None = None):
        self.spark, self.most_rows = spark, most_rows
        self.log_plans = bool(os.environ.get("TARNWATER_LOG_PLANS")) if log_plans is None else log_plans
        self.tables: dict[str, str] = {}
        self.active: dict[str, dict] = {}
        self.recent: deque[dict] = deque(maxlen=self.RECENT)
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")

    def register(self, name: str, path: str) -> None:
        read_file(self.spark, path).createOrReplaceTempView(name.lower())
        self.tables[name.lower()] = path

    def refresh(self, name: str) -> None:
        """See files that were added to or removed from a table's folder."""
        path = self.tables[name.lower()]
        self.spark.catalog.refreshByPath(path)
        self.register(name, path)

    def complete(self, sql: str) -> bool:
        """Whether the text is a statement on its own."""
        try:
            self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception:  # py4j gives the parser's error a type of its own in each version
            return False
        return True

    def frame(self, sql: str) -> DataFrame:
        """The plan of a SELECT as a DataFrame; other statements are refused."""
        text = re.sub(r";\s*$", "", sql.strip())
        if not text:
            raise BadQuery("sql is required")
        bare = re.sub(r"^(\s|--[^\n]*\n|/\*.*?\*/|\()+", "", text, flags=re.S)
        writes = re.match(r"with\b.*\)\s*(insert|merge|update|delete)\b", bare, re.I | re.S) or re.match(r"from\b.*\binsert\b", bare, re.I | re.S)
        if not re.match(r"(select|with|values|from)\b", bare, re.I) or writes:
            raise BadQuery("only SELECT queries are supported")
        try:
            return default_names(self.spark.sql(text))
        except ParseException as e:
            raise BadQuery(f"invalid SQL: {e.getMessage()}") from e
        except AnalysisException as e:
            if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                raise UnknownTable(f"unknown table: {e.getMessage()} Known tables: {', '.join(sorted(self.tables))}") from e
            raise BadQuery(e.getMessage()) from e

    def validate(self, sql: str) -> None:
        """Raise what :meth:`query` would for unknown tables, columns or statements, and run nothing."""
        self._available()
        self.frame(sql)

    def _available(self) -> None:
        if self.spark.sparkContext._jsc is None:
            raise Unavailable("the session has ended")

    def query(self, sql: str) -> QueryResult:
        entry = {"id": str(uuid.uuid4()), "sql": " ".join(sql.split())[:80], "phase": "PLAN"}
        self.active[entry["id"]] = entry
        began = time.perf_counter()
        try:
            self._available()
            df = self.frame(sql)
            if self.log_plans:
                log.info("%s\n%s", entry["sql"], df._jdf.queryExecution().toString())
            entry["phase"] = "EXECUTE"
            rows = [tuple(r) for r in (df if self.most_rows is None else df.limit(self.most_rows + 1)).collect()]
            if self.most_rows is not None and len(rows) > self.most_rows:
                raise BadQuery(f"the result has over {self.most_rows} rows; use stream()")
            stats = {"mergeStrategy": plan_shape(df), "durationMs": round(1000 * (time.perf_counter() - began), 3), "rows": len(rows)}
            entry |= {"phase": "DONE"} | stats
            return QueryResult(entry["id"], df.columns, rows, stats)
        except PySparkException as e:
            entry |= {"phase": "FAILED"}
            raise QueryError(str(e)) from e
        except QueryError:
            entry |= {"phase": "FAILED"}
            raise
        finally:
            self.recent.append(self.active.pop(entry["id"]))

    def stream(self, sql: str) -> tuple[list[str], Iterator[tuple]]:
        """Columns and rows of a result of any size; the driver holds one partition at a time."""
        self._available()
        df = self.frame(sql)
        return df.columns, map(tuple, df.toLocalIterator())

    def workers(self) -> list[dict]:
        """Executors: address, tasks that run, their share of the cores (the load), and cached bytes."""
        self._available()
        context = self.spark.sparkContext
        infos = list(context._jsc.sc().statusTracker().getExecutorInfos())
        cores = max(1, context.defaultParallelism // max(1, len(infos) - (len(infos) > 1)))
        return [{"address": f"{i.host()}:{i.port()}", "tasks": i.numRunningTasks(), "load": round(i.numRunningTasks() / cores, 3), "cachedBytes": i.cacheSize()} for i in infos]

    def status(self) -> dict:
        context = self.spark.sparkContext
        up = context._jsc is not None
        return {"status": "UP" if up else "DEGRADED", "master": context.master, "parallelism": context.defaultParallelism if up else 0, "workers": len(self.workers()) if up else 0, "tables": sorted(self.tables)}

    def partitions(self, name: str) -> list[dict]:
        """The partitions that a scan of a table has, with the hosts that hold their files (none: any)."""
        rdd = self.spark.table(name.lower())._jdf.queryExecution().toRdd()
        places = [(rdd.preferredLocations(p), i) for i, p in enumerate(rdd.partitions())]
        return [{"partition": i, "owners": [hosts.apply(k) for k in range(hosts.size())]} for hosts, i in places]

    def monitor(self) -> dict:
        parts = {t: self.partitions(t) for t in list(self.tables)}
        return {"status": self.status(), "workers": self.workers(), "active": list(self.active.values()), "recent": list(self.recent), "partitions": parts}
