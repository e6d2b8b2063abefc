"""Helpers shared by the operators: durable intermediates and bounded Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to Python in one Arrow batch.  Texts of 100 kB then make batches of some 25 MB.
ARROW_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The most bits of a :func:`marked` table, which bounds what it broadcasts to 16 MB.
MARK_BITS = 1 << 27
_PAGE = 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the warehouse where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/tarnwater-shared"


#: Folders of the tables that :func:`durable` made.
_MADE: set[str] = set()


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the reading of its part,
    and both sides of a later join start at a scan, which lets adaptive
    execution split a skewed side.  The folder goes when the application ends.
    """
    spark = df.sparkSession
    folder = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tarnwater/{folder}"
    _MADE.add(folder)
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`durable` that nothing reads any more.

    ``df`` reads that one table alone; anything else is refused, so no input is ever deleted.
    """
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    if len(folders) > 1 or any(f.rsplit("/", 1)[1] not in _MADE for f in folders):
        raise ValueError(f"not one table made by durable(): {sorted(folders)}")
    for name in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def marked(df: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with the boolean column ``flag``, which is false only where ``key`` is none of the values of ``keys``.

    A table of bits, of which the hash of each value sets one, is broadcast: 16 or
    more bits for a value, up to ``MARK_BITS`` in all, so its size is bounded.
    Beyond that more rows are flagged than need be and none fewer, so whoever joins
    the flagged rows alone gets the whole result and shuffles few rows.  ``key`` and
    the one column of ``keys`` are 64-bit integers, null matching nothing.
    """
    bits = min(MARK_BITS, max(_PAGE, 1 << (16 * keys.count()).bit_length()))
    place = lambda k: F.xxhash64(k).bitwiseAND(F.lit(bits - 1))
    at = place(F.col(keys.columns[0]))
    pages = keys.select(F.shiftright(at, 15).alias("_tarnwater_page"), at.bitwiseAND(F.lit(_PAGE - 1)).alias("bit"))
    pages = durable(pages.groupBy("_tarnwater_page").agg(F.bitmap_construct_agg("bit").alias("_tarnwater_map")), "marks")
    rows = df.withColumn("_tarnwater_at", place(key)).withColumn("_tarnwater_page", F.shiftright("_tarnwater_at", 15))
    byte = "cast(conv(hex(substring(_tarnwater_map, cast(_tarnwater_at % 32768 div 8 AS int) + 1, 1)), 16, 10) AS int)"
    found = F.expr(f"coalesce(shiftright({byte}, cast(_tarnwater_at % 8 AS int)) % 2 = 1, false)")
    rows = rows.join(F.broadcast(pages), "_tarnwater_page", "left").withColumn(flag, found & key.isNotNull())
    return rows.drop("_tarnwater_at", "_tarnwater_page", "_tarnwater_map")


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` or more (the last one of fewer)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum([b.num_rows for b in held]) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


#: Input bytes for which a shuffle gets one more partition than the session says.
PARTITION_BYTES = 64 << 20


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, or more where the tables under ``df`` are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum([x for x in sizes if x < 1 << 60])  # what has no statistics claims more
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PARTITION_BYTES))


def text_bytes(text: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def crc_mod(column: Column, divisor: int) -> Column:
    """crc32 of the value as decimal text, modulo ``divisor``; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def row_map(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, keep: list[str], args: list[str]) -> DataFrame:
    """Map each row on its own: ``keep`` columns pass through, ``args`` feed the function.

    ``make`` is called once in each task and returns the function, which may
    hold a model or a cache.  ``schema`` describes what the function returns.
    """

    def make_many():
        function = make()
        return lambda *columns: [function(*row) for row in zip(*columns, strict=True)]

    return batch_map(df, make_many, schema, keep, args)


def batch_map(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str, keep: list[str], args: list[str]) -> DataFrame:
    """As :func:`row_map`, with a function from lists of values to a list of rows."""
    spark = df.sparkSession
    small_batches(spark)
    source = df.select(*keep, *(a for a in args if a not in keep))
    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    added = pa_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            rows = function(*(batch.column(a).to_pylist() for a in args))
            columns = list(zip(*rows, strict=True)) or [()] * len(added)
            arrays = [batch.column(c) for c in keep] + [pa.array(list(v), type=f.type) for v, f in zip(columns, added, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added.names])

    return source.mapInArrow(run, ", ".join(x for x in (kept, schema) if x))


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))
