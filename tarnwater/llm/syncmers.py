"""Document fingerprints from closed syncmers.

A k-mer of characters is a *closed syncmer* when the smallest of its inner
s-mers, in the order of a hash, stands at its first or last place.  Whether a
k-mer is chosen depends on its own characters alone, so equal passages choose
equal anchors whatever stands around them, and an anchor's position can be
compared between two documents.

The fingerprint is a bottom sketch of the anchors' hashes: the ``SKETCH``
smallest 32-bit values, in hexadecimal and ascending order, after the number of
different anchors.  :func:`likeness` estimates the Jaccard likeness of two
anchor sets from two fingerprints; it is exact while both sets fit a sketch.

Defined cases: a null text counts as empty; an empty text has no anchor, and two
empty fingerprints have likeness 1, an empty and another one 0; a text of fewer
than ``K`` characters is one anchor as a whole; repeated rows each get their own
row; ties of doc_id are ordered by text, and null ids come last.  Only the
columns doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwater.llm.common import read_table, row_map, shuffle_partitions, small_batches

K, S, SKETCH = 16, 8, 128
_B = np.uint64(0x9E3779B97F4A7C15)
#: Neighbour ranges for each shuffle partition; more make the partitions more even.
RANGES_PER_PARTITION = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in code points) and 64-bit hashes of the closed syncmers, in the order of the text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(code) < K:
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.array([len(code)], np.uint64)
        for c in code:
            whole = _mix(whole * _B + c + np.uint64(1))
        return np.zeros(1, np.int64), whole
    power, h, width = np.array([_B]), code + np.uint64(1), 1
    while width < S:  # hashes of twice the width from two neighbours
        h = h[:-width] * power + h[width:]
        power, width = power * power, width * 2
    kmer = h[:-S] * power + h[S:]
    least = inner = _mix(h)
    width = 1
    while width < K - S:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])  # over the K - S + 1 inner s-mers of each k-mer
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[K - S :] == least))
    return at, _mix(kmer[at])


def fingerprint(text: str | None) -> str:
    _, h = anchors(text or "")
    h = np.unique((h >> np.uint64(32)).astype(np.uint32))
    return f"{len(h)}:{h[:SKETCH].astype('>u4').tobytes().hex()}"


def _sketch(fp: str) -> tuple[int, np.ndarray]:
    n, _, values = fp.partition(":")
    return int(n), np.frombuffer(bytes.fromhex(values), ">u4").astype(np.uint32)


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness of two fingerprints' anchor sets, 0 to 1."""
    (n, x), (m, y) = _sketch(a), _sketch(b)
    if not n or not m:
        return float(n == m)
    both = np.union1d(x, y)
    if n > SKETCH or m > SKETCH:
        both = both[:SKETCH]
    shared = np.intersect1d(x, y, assume_unique=True)
    return float(np.count_nonzero(shared <= both[-1])) / len(both)


def matches(a: str, b: str) -> list[tuple[int, int, int]]:
    """Positional matches: (start in a, start in b, length) of runs of anchors that both texts share on one diagonal.

    An anchor goes on with the run before it where it can; else it opens one at the
    first of its places in ``b``, so repeats cost no more than their number.
    """
    (p, h), (q, g) = anchors(a), anchors(b)
    places: dict[int, int] = {}
    for y, value in zip(q[::-1].tolist(), g[::-1].tolist(), strict=True):
        places[value] = y  # the first place of each
    at = dict(zip(q.tolist(), g.tolist(), strict=True))
    runs: list[tuple[int, int, int]] = []
    for x, value in zip(p.tolist(), h.tolist(), strict=True):
        if runs and x <= runs[-1][0] + runs[-1][2] and at.get(x - runs[-1][0] + runs[-1][1]) == value:
            runs[-1] = (*runs[-1][:2], x + K - runs[-1][0])
        elif value in places:
            runs.append((x, places[value], K))
    return runs


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, anchors (array of position and hash): the operator's general output."""

    def make():
        def one(text):
            at, h = anchors(text or "")
            return fingerprint(text), [{"position": x, "hash": y} for x, y in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]

        return one

    return row_map(docs.select("doc_id", "text"), make, "fingerprint string, anchors array<struct<position: bigint, hash: bigint>>", ["doc_id"], ["text"])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, copy: each row in the range of its doc_id, with the first row of the following range as a copy.

    Sorted by (range, copy, doc_id descending, text) in each partition, every
    row is followed by its successor in descending doc_id order.  Ranges come
    from quantiles of doc_id; the heads that are sent twice are one id for each
    range, so the broadcast table has as many rows as there are ranges.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    n = shuffle_partitions(docs)
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("bigint").alias("_id"), "doc_id", "text")
    shares = [i / (n * RANGES_PER_PARTITION) for i in range(1, n * RANGES_PER_PARTITION)]
    cuts = ids.agg(F.percentile_approx("_id", shares, 20000).alias("c")).first()["c"] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts} or {0.0}), float("inf")]
    bucket = Bucketizer(splits=splits, inputCol="_at", outputCol="_range")
    placed = bucket.transform(ids.withColumn("_at", F.col("_id").cast("double")))
    tops = sorted(placed.groupBy("_range").agg(F.max("_id").alias("top")).collect(), reverse=True)
    heads = [(tops[i]["top"], tops[i - 1]["_range"]) for i in range(len(tops))]  # the first range follows the last
    sent = spark.createDataFrame(heads, "top bigint, dest double")
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy"))
    again = F.struct(F.col("dest").alias("range"), F.lit(1).alias("copy"))
    return (
        placed.join(F.broadcast(sent), F.col("_id") == F.col("top"), "left")
        .select("doc_id", "_id", "text", F.explode(F.when(F.col("dest").isNull(), F.array(own)).otherwise(F.array(own, again))).alias("r"))
        .select("doc_id", "_id", "text", "r.range", "r.copy")
        .repartition(n, "range")
        .sortWithinPartitions("range", "copy", F.desc("_id"), "text")
    )


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text; see the module for the cases."""
    rows = with_next(read_table(spark, sf_dir, "documents"))
    small_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row that waits for its successor
        for batch in batches:
            out = []
            for doc_id, text, at, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "copy")), strict=True):
                if last is None or last[3] != at:
                    last = None
                    if copy:
                        continue
                elif last[4]:
                    continue
                text = text or ""
                fp = fingerprint(text)
                if last is not None:
                    changed = edited(last[1], text)
                    new = fingerprint(changed)
                    out.append((last[0], len(last[1]), hashlib.sha256(changed.encode()).hexdigest(), last[2], new, likeness(last[2], new), likeness(last[2], fp)))
                last = (doc_id, text, fp, at, copy)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(schema), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


QUERIES = {"op1_syncmer_fingerprints": op1_syncmer_fingerprints}
ORACLES: dict[str, str] = {}
