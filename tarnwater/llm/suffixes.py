"""Removal of repeated byte strings over suffixes sorted by bucket-pointer refinement.

Every byte that lies in a string of ``length`` bytes (``LENGTH``, unless the caller
says otherwise) which also starts elsewhere, in another text or the same, is
removed.  Texts are UTF-8 bytes and no string crosses from one to the next.

Initial buckets.  A string (a window) belongs to the leftmost of its pieces of
:func:`gram` bytes whose hash is smallest, its anchor: equal windows have equal anchors, and
one anchor owns a run of neighbouring windows, its span.  Spans are dealt into
buckets by the anchor's hash; there are some 100 times fewer spans than bytes,
and only hashes and places travel.  A bucket of one span is finished: nothing in
it repeats.  So is a bucket whose spans are all equal: everything in it does.
Equal spans of one text are one row with their number and their joined places:
they repeat each other, so nothing needs to be looked up for them, and periodic
text, where each period starts a span, gives a row and not one for each period.

Refinement.  The other buckets' different spans are fetched as bytes and their
suffixes sorted in :func:`refine`: pointers to buckets of equal first 8 bytes
are refined by the pointers found at the offset of the depth reached, which
doubles the depth each time, as the refined pointers are used for the next, up to
the length; windows that still share a bucket are equal.  A bucket of more than
``HOT`` different spans is cut before that (:func:`_children`): each window
holds either the left or the right half of what the bucket's common part lacks to
the length, so its spans go to buckets by that longer common part.  Nine halvings
leave single windows, whose buckets are equalities, so no passage, however
frequent, meets in one task.

Texts travel only where needed: those of which spans are fetched, and those that
lose bytes, are told from the others by :func:`~tarnwater.llm.common.marked`.

Hashes of 64 bits only choose buckets together with a second one of the span, so
unequal spans are taken for equal at a chance of about 2**-128 for each pair.

Defined cases: null texts count as empty and lose nothing, as do texts under
the length; texts of the length or more that occur twice lose all bytes in
every copy, repeated rows included; periodic text repeats itself; null ids keep
their rows.  Only doc_id and text are read, other columns pass through
:func:`deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwater.llm.common import batch_map, durable, marked, read_table, release, shuffle_partitions, small_batches, text_bytes

LENGTH = 400
#: Bytes of passages of over 50 words, many of which are shorter than ``LENGTH``.
PASSAGE = 240
HOT = 1024
#: Bytes of spans whose suffixes are sorted together.
TOGETHER = 1 << 19


def gram(length: int) -> int:
    """Bytes of a window's pieces: half of the window, as a multiple of 8."""
    return max(8, length // 16 * 8)


def reach(length: int) -> int:
    """Pieces of a window."""
    return length - gram(length) + 1


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(raw: bytes, length: int = gram(LENGTH)) -> np.ndarray:
    """A hash of the ``length`` bytes from each place (a multiple of 8)."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    levels, width = {8: _mix(np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)) * _ODD)}, 8
    while width * 2 <= length:
        h = levels[width]
        levels[2 * width] = _mix(h[:-width] * _ODD + h[width:])
        width *= 2
    out, at = levels[width][:n], width
    while at < length:
        width = max(w for w in levels if w <= length - at)
        out = _mix(out * _ODD + levels[width][at : at + n])
        at += width
    return out


def _slide(h: np.ndarray, reach: int, pick) -> np.ndarray:
    """The least (or greatest) of each ``reach`` neighbours."""
    width = 1
    while width * 2 <= reach:
        h = pick(h[:-width], h[width:])
        width *= 2
    return pick(h[: len(h) - (reach - width)], h[reach - width :]) if width < reach else h


def span_arrays(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor's place and anchor's hash of every span of a text."""
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    pieces = reach(length)
    h = gram_hashes(raw, gram(length))
    least = _slide(h, pieces, np.minimum)
    n = len(least)
    edge = np.full(pieces - 1, 0, np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), pieces, np.maximum) == h)
    if n < pieces:  # fewer windows than pieces: the edges' zeros must not count as a window's least
        chosen = chosen[(h[chosen][:, None] == np.unique(least)).any(axis=1)]
    places, hashes = chosen.tolist(), h[chosen].tolist()
    before, after, stack = [-1] * len(places), [len(h)] * len(places), []
    for i, x in enumerate(hashes):
        while stack and hashes[stack[-1]] > x:
            after[stack.pop()] = places[i]
        if stack:
            before[i] = places[stack[-1]]
        stack.append(i)
    low = np.maximum(np.array(before, np.int64) + 1, chosen - pieces + 1)
    high = np.minimum(np.minimum(chosen, np.array(after, np.int64) - pieces), n - 1)
    some = low <= high
    return low[some], (high - low + 1)[some], chosen[some], h[chosen[some]]


def spans(raw: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """As :func:`span_arrays`, a tuple for each span."""
    return list(zip(*(x.tolist() for x in span_arrays(raw, length)), strict=True))


def refine(text: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the ``length`` bytes from each of ``windows`` also start at another of them."""
    n = len(text) - 7
    if not len(windows):
        return np.zeros(0, bool)
    # bucket pointers by the first 8 bytes; a pointer is the place of its bucket's last suffix in the sorted order
    pointer = _pointers(np.ndarray(n, ">u8", text.tobytes(), strides=(1,)).astype(np.uint64))
    depth = 8
    while depth * 2 <= length:
        live = len(pointer) - depth
        pointer = _pointers(pointer[:live] * np.int64(n) + pointer[depth:])
        depth *= 2
    last = pointer[windows] * np.int64(n) + pointer[windows + length - depth]
    _, bucket, size = np.unique(last, return_inverse=True, return_counts=True)
    return size[bucket] > 1


def _pointers(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ranked = key[order]
    ends = np.append(np.flatnonzero(ranked[1:] != ranked[:-1]), len(key) - 1)
    pointer = np.empty(len(key), np.int64)
    pointer[order] = np.repeat(ends, np.diff(ends, prepend=-1))
    return pointer


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ID = "coalesce(doc_id, -9223372036854775808)"


def _keyed(docs: DataFrame) -> DataFrame:
    """id, th (a hash of the text), raw."""
    return docs.select(F.expr(_ID).alias("id"), text_bytes().alias("raw")).withColumn("th", F.unhex(F.md5("raw")))


def anchored(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, th, start, n, place, a, sh, times, runs: the different spans of every text; a and sh are hashes of anchor and span.

    A span that a text holds once has times 1 and no runs.  The others have the
    start of their first place and as runs the bytes of all their places.
    """
    small_batches(docs.sparkSession)
    places = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    schema = pa.schema([("id", pa.int64()), ("th", pa.binary()), ("start", pa.int32()), ("n", pa.int32()), ("place", pa.int32()), ("a", pa.int64()), ("sh", pa.int64()), ("times", pa.int64()), ("runs", places)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, of, runs = [[np.zeros(0, np.int64)] for _ in range(6)], [np.zeros(0, np.int64)], []
            for k, raw in enumerate(batch.column("raw").to_pylist()):
                start, n, place, a = span_arrays(raw, length)
                sh = [xxhash.xxh64_intdigest(raw[x:y], 1) for x, y in zip(start.tolist(), (start + n - 1 + length).tolist(), strict=True)]
                times = np.ones(len(sh), np.int64)
                if len(set(sh)) < len(sh):  # some span stands twice in this text
                    same: dict[tuple[int, int], list[int]] = {}
                    for i, key in enumerate(zip(a.tolist(), sh, strict=True)):
                        same.setdefault(key, []).append(i)
                    first = [x[0] for x in same.values()]
                    times = np.array([len(x) for x in same.values()], np.int64)
                    runs += [merged([{"start": int(start[i]), "stop": int(start[i] + n[i]) - 1 + length} for i in x]) if len(x) > 1 else None for x in same.values()]
                    start, n, place, a, sh = start[first], n[first], place[first], a[first], [sh[i] for i in first]
                else:
                    runs += [None] * len(sh)
                for part, x in zip(parts, (start, n, place, a.view(np.int64), np.array(sh, np.uint64).view(np.int64), times), strict=True):
                    part.append(x)
                of.append(np.full(len(sh), k))
            text = pa.array(np.concatenate(of))
            start, n, place, a, sh, times = (np.concatenate(x) for x in parts)
            small = [pa.array(x.astype(np.int32)) for x in (start, n, place)]
            columns = [batch.column("id").take(text), batch.column("th").take(text), *small, pa.array(a), pa.array(sh), pa.array(times), pa.array(runs, places)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = _keyed(docs).where(F.length("raw") >= length).select("id", "th", "raw")
    return rows.mapInArrow(run, "id bigint, th binary, start int, n int, place int, a bigint, sh bigint, times bigint, runs array<struct<start:int,stop:int>>")


def _sort_suffixes(spans_: DataFrame, length: int) -> DataFrame:
    """a, sh, start, stop: runs of repeated windows in the spans (a, sh, twice, raw) of buckets a of at most ``HOT`` spans."""
    schema = pa.schema([("a", pa.int64()), ("sh", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

    def give(rows: list[tuple]) -> pa.RecordBatch:
        lengths = np.array([len(r[3]) for r in rows], np.int64)
        starts = np.cumsum(lengths) - lengths
        counts = lengths - length + 1
        firsts = np.cumsum(counts) - counts
        windows = np.repeat(starts - firsts, counts) + np.arange(counts.sum())
        again = refine(np.frombuffer(b"".join([r[3] for r in rows]), np.uint8), windows, length)
        out = []
        for (a, sh, twice, _), k, m in zip(rows, firsts.tolist(), counts.tolist(), strict=True):
            out += [(a, sh, 0, m)] if twice else [(a, sh, x, y) for x, y in _runs(again[k : k + m])]
        return _batch(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "sh", "twice", "raw")), strict=True):
                if size > TOGETHER and row[0] != rows[-1][0]:  # between two buckets
                    yield give(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield give(rows)

    dealt = spans_.select("a", "sh", "twice", "raw").repartition(shuffle_partitions(spans_), "a").sortWithinPartitions("a")
    return dealt.mapInArrow(run, "a bigint, sh bigint, start int, stop int")


def _children(hot: DataFrame, length: int) -> DataFrame:
    """The spans of hot buckets cut in two: a, sh and offset of the parent, and b, bh, twice, raw, low, high of the child.

    low and high bound the part of a span that is common to its bucket.
    """
    schema = pa.schema([("a", pa.int64()), ("sh", pa.int64()), ("off", pa.int32()), ("b", pa.int64()), ("bh", pa.int64()), ("twice", pa.bool_()), ("raw", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, sh, twice, raw, low, high in zip(*(batch.column(c).to_pylist() for c in ("a", "sh", "twice", "raw", "low", "high")), strict=True):
                last = len(raw) - length  # the last window
                free = length - (high - low)
                half = -(-free // 2)
                sides = [(0, min(last, low - half), low - half, high)]
                if free > 1:
                    sides.append((max(0, low - half + 1), last, low, high + free - half + 1))
                elif free == 1:
                    sides.append((max(0, low), last, low, high + 1))
                for first, end, u, v in sides:
                    if first <= end:
                        part = raw[first : end + length]
                        b = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True) + raw[u:v], 2)
                        out.append((a, sh, first, _signed(b), _signed(xxhash.xxh64_intdigest(part, 3)), twice, part, u - first, v - first))
            yield _batch(out, schema)

    return hot.mapInArrow(run, "a bigint, sh bigint, off int, b bigint, bh bigint, twice boolean, raw binary, low int, high int")


def _resolve(different: DataFrame, length: int) -> DataFrame:
    """a, sh, start, stop: runs of repeated windows in the spans (a, sh, twice, raw, low, high), each different in its bucket a."""
    sizes = durable(different.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("a"), "suffix-hot")
    if sizes.isEmpty():
        return _sort_suffixes(different, length)
    calm = different.join(sizes, "a", "left_anti")
    members = durable(_children(different.join(sizes, "a", "left_semi"), length), "suffix-members")
    kinds = members.groupBy("b", "bh").agg(F.count("*").alias("n"), F.max("twice").alias("t"), F.min(F.struct("a", "sh", "off")).alias("one"))
    kinds = durable(kinds.select("b", "bh", ((F.col("n") > 1) | F.col("t")).alias("again"), "one"), "suffix-kinds")
    mixed = durable(kinds.groupBy("b").agg(F.count("*").alias("k")).where("k > 1").select("b"), "suffix-mixed")
    chosen = kinds.join(mixed, "b", "left_semi").select("b", "bh", "again", "one.*")
    deeper = members.join(chosen, ["b", "bh", "a", "sh", "off"]).select(F.col("b").alias("a"), F.col("bh").alias("sh"), F.col("again").alias("twice"), "raw", "low", "high")
    below = _resolve(durable(deeper, "suffix-deeper"), length).select(F.col("a").alias("b"), F.col("sh").alias("bh"), "start", "stop")
    equal = kinds.where("again").join(mixed, "b", "left_anti").select("b", "bh", F.lit(0).alias("start"), F.lit(None).cast("int").alias("stop"))
    found = durable(below.unionByName(equal), "suffix-found")
    sized = members.select("a", "sh", "off", "b", "bh", (F.length("raw") - length + 1).alias("n"))
    up = sized.join(found, ["b", "bh"]).select("a", "sh", (F.col("start") + F.col("off")).alias("start"), (F.coalesce("stop", "n") + F.col("off")).alias("stop"))
    return _sort_suffixes(calm, length).unionByName(up)


def _span_runs(found: DataFrame) -> DataFrame:
    """a, sh, runs: one row for each span, with its runs of repeated windows joined (a span has at most as many windows as a window has pieces)."""
    grouped = found.groupBy("a", "sh").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    return durable(batch_map(grouped, lambda: lambda runs: [(merged(r),) for r in runs], "joined array<struct<start:int,stop:int>>", ["a", "sh"], ["runs"]), "suffix-span-runs").withColumnRenamed("joined", "runs")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """th, runs: for each text hash with repeats, the (start, stop) byte runs, possibly overlapping."""
    rows = durable(anchored(docs, length), "suffix-spans")
    buckets = rows.groupBy("a").agg(F.sum("times").alias("k"), (F.min("sh") != F.max("sh")).alias("mixed")).where("k > 1").select("a", "mixed")
    buckets = durable(buckets, "suffix-buckets")
    shared = durable(rows.join(buckets, "a"), "suffix-shared")  # most spans are alone in their bucket and go here
    release(rows)
    equal = shared.where("NOT mixed AND times = 1").select("th", "start", (F.col("start") + F.col("n") - 1 + length).alias("stop"))
    within = shared.where("times > 1").select("th", F.explode("runs").alias("r")).select("th", "r.*")
    kinds = shared.where("mixed").groupBy("a", "sh")
    kinds = kinds.agg(F.sum("times").alias("k"), F.min(F.struct("id", "th", "start", "n", "place")).alias("one"))
    kinds = kinds.select("a", "sh", (F.col("k") > 1).alias("twice"), "one.*")
    wanted = durable(kinds, "suffix-kinds")
    wanted_key = F.xxhash64("id", "th")
    fetched = marked(_keyed(docs), wanted_key, wanted.select(wanted_key.alias("k")), "some").where("some").join(wanted, ["id", "th"]).select(
        "a", "sh", "twice", F.substring("raw", F.col("start") + 1, F.col("n") - 1 + length).alias("raw"), (F.col("place") - F.col("start")).alias("low"), (F.col("place") - F.col("start") + gram(length)).alias("high")
    )
    different = durable(fetched.groupBy("a", "sh").agg(F.first("twice").alias("twice"), F.first("raw").alias("raw"), F.first("low").alias("low"), F.first("high").alias("high")), "suffix-different")
    inside = shared.where("mixed AND times = 1").select("th", F.col("start").alias("at"), "a", "sh").join(_span_runs(_resolve(different, length)), ["a", "sh"]).select("th", "at", F.explode("runs").alias("r"))
    inside = inside.select("th", (F.col("at") + F.col("r.start")).alias("start"), (F.col("at") + F.col("r.stop") - 1 + length).alias("stop"))
    found = durable(equal.unionByName(within).unionByName(inside).groupBy("th").agg(F.collect_set(F.struct("start", "stop")).alias("runs")), "suffix-runs")
    for x in (shared, wanted, different):
        release(x)
    return found


def merged(runs: list) -> list[tuple[int, int]]:
    """Overlapping and touching runs joined, ascending."""
    out: list[tuple[int, int]] = []
    for r in sorted((r["start"], r["stop"]) for r in runs or ()):
        if out and r[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]))
        else:
            out.append(r)
    return out


def cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of the bytes without the runs."""
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def nested(docs: DataFrame, length: int, shorter: int) -> DataFrame:
    """th, runs, shared: as :func:`repeated`, for strings of ``length`` bytes (runs) and of ``shorter`` ones (shared).

    Whatever the longer strings cover, the shorter ones cover in one run of ``length``
    bytes or more, so the second pass takes only texts that have such a run (and the
    few that :func:`~tarnwater.llm.common.marked` cannot tell from them).
    """

    def make():
        return lambda many: [(m, max(b - a for a, b in m) >= length) for m in map(merged, many)]

    shared = batch_map(repeated(docs, shorter), make, "shared array<struct<start:int,stop:int>>, long boolean", ["th"], ["runs"])
    shared = durable(shared, "suffix-shared-runs")
    key = F.xxhash64("th")
    some = marked(_keyed(docs), key, shared.where("long").select(key.alias("k")), "some").where("some")
    some = durable(some.select(F.col("id").alias("doc_id"), F.col("raw").alias("text")), "suffix-some")
    found = repeated(some, length)
    release(some)
    return durable(shared.drop("long").join(found, "th", "left"), "suffix-both")  # a side of its own, so that a text with very many rows can be split


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), raw, and the columns of ``found`` but its key th (null where it has no row)."""
    rest = [c for c in found.columns if c != "th"]
    rows = docs.select(F.struct("*").alias("row"), text_bytes().alias("raw")).withColumn("th", F.unhex(F.md5("raw")))
    rows = marked(rows, F.xxhash64("th"), found.select(F.xxhash64("th").alias("k")), "some")
    whole = rows.where("NOT some").select("row", "raw", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in rest))
    return rows.where("some").join(found, "th", "left").select("row", "raw", *rest).union(whole)


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows and columns of ``docs`` with repeated strings removed from text.

    Bytes of a character of which the removal left a part go as well, and a text
    of which nothing is left is empty; null texts stay null.
    """
    made = batch_map(_joined(docs, repeated(docs, length)), lambda: lambda raws, runs: [(cut(r, merged(x)).decode("utf-8", "ignore"),) for r, x in zip(raws, runs, strict=True)], "kept string", ["row"], ["raw", "runs"])
    columns = [F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return made.select(*columns)


def _digest(raw: bytes, runs: list, shared: list) -> tuple[int, int, int, str, int]:
    runs = merged(runs)
    return len(raw), sum([b - a for a, b in runs]), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest(), sum([b - a for a, b in merged(shared)])


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what is left, and n_shared: the bytes that strings of ``PASSAGE`` bytes which stand elsewhere cover (they stay)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _joined(docs, nested(docs, LENGTH, PASSAGE)).select(F.col("row.doc_id").alias("doc_id"), "raw", "runs", "shared")
    schema = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared bigint"
    return batch_map(rows, lambda: lambda *c: [_digest(*x) for x in zip(*c, strict=True)], schema, ["doc_id"], ["raw", "runs", "shared"])


QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
ORACLES: dict[str, str] = {}
