"""SimHash near-duplicate groups over a Gray-order hierarchical index.

Texts are lower-cased (A-Z only), cut into words at ASCII white space, and into
3-word shingles, repeats included; a text of fewer words is one shingle as a
whole.  A fingerprint bit is 1 if it is set in over half of the shingles' XXH64
(seed 42).  Fingerprints link at ``LINK`` or fewer differing bits, and a group is
a connected component of these links.

The index.  64 bits make ``BLOCKS`` blocks; two fingerprints with at most 2
differing bits agree in at least ``BLOCKS - 2`` of them, so every link shows
among the rows that share some choice of ``BLOCKS - 2`` blocks.  Rows are dealt
by that shared masked pattern (the top nodes of the index) and sorted by Gray
rank.  Within a top node, :class:`GrayIndex` joins neighbours in Gray order into
ever larger groups, moves the bits that a whole group shares up into the group's
node, and searches from the top: differences accumulate over the nodes on the
way down, and a group whose sum exceeds the threshold is pruned as a whole.  A
top node fixes 42 bits or more, so it never holds more than 2**22 different
fingerprints (32 MB), whatever the input; the copies of a text are one
fingerprint before any of this.  A top node gives out a star of links for each
of its local components, never all pairs.

:func:`near_duplicates` and :func:`keep_one` also take a likeness: texts then link
at that Jaccard coefficient or more of their sets of word shingles, computed from
the texts for every link.  64 bits within 2 find few of these, so their candidates
come from a ``WIDE``-bit SimHash of the set, by bit sampling: a table's top nodes
share ``k`` sampled bits, with ``k`` so that a node has some ``NODE`` texts and as
many tables as let a pair of likeness 0.8 (0.848 of the bits agree) share a node
with probability ``FOUND``.  Within a top node a :class:`GrayIndex` of the ``WIDE``
bits (two words, in Gray order as one) gives the texts within ``RADIUS`` bits, by the
same search from the top that prunes groups; those whose sizes allow the likeness are
joined to candidate groups by stars.  Each text goes once to its group, and there all
pairs that an index of the group gives within ``RADIUS`` bits, and that no link joins
yet, are compared.  A group over ``GROUP`` is first told apart by its likeness to a
pivot in its middle (:func:`alike_links`), so that a crowd of near copies costs one
comparison a text.  Texts with the same 64-bit hash after lower-casing and joining
of words are taken as one.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero and links like any other; repeated rows and ids each get a row; null
doc_ids keep their rows, and a component_id is the smallest id that is not null.
Only the columns doc_id and text are read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwater.llm.common import durable, gathered, marked, read_table, release, row_map, shuffle_partitions, small_batches, text_bytes
from tarnwater.llm.components import connected_components

SHINGLE, LINK, BLOCKS = 3, 2, 6
FANOUT = 8
#: Runs up to this long are compared row by row; longer ones get an index.
PLAIN = 12
#: Fingerprints that are taken from Spark at a time.
ROWS_AT_ONCE = 50_000
#: Fingerprints that search an index at the same time.
QUERIES_AT_ONCE = 2048
#: Pairs that a search within ``RADIUS`` bits, which may prune little, has at most at a time.
PAIRS_AT_ONCE = 2**18
#: Candidates of a likeness: bits, the most that differ, texts in a top node, the share of pairs of likeness 0.8 that meet in one, and texts in a part of a group.
WIDE, RADIUS, NODE, FOUND, GROUP = 128, 31, 1024, 0.999, 512


def simhash(raw: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text's UTF-8 bytes."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1).tolist()[shingle - 1 :]
    if not stops:
        return xxhash.xxh64_intdigest(joined, 42)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, stops)]), np.uint8)
    set_bits = np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(stops)).tobytes(), "big")


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (the text's hash) and fp, the fingerprint as a signed 64-bit integer."""
    source = docs.select("doc_id", text_hash().alias("key"), text_bytes().alias("raw"))
    return row_map(source, lambda: lambda raw: (signed(simhash(raw, shingle)),), "fp bigint", ["doc_id", "key"], ["raw"])


def shingle_set(raw: bytes, shingle: int) -> set[bytes]:
    """The different word shingles of a text; one of fewer words is one shingle, one without words has none."""
    words = raw.lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def wide_print(raw: bytes, shingle: int) -> tuple[int, int, int]:
    """The number of different shingles and the two halves of their ``WIDE``-bit SimHash, signed."""
    digest = xxhash.xxh3_128_digest
    found = b"".join([digest(s) for s in shingle_set(raw, shingle)])
    n = len(found) * 8 // WIDE
    set_bits = np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, WIDE // 8), axis=1).sum(axis=0, dtype=np.int64)
    hi, lo = np.packbits(set_bits * 2 > n).view(">i8").tolist()
    return n, hi, lo


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def text_key() -> Column:
    """A hash of the text's words, lower-cased and joined."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()), "[ \\t\\n\\x0B\\f\\r]+", " ")))


def wide_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key (the text's hash), fp (its key), and n, hi, lo of :func:`wide_print`."""
    source = docs.select("doc_id", text_hash().alias("key"), text_key().alias("fp"), text_bytes().alias("raw"))
    return row_map(source, lambda: lambda raw: wide_print(raw, shingle), "n int, hi bigint, lo bigint", ["doc_id", "key", "fp"], ["raw"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def _gray_rank(x: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


def gray_order(words: np.ndarray) -> np.ndarray:
    """The order of the rows by their place in the reflected Gray code; a row's words are its bits from the highest on."""
    odd, ranks = np.zeros(len(words), np.uint64), []
    for word in words.T:
        ranks.append(gray_rank(word) ^ -odd)  # a word after an odd number of set bits runs backwards
        odd = odd ^ (np.bitwise_count(word) & 1).astype(np.uint64)
    return np.lexsort(ranks[::-1])


class GrayIndex:
    """A hierarchical index over fingerprints in Gray order.

    A fingerprint is a 64-bit word or a row of several.  ``levels[0]`` has the
    fingerprints, word by word; a node of a higher level stands for ``FANOUT``
    neighbours of the level below.  A level's patterns hold the bits on which all of
    a node's fingerprints agree, and its masks which of these bits the node above has
    not compared: those that this one's neighbours do not share.  ``order`` has the
    place of each fingerprint in the input.
    """

    def __init__(self, fps: np.ndarray):
        words = fps[:, None] if fps.ndim == 1 else fps
        self.order = gray_order(words)
        self.fps = fps[self.order]
        pattern, mask = words[self.order], np.full(words.shape, 2**64 - 1, np.uint64)
        self.sizes, self.levels = [len(fps)], []
        while len(pattern) > 1:
            starts = np.arange(0, len(pattern), FANOUT)
            all_on = np.bitwise_and.reduceat(pattern, starts)
            any_on = np.bitwise_or.reduceat(pattern, starts)
            above = np.bitwise_and.reduceat(mask, starts) & ~(all_on ^ any_on)
            own = mask & ~np.repeat(above, FANOUT, axis=0)[: len(mask)]
            more = np.zeros((-len(pattern) % FANOUT, words.shape[1]), np.uint64)
            self.levels.append([[np.ascontiguousarray(x).reshape(-1, FANOUT) for x in np.concatenate([y, more]).T] for y in (pattern, own)])
            pattern, mask = all_on & above, above
            self.sizes.append(len(pattern))
        self.top = pattern, mask

    def search(self, queries: np.ndarray, most: int = LINK, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in ``fps``) of at most ``most`` differing bits.

        With ``first`` the queries are the index's own from that place on, and only
        pairs with a later place are given.
        """
        words = queries[:, None] if queries.ndim == 1 else queries
        q = np.arange(len(queries) if len(self.fps) else 0)
        node = np.zeros(len(q), np.int64)
        sums = np.zeros(len(q), np.uint8)
        if len(q):
            pattern, mask = self.top
            sums = np.bitwise_count((words ^ pattern) & mask).sum(axis=1, dtype=np.uint8)
        q, node, sums = (x[sums <= most] for x in (q, node, sums))
        words = np.ascontiguousarray(words.T)
        for level in range(len(self.levels) - 1, -1, -1):
            children = np.repeat(sums[:, None], FANOUT, axis=1)
            for word, pattern, own in zip(words, *self.levels[level], strict=True):
                children += np.bitwise_count((word[q][:, None] ^ pattern[node]) & own[node])
            at, child = np.nonzero(children <= most)
            q, node, sums = q[at], node[at] * FANOUT + child, children[at, child]
            there = node < self.sizes[level]
            if first is not None:
                there &= (node + 1) * FANOUT**level > q + (first + 1)  # the node's last fingerprint is a later one
            q, node, sums = q[there], node[there], sums[there]
        if first is not None:
            later = node > q + first  # a single fingerprint has no level
            q, node = q[later], node[later]
        return q, node


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i]; a root is the smallest of its tree."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while (jump := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = jump


def stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint of its local component) for the different fingerprints of one top node."""
    index = GrayIndex(fps)
    parent = np.arange(len(fps))
    for lo in range(0, len(fps), QUERIES_AT_ONCE):
        q, at = index.search(index.fps[lo : lo + QUERIES_AT_ONCE], LINK, lo)
        _union(parent, q + lo, at)
    linked = parent != np.arange(len(fps))
    return index.fps[linked], index.fps[parent[linked]]


def _node_links(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links of all top nodes of a sorted run of rows; ``key`` numbers the top nodes."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    short = np.repeat(sizes <= PLAIN, sizes)
    for step in range(1, PLAIN):  # short runs: a search would cost more than the comparisons
        x, y = fps[:-step], fps[step:]
        near = short[:-step] & (key[step:] == key[:-step]) & (np.bitwise_count(x ^ y) <= LINK)
        a.append(x[near])
        b.append(y[near])
    for i in np.flatnonzero(sizes > PLAIN).tolist():
        x, y = stars(fps[starts[i] : starts[i] + sizes[i]])
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _block_masks() -> list[int]:
    import itertools

    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(BLOCKS)]
    return [signed(sum(x)) for x in itertools.combinations(blocks, BLOCKS - LINK)]


def links(fps: DataFrame) -> DataFrame:
    """src, dst: links between different fingerprints that join exactly the fingerprints that a path of near links joins.

    ``fps`` has one column fp of different values.
    """
    tops = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(_block_masks()))))
    dealt = (
        fps.select("fp", tops.alias("top"))
        .select("top.t", "top.key", "fp")
        .repartition(shuffle_partitions(fps), "t", "key")
        .withColumn("rank", _gray_rank(F.col("fp")))
        .sortWithinPartitions("t", "key", F.shiftrightunsigned("rank", 1), "rank")
        .select("t", "key", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(t, key, fps):
            change = np.r_[False, (t[1:] != t[:-1]) | (key[1:] != key[:-1])] if len(t) else np.zeros(0, bool)
            a, b = _node_links(np.cumsum(change), fps)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        rest = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in gathered(batches, ROWS_AT_ONCE):
            new = [batch.column("t").to_numpy(), batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)]
            t, key, fp = (np.concatenate(x) for x in zip(rest, new, strict=True))
            last = (t == t[-1]) & (key == key[-1]) if len(t) else np.zeros(0, bool)  # may go on in the next batch
            yield give(t[~last], key[~last], fp[~last])
            rest = [t[last], key[last], fp[last]]
        yield give(*rest)

    return dealt.mapInArrow(run, "src bigint, dst bigint").distinct()


def table_masks(texts: int) -> list[tuple[int, int]]:
    """The sampled bits of each table, as two unsigned halves; bits repeat only after all have been used."""
    k = max(0, math.ceil(math.log2(max(texts, 1) / NODE)))
    agree = (1 - math.acos(2 * 0.8 / 1.8) / math.pi) ** k
    tables = 1 if k == 0 else math.ceil(math.log(1 - FOUND) / math.log(1 - agree))
    r, bits, out = random.Random(42), [], []
    for _ in range(tables):
        if len(bits) < k:
            bits = r.sample(range(WIDE), WIDE)
        mask = sum(1 << b for b in bits[:k])
        bits = bits[k:]
        out.append((mask >> 64, mask & (2**64 - 1)))
    return out


def near_pairs(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, likeness: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within ``RADIUS`` bits whose sizes allow the likeness, each once, by runs of a :class:`GrayIndex`'s rows."""
    index = GrayIndex(np.stack([hi, lo], axis=1))
    step = max(1, PAIRS_AT_ONCE // max(1, len(hi)))
    for at in range(0, len(hi), step):
        x, y = index.search(index.fps[at : at + step], RADIUS, at)
        x, y = index.order[x + at], index.order[y]
        fits = np.minimum(n[x], n[y]) + 1e-6 >= likeness * np.maximum(n[x], n[y])
        yield x[fits], y[fits]


def _by_key(run: Callable[..., tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives ``run`` the other columns of each value of the first one, in batches sorted by it, and makes src, dst of the results."""

    def give(table: pa.Table) -> pa.RecordBatch:
        key = table.column(0).to_numpy()
        edges = [*np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist(), len(key)] if len(key) else []
        found = [run(*(table.column(c).slice(a, b - a) for c in range(1, table.num_columns))) for a, b in zip(edges, edges[1:]) if b - a > 1]
        src, dst = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst))], names=["src", "dst"])

    def all_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            if held and key[-1] == held[-1].column(0)[0].as_py():  # the last key goes on
                held.append(batch)
                continue
            last = int(np.searchsorted(key, key[-1]))
            yield give(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield give(pa.Table.from_batches(held))

    return all_batches


def candidates(prints: DataFrame, likeness: float) -> DataFrame:
    """src, dst: stars that join what a path of :func:`near_pairs` in any top node joins; ``prints`` has fp, n, hi and lo."""
    masks = enumerate(table_masks(prints.count()))
    keys = F.explode(F.array(*(F.xxhash64(F.lit(t), F.col("hi").bitwiseAND(F.lit(signed(a))), F.col("lo").bitwiseAND(F.lit(signed(b)))) for t, (a, b) in masks)))
    dealt = prints.where("n > 0").select(keys.alias("key"), "fp", "n", "hi", "lo").repartition(shuffle_partitions(prints), "key").sortWithinPartitions("key")

    def run(fp, n, hi, lo):
        fp, n, hi, lo = fp.to_numpy(), n.to_numpy(), hi.to_numpy().view(np.uint64), lo.to_numpy().view(np.uint64)
        parent = np.arange(len(fp))
        for x, y in near_pairs(hi, lo, n, likeness):
            _union(parent, x, y)
        linked = parent != np.arange(len(fp))
        return fp[linked], fp[parent[linked]]

    by_key = _by_key(run)
    return dealt.mapInArrow(lambda batches: by_key(gathered(batches, ROWS_AT_ONCE)), "src bigint, dst bigint").distinct()


def pivots(groups: DataFrame) -> DataFrame:
    """root and pivot, the fp of each group's row that is nearest to the majority of the group's bits; ``groups`` has root, fp, hi and lo."""
    bits = [(c, b) for c in ("hi", "lo") for b in range(64)]
    counts = groups.groupBy("root").agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned(c, b).bitwiseAND(F.lit(1))).alias(f"{c}{b}") for c, b in bits))
    major = {c: F.lit(0).cast("bigint") for c in ("hi", "lo")}
    for c, b in bits:
        major[c] = major[c].bitwiseOR(F.when(F.col(f"{c}{b}") * 2 > F.col("n"), F.lit(signed(1 << b))).otherwise(F.lit(0)))
    far = F.bit_count(F.col("hi").bitwiseXOR(F.col("mid_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("mid_lo")))
    placed = groups.join(counts.select("root", major["hi"].alias("mid_hi"), major["lo"].alias("mid_lo")), "root")
    return placed.groupBy("root").agg(F.min(F.struct(far.alias("far"), "fp")).alias("one")).select("root", F.col("one.fp").alias("pivot"))


def _part(salt: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "fp"), parts).cast("int")


def _parts(rows: Column) -> Column:
    return F.ceil(rows / F.lit(GROUP)).cast("int")


def against_pivot(large: DataFrame, shingle: int, likeness: float) -> DataFrame:
    """The columns of ``large`` (a row for each text of groups of ``size`` texts), pivot, and whether and how far (Jaccard distance) a text is like its group's pivot.

    A group's pivot goes once to each of its parts, so no task has a whole group.
    """
    one = pivots(large.select("root", "fp", "hi", "lo")).join(large.select("size", F.col("fp").alias("pivot"), F.col("raw").alias("pivot_raw")), "pivot")
    one = durable(one.select("root", "pivot", "pivot_raw", F.explode(F.sequence(F.lit(0), _parts(F.col("size")) - 1)).alias("part")), "simhash-pivots")
    met = large.withColumn("part", _part("pivot", _parts(F.col("size")))).join(one, ["root", "part"])

    def make():
        held: tuple[bytes, set[bytes]] = (b"", set())

        def compare(raw, pivot_raw):
            nonlocal held
            if held[0] != pivot_raw:
                held = pivot_raw, shingle_set(pivot_raw, shingle)
            own = shingle_set(raw, shingle)
            both = len(own & held[1])
            of = len(own) + len(held[1]) - both
            return both + 1e-9 >= likeness * of, 1 - both / max(1, of)

        return compare

    return durable(row_map(met, make, "alike boolean, far double", [*large.columns, "pivot"], ["raw", "pivot_raw"]), "simhash-judged")


def alike_links(docs: DataFrame, prints: DataFrame, shingle: int, likeness: float) -> DataFrame:
    """src, dst: links between texts of ``likeness`` or more that join what a path of such links between candidates joins.

    ``prints`` has a row for each fp, with the hash of one of its texts as key.
    A group of at most ``GROUP`` texts meets as a whole.  In a larger one every text
    is compared with a pivot first.  Those like it are joined, and need not meet each
    other; the others are the group of the next round.  Between the two, the distance
    to the pivot rules out whoever cannot be alike, as Jaccard distance is a metric;
    what is left meets by pairs of parts.  A group that a round made smaller by less
    than an eighth has no middle, and meets by pairs of parts.
    """
    groups = durable(connected_components(durable(candidates(prints, likeness), "simhash-near")).select(F.col("node").alias("fp"), "root"), "simhash-groups")
    groups = durable(groups.join(prints, "fp"), "simhash-members")
    texts = marked(docs.select(text_hash().alias("key"), "text"), F.col("key"), groups.select("key"), "some").where("some").groupBy("key").agg(F.min("text").alias("text"))
    members = groups.join(texts, "key").select("root", "fp", "n", "hi", "lo", text_bytes().alias("raw"))
    small_batches(docs.sparkSession)
    sizes = durable(groups.groupBy("root").agg(F.count("*").alias("size")).withColumn("before", F.lit(None).cast("bigint")), "simhash-sizes")
    held = [groups]
    if not sizes.where(F.col("size") > GROUP).isEmpty():
        members = durable(members, "simhash-texts")
        held.append(members)
    met, found = [], []

    def meet(rows: DataFrame, part: Column, first: Column, last: Column) -> None:
        """Let each row, of ``part``, meet those of the parts from first to last."""
        rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(first, last)))
        key = F.xxhash64("root", F.lit(len(met)), F.least("part", "other"), F.greatest("part", "other"))
        met.append(rows.select(key.alias("key"), "fp", "n", "hi", "lo", "part", (F.col("part") == F.col("other")).alias("own"), "raw"))

    zero = F.lit(0)
    while True:
        sized = members.join(sizes, "root")
        pivoted = (F.col("size") > GROUP) & (F.col("before").isNull() | (F.col("size") <= 0.875 * F.col("before")))
        parts = _parts(F.col("size"))
        meet(sized.where(~pivoted), _part("part", parts), zero, parts - 1)
        if sizes.where(pivoted).isEmpty():
            break
        judged = against_pivot(sized.where(pivoted).drop("before"), shingle, likeness)
        found.append(judged.where("alike AND fp != pivot").select(F.least("fp", "pivot").alias("src"), F.greatest("fp", "pivot").alias("dst")))
        reach = F.lit(1 - likeness + 1e-6)
        edges = judged.groupBy("root").agg(F.max(F.when(F.col("alike"), F.col("far"))).alias("top"), F.min(F.when(~F.col("alike"), F.col("far"))).alias("low"))
        between = judged.join(edges, "root").where((F.col("alike") & (F.col("far") + reach >= F.col("low"))) | (~F.col("alike") & (F.col("far") <= F.col("top") + reach)))
        between = durable(between.drop("size", "pivot", "top", "low"), "simhash-between")
        held += [judged, between]
        counts = between.groupBy("root").agg(F.count_if("alike").alias("here"), F.count_if(~F.col("alike")).alias("there")).where("here > 0 AND there > 0")
        here, there = _parts(F.col("here")), _parts(F.col("there"))  # parts of those like the pivot, and after them of the others
        part = F.when(F.col("alike"), _part("part", here)).otherwise(here + _part("part", there))
        meet(between.join(counts, "root"), part, F.when(F.col("alike"), here).otherwise(zero), F.when(F.col("alike"), here + there).otherwise(here) - 1)
        members = judged.where("NOT alike").select("root", "fp", "n", "hi", "lo", "raw")
        sizes = durable(judged.groupBy("root").agg(F.count_if(~F.col("alike")).alias("size"), F.max("size").alias("before")).where("size > 0"), "simhash-sizes")
    meets = met[0]
    for more in met[1:]:
        meets = meets.union(more)
    meets = meets.repartition(shuffle_partitions(docs), "key").sortWithinPartitions("key")

    def run(fp, n, hi, lo, part, own, raw):
        fp, n, hi, lo, part = fp.to_numpy(), n.to_numpy(), hi.to_numpy().view(np.uint64), lo.to_numpy().view(np.uint64), part.to_numpy()
        within = own[0].as_py()  # a part against itself, or two parts against each other
        numbers: dict[bytes, int] = {}
        sets = [np.array([numbers.setdefault(s, len(numbers)) for s in sorted(shingle_set(r.as_py(), shingle))], np.int64) for chunk in raw.chunks for r in chunk]
        mark, parent, src, dst = np.zeros(len(numbers), bool), list(range(len(fp))), [], []

        def find(i):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for x, y in near_pairs(hi, lo, n, likeness):
            if not within:
                x, y = (v[part[x] != part[y]] for v in (x, y))
            at = -1
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if find(i) == find(j):
                    continue
                if i != at:
                    mark[:] = False
                    mark[sets[i]] = True
                    at = i
                both = int(np.count_nonzero(mark[sets[j]]))
                if both + 1e-9 >= likeness * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
                    src.append(fp[i])
                    dst.append(fp[j])
            mark[:] = False
        return np.array(src, np.int64), np.array(dst, np.int64)

    linked = meets.mapInArrow(_by_key(run), "src bigint, dst bigint")
    for more in found:
        linked = linked.union(more)
    linked = durable(linked, "simhash-alike")
    for x in held:
        release(x)
    return linked


def _classed(docs: DataFrame, shingle: int, likeness: float | None) -> tuple[DataFrame, DataFrame]:
    """doc_id, key and fp of every row; fp, root and component_id of every different fp."""
    small_batches(docs.sparkSession)
    prints = durable(fingerprints(docs, shingle) if likeness is None else wide_prints(docs, shingle), "simhash")
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"), *(F.min(c).alias(c) for c in prints.columns[3:])), "simhash-classes")
    found = durable(links(classes.select("fp")), "simhash-links") if likeness is None else alike_links(docs, classes.drop("first_id"), shingle, likeness)
    roots = connected_components(found)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = durable(rooted, "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = durable(rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"), "simhash-ids")
    for x in (found, classes, rooted):
        release(x)
    return prints.select("doc_id", "key", "fp"), ids


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, likeness: float | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``.

    Without ``likeness`` texts link at ``LINK`` bits of their fingerprints fp; with
    it at that Jaccard coefficient of their shingles, and fp is the text's key.
    """
    prints, ids = _classed(docs, shingle, likeness)
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, likeness: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: the one of the smallest doc_id.

    Null ids come after all others.  Rows are told apart by doc_id and text, so
    unlike texts under one id stay or go on their own; of like texts under one id
    that of the smallest hash stays, and of equal rows one.  Texts whose row certainly stays are not
    shuffled: only rows that :func:`~tarnwater.llm.common.marked` finds among those that go meet these.
    """
    prints, ids = _classed(docs, shingle, likeness)
    rows = prints.groupBy("fp", "key", "doc_id").agg(F.count("*").alias("n"))
    rows = durable(rows.join(ids.select("fp", "root"), "fp"), "simhash-rows")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    first = durable(rows.groupBy("root").agg(F.min(place).alias("first")), "simhash-first")
    row_key = lambda i, key: F.xxhash64(F.coalesce(i, F.lit(-1)), i.isNull(), key)
    judged = rows.join(first, "root").withColumn("stays", place == F.col("first")).where("NOT stays OR n > 1")
    judged = durable(judged.select(row_key(F.col("doc_id"), F.col("key")).alias("_tarnwater_key"), "stays"), "simhash-go")
    for x in (prints, ids, rows, first):
        release(x)
    packed = docs.select(F.struct("*").alias("row"), row_key(F.col("doc_id"), text_hash()).alias("key"))
    packed = marked(packed, F.col("key"), judged.select("_tarnwater_key"), "some")
    some = packed.where("some").join(judged, F.col("key") == F.col("_tarnwater_key"), "left")
    once = some.where("_tarnwater_key IS NULL").select("row.*")
    many = some.where("stays").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
    return packed.where("NOT some").select("row.*").union(once).union(many)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
ORACLES: dict[str, str] = {}
