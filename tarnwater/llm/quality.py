"""Quality classifier: Bradley-Terry pairwise ranking, thresholded at a score quantile.

A document's score is linear in :func:`features` of its whole text.  The weights
maximise the Bradley-Terry likelihood of the preference pairs, which are all pairs of a
text labelled 1 and one labelled 0 of the training rows: logistic loss on the
difference of their features.  The threshold is the score quantile at the training
rows' share of label 0; where the classes hardly overlap (nine tenths of the rows labelled 0
score under nine tenths of those labelled 1), any place in the gap between two
neighbouring scores is that quantile, and its middle is taken.
:meth:`Ranker.score` maps a score to 0..1 with 0.5 at the threshold.

Every labelled row of the training folds is learnt from.  Their features are a written
table, and whatever :func:`fit` needs is a sum over its rows, so the driver holds no
rows (but some :data:`MANY` scores about a quantile).  A pair's loss depends on the
difference of two scores, so all pairs are summed from the counts of scores in cells of
1 / ``CELLS``, each score shared by the two nearest cell edges (a pair's slope is off by
at most 1e-5); slopes come from these counts, and Newton's method takes its curvature
from a coarser grid, which changes the steps and not where they end.  Quantiles are exact.
Only doc_id (to find the label and the fold) and text are read; doc_id never enters a feature.

Defined cases: null texts count as empty and have features of their own; labels
that are null or not 0 or 1 are left out, and of several for an id the least counts;
each row of documents with a label counts, and repeated rows each get a row; without
labels of both classes every score is 0.5 and every prediction 1.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwater.llm.common import batch_map, crc_mod, durable, gathered, marked, read_table, release, text_bytes

#: Steps of the optimiser at most, weight of the squared norm.
STEPS, DECAY = 60, 1e-4
#: Cells of a unit of score, cells that are counted as one array, and cells to one of the coarser grid, which has at most so many.
CELLS, BLOCK, COARSE, COARSE_MOST = 64, 256, 32, 256
#: Rows that a task works on at a time, scores that the driver takes of each quantile, and results it adds up itself.
ROWS, MANY, RESULTS = 16_384, 20_000, 64
#: Bytes of rows that a file of a written table holds, where the cores alone don't make for more files.
FILE_BYTES = 32 << 20

#: Calls a function with features and labels of ever other training rows, and gives its results added up by key.
Total = Callable[[Callable[[np.ndarray, np.ndarray], dict]], dict]

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t", ".", ",", ";:", "!?", "'\"", "()[]{}<>", "#", "$", "%", "&", "*", "|", "@", "/\\_~^=+-"]
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i + 1
_CLASS[128:] = len(_CLASSES) + 1


def features(raw: bytes) -> np.ndarray:
    """Numbers that describe a whole text: shares of character classes, and how words, lines and word pairs repeat."""
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_CLASS, counts, len(_CLASSES) + 2) / max(n, 1)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    w, m = len(words), len(lines)
    different = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    repeated = sum([a == b for a, b in zip(words, words[1:], strict=False)])
    p = counts[counts > 0] / max(n, 1)
    rest = [
        np.log1p(n) / 10, np.log1p(w) / 10, np.log1p(m) / 10, n / max(w, 1) / 10, w / max(m, 1) / 50,
        different / max(w, 1), pairs / max(w - 1, 1), repeated / max(w - 1, 1), len(set(lines)) / max(m, 1),
        different / max(w, 1) ** 0.75, float(-(p * np.log(p)).sum()) / 4, float(w == 0),
    ]
    return np.concatenate([np.sqrt(shares), shares, rest])


class Ranker:
    """Weights, threshold and scale of a fitted ranking."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, spread: float):
        self.centre, self.scale, self.weights, self.threshold, self.spread = centre, scale, weights, threshold, spread

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.standard(x) * self.weights).sum(axis=1)  # the same for a row in whatever batch

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.spread, -30, 30)))


def added(parts: Iterable[dict]) -> dict:
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            out[k] = out[k] + v if k in out else v
    return out


def total_of(rows: DataFrame) -> Total:
    """Sums over a table with the columns x (features) and label; results of many tasks are added up by tasks first."""
    tasks = rows.rdd.getNumPartitions()

    def total(function):
        def blob(parts: Iterable[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(added(parts))], pa.binary())], names=["blob"])

        def arrays(batch: pa.RecordBatch) -> dict:
            y = batch.column("label").to_numpy()
            return function(batch.column("x").flatten().to_numpy().reshape(len(y), -1), y) if len(y) else {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield blob(map(arrays, gathered(batches, ROWS)))

        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield blob(pickle.loads(x.as_py()) for batch in batches for x in batch.column("blob"))

        blobs = rows.mapInArrow(run, "blob binary")
        if tasks > RESULTS:
            blobs = blobs.repartition(math.isqrt(tasks)).mapInArrow(more, "blob binary")
        return added(pickle.loads(r.blob) for r in blobs.collect())

    return total


def cells(s: np.ndarray, y: np.ndarray, shared: bool) -> dict[int, np.ndarray]:
    """Rows of either class in the cells of the scores, in arrays of ``BLOCK`` by the number of the array.

    ``shared``: a score counts for both edges of its cell, the more the nearer.
    """
    at = np.floor(s * CELLS).astype(np.int64)
    part = s * CELLS - at if shared else np.zeros(len(s))
    first = int(at.min()) // BLOCK
    size = (int(at.max() + 1) // BLOCK + 1 - first) * BLOCK
    place = y * size + at - first * BLOCK
    counts = np.bincount(place, 1 - part, 2 * size) + np.bincount(place + 1, part, 2 * size)
    blocks = counts.reshape(2, -1, BLOCK)
    return {first + i: blocks[:, i] for i in range(blocks.shape[1]) if blocks[:, i].any()}


def line(blocks: dict[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The number of the first cell, and the counts of either class from there on."""
    first, last = min(blocks), max(blocks)
    out = np.zeros((2, (last + 1 - first) * BLOCK))
    for i, block in blocks.items():
        out[:, (i - first) * BLOCK : (i - first + 1) * BLOCK] = block
    return first * BLOCK, out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def against(function: Callable[[np.ndarray], np.ndarray], shares: np.ndarray, width: float) -> np.ndarray:
    """For each cell, the mean of ``function`` of the score's difference to the scores whose ``shares`` are given."""
    n = len(shares)
    size = 1 << (3 * n).bit_length()
    values = function(np.arange(1 - n, n) * width)
    return np.fft.irfft(np.fft.rfft(values, size) * np.fft.rfft(shares, size), size)[n - 1 : 2 * n - 1]


def slopes(total: Total, ranker: Ranker, first: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the mean loss of all pairs; ``counts`` are those of the ranker's scores."""
    sides = counts.sum(axis=1)
    shares = counts / sides[:, None]
    lost = [against(sigmoid, shares[1], 1 / CELLS), -against(lambda d: sigmoid(-d), shares[0], 1 / CELLS)]
    step = COARSE
    while counts.shape[1] // step > COARSE_MOST:
        step *= 2
    at = first + np.arange(counts.shape[1])
    begin = first // step
    size = int(at[-1]) // step + 2 - begin
    below, part = at // step - begin, at % step / step
    few = [np.bincount(below, c * (1 - part), size) + np.bincount(below + 1, c * part, size) for c in shares]
    bend = lambda d: sigmoid(d) * sigmoid(-d)
    bent = [against(bend, few[1 - side], step / CELLS) for side in (0, 1)]

    def sums(x: np.ndarray, y: np.ndarray) -> dict:
        z, s, out = ranker.standard(x), ranker.raw(x), {}
        for side in (0, 1):
            own, place = z[y == side], s[y == side] * CELLS
            if not len(own):
                continue
            slope = np.interp(place - first, np.arange(len(lost[side])), lost[side]) / sides[side]
            place = place / step - begin
            low = np.clip(np.floor(place).astype(np.int64), 0, size - 2)
            part = place - low
            curve = (bent[side][low] * (1 - part) + bent[side][low + 1] * part) / sides[side]
            spots = low[:, None] * own.shape[1] + np.arange(own.shape[1])
            sums = np.bincount(spots.ravel(), ((1 - part)[:, None] * own).ravel(), size * own.shape[1])
            sums += np.bincount((spots + own.shape[1]).ravel(), (part[:, None] * own).ravel(), size * own.shape[1])
            out = added([out, {"slope": slope @ own, "curve": (own * curve[:, None]).T @ own, side: sums.reshape(size, -1) / sides[side]}])
        return out

    got = total(sums)
    apart = (np.arange(size)[:, None] - np.arange(size)) * (step / CELLS)
    cross = got[1].T @ bend(apart) @ got[0]
    return got["slope"], got["curve"] - cross - cross.T


def smallest(total: Total, ranker: Ranker, wanted: list[tuple[tuple[int, ...], int]]) -> list[float]:
    """For each (classes, k) the score that k scores of these classes stand before in order, exactly."""
    start, counts = line(total(lambda x, y: cells(ranker.raw(x), y, False)))
    found: list[float | None] = [None] * len(wanted)
    open_: dict[int, tuple[float, float, int, int]] = {}  # from, to (not included), scores between, how many of these before

    def choose(i: int, n: np.ndarray, edges: np.ndarray, k: int) -> None:
        upto = np.cumsum(n)
        at = int(np.searchsorted(upto, k, "right"))
        open_[i] = (float(edges[at]), float(edges[at + 1]), int(n[at]), int(k - (upto[at] - n[at])))

    for i, (sides, k) in enumerate(wanted):
        choose(i, counts[list(sides)].sum(axis=0), (start + np.arange(counts.shape[1] + 1)) / CELLS, k)
    while open_:
        for i, (a, b, _, _) in list(open_.items()):
            if np.nextafter(a, np.inf) >= b:  # all the same
                found[i] = a
                del open_[i]
        parts = {i: np.linspace(a, b, 1025) if n > MANY else None for i, (a, b, n, _) in open_.items()}

        def look(x: np.ndarray, y: np.ndarray, asked=dict(open_), parts=parts) -> dict:
            s, out = ranker.raw(x), {}
            for i, (a, b, _, _) in asked.items():
                v = s[(s >= a) & (s < b) & np.isin(y, wanted[i][0])]
                out[i] = v.tolist() if parts[i] is None else np.bincount(np.searchsorted(parts[i], v, "right") - 1, minlength=1024)
            return out

        for i, got in (total(look) if open_ else {}).items():
            if parts[i] is None:
                found[i] = sorted(got)[open_.pop(i)[3]]
            else:
                choose(i, got, parts[i], open_[i][3])
    return found


def quantiles(total: Total, ranker: Ranker, asked: list[tuple[tuple[int, ...], int, float]]) -> list[float]:
    """For each (classes, their rows, share) the quantile, between two scores in proportion."""
    places = [(sides, (n - 1) * q, n) for sides, n, q in asked]
    got = smallest(total, ranker, [(sides, k) for sides, p, n in places for k in (int(p), min(int(p) + 1, n - 1))])
    return [low + (high - low) * (p - int(p)) for (_, p, _), low, high in zip(places, got[::2], got[1::2], strict=True)]


def fit_sums(total: Total) -> Ranker:
    """Learn from all training rows, each step from sums over them."""
    got = total(lambda x, y: {"n": np.bincount(y, minlength=2), "x": x.sum(axis=0)})
    width = len(got["x"]) if got else len(features(b""))
    bad, good = got.get("n", np.zeros(2, np.int64)).tolist()
    if not good or not bad:
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    n = good + bad
    centre = got["x"] / n
    scale = np.sqrt(total(lambda x, y: {"x": ((x - centre) ** 2).sum(axis=0)})["x"] / n)
    scale[scale < 1e-9] = 1.0

    def tried(weights):
        ranker = Ranker(centre, scale, weights, 0.0, 1.0)
        first, counts = line(total(lambda x, y: cells(ranker.raw(x), y, True)))
        bads, goods = counts / counts.sum(axis=1, keepdims=True)
        return ranker, first, counts, goods @ against(lambda d: np.logaddexp(0, -d), bads, 1 / CELLS) + DECAY / 2 * weights @ weights

    now = tried(np.zeros(len(centre)))
    for _ in range(STEPS):
        ranker, first, counts, loss = now
        slope, curve = slopes(total, ranker, first, counts)
        slope = slope + DECAY * ranker.weights
        move = np.linalg.solve(curve + DECAY * np.eye(len(slope)), slope)
        gain = float(slope @ move)
        part = 1.0
        now = tried(ranker.weights - move)
        while gain > 1e-6 and now[3] > loss - 1e-4 * part * gain + 1e-7 and part > 1e-3:
            part /= 2
            now = tried(ranker.weights - part * move)
        if gain < 1e-8:
            break
    ranker = Ranker(centre, scale, now[0].weights.round(8), 0.0, 1.0)  # the order of summing does not show
    threshold, low, high = quantiles(total, ranker, [((0, 1), n, bad / n), ((0,), bad, 0.9), ((1,), good, 0.1)])
    if low < high:  # the classes hardly overlap: the quantile's gap, not its edge
        k = int(total(lambda x, y: {"n": np.count_nonzero(ranker.raw(x) <= threshold)})["n"])
        below, above = smallest(total, ranker, [((0, 1), max(k - 1, 0)), ((0, 1), min(k, n - 1))])
        threshold = ((max(below, low) if k else low) + (min(above, high) if k < n else high)) / 2
    means = total(lambda x, y: {"s": (d := ranker.raw(x) - threshold).sum(), "q": (d**2).sum()})
    deviation = math.sqrt(max(0.0, means["q"] / n - (means["s"] / n) ** 2))
    spreads = [max(0.1 * deviation * k, 1e-6) for k in (0.5, 1, 2, 4, 8)]

    def losses(x, y):
        margin = (2 * y - 1) * (ranker.raw(x) - threshold)
        return {"all": np.array([np.logaddexp(0, -np.clip(margin / t, -30, 30)).sum() for t in spreads])}

    spread = spreads[int(np.argmin(total(losses)["all"]))]
    return Ranker(centre, scale, ranker.weights, threshold, spread)


def fit(x: np.ndarray, y: np.ndarray) -> Ranker:
    """Learn from feature rows ``x`` and labels ``y`` (0 or 1) at hand."""
    return fit_sums(lambda function: function(x, np.asarray(y, np.int64)) if len(y) else {})


def labelled(docs: DataFrame, labels: DataFrame, column: str, fold: Column, most: tuple[int, int], longest: int | None = None, in_all: int | None = None) -> DataFrame:
    """raw, label and doc_id of at most ``most`` labelled rows of class 0 and of class 1, by the hash of doc_id.

    One row for an id: of several, that of the least label and text.  ``longest``
    and ``in_all`` bound the bytes of a text and, by the hash, of all of them.
    """
    rows = labels.where(fold & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(F.col(column).cast("int")).alias("label"))
    order = F.xxhash64("doc_id")
    parts = [rows.where(F.col("label") == k).orderBy(order, "doc_id").limit(most[k]) for k in (0, 1)]
    chosen = parts[0].union(parts[1])  # at most sum(most) rows, so it may be broadcast
    texts = docs.select("doc_id", text_bytes().alias("raw"))
    if longest is not None:
        texts = texts.where(F.length("raw") <= longest)
        sizes = texts.select("doc_id", F.length("raw").alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("n").alias("n"))
        chosen = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(order, "doc_id"))).where(F.col("upto") <= in_all).select("doc_id", "label")
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("raw").alias("raw")).select("raw", "label", "doc_id")


def files(spark: SparkSession, rows: int, width: int) -> int:
    """How many files so many rows of ``width`` bytes go to, however many partitions a shuffle has: each file costs a task, and on local disks processes."""
    return max(spark.sparkContext.defaultParallelism, -(-rows * width // FILE_BYTES))


def training_rows(docs: DataFrame, labels: DataFrame, fold: Column) -> DataFrame:
    """x (features) and label of every row of ``docs`` that has a label and for whose doc_id ``fold`` holds."""
    spark = docs.sparkSession
    known = labels.where(fold & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "quality")
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("bigint")).alias("label"))
    known = durable(known.coalesce(files(spark, labels.count(), 16)), "quality-labels")
    texts = marked(docs.select("doc_id", text_bytes().alias("raw")), F.xxhash64("doc_id"), known.select(F.xxhash64("doc_id").alias("key")), "some").where("some")
    found = batch_map(texts, lambda: lambda raws: [(features(r).tolist(),) for r in raws], "x array<double>", ["doc_id"], ["raw"])
    found = found.join(known, "doc_id").select("x", "label")
    rows = durable(found.repartition(files(spark, known.count(), 8 * (len(features(b"")) + 1))), "quality-rows")
    release(known)
    return rows


def train(docs: DataFrame, labels: DataFrame, fold: Column) -> Ranker:
    """Fit on the labelled rows for which ``fold`` (an expression on doc_id) holds."""
    rows = training_rows(docs, labels, fold)
    ranker = fit_sums(total_of(rows))
    release(rows)
    return ranker


def scores(docs: DataFrame, ranker: Ranker, keep: list[str]) -> DataFrame:
    """``keep``, score and predicted of each row."""

    def make():
        def many(raws):
            s = ranker.score(np.array([features(r) for r in raws])) if raws else []
            return [(float(x), int(x >= 0.5)) for x in s]

        return many

    return batch_map(docs.select("*", text_bytes().alias("_tarnwater_raw")), make, "score double, predicted int", keep, ["_tarnwater_raw"])


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 3) == 1
    ranker = train(docs, read_table(spark, sf_dir, "labels"), ~held)
    return scores(docs, ranker, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_ranking": op10_quality_ranking}
ORACLES: dict[str, str] = {}
