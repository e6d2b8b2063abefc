"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is lower-cased (A-Z), every ASCII character that is not a letter becomes
a space, and the words are cut into windows of ``WINDOW`` words every ``STRIDE``
words, half a window, so windows overlap; the last one ends with the text.  Each
word enters as its own vector (words of the training vocabulary, told apart by a
hash of the whole word; all others share one) next to the mean of the vectors of
its character trigrams, the word's edges included.  Two gated recurrent layers run
over the window in both directions, attention weighs the states, and a linear unit
gives the window's logit.  A text scores as its highest window: all windows of the
whole text are scored.

Learning is back-propagation through time with Adam, first on all windows under
their text's label, then on each text's highest window (and random other ones of
texts labelled 0), as a toxic text need not be toxic throughout.  In an epoch of
learning, windows lie end to end from a place drawn anew, so each covers the whole
of every text of the sample.  Small samples are gone over more often: epochs are
multiplied by 2000 / texts, rounded, at least 1 and at most 5.

Labels are learnt from a bounded sample: at most ``SAMPLE`` labelled rows of class 1
and ``NEGATIVES`` of class 0, those with the smallest hash of doc_id, of texts of at
most ``LONGEST`` bytes and, in the order of the hash, ``SAMPLE_BYTES`` in all; of
repeated ids one row.  This bounds what the driver holds.  Nothing else is bounded:
every row is scored.  Only doc_id (to find label and fold) and text are read.

Defined cases: null, empty and wordless texts are one window of no words and
score as the network's bias alone; labels that are null or not 0 or 1 are left
out; repeated rows each get a row; without labels of both classes every score is
0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwater.llm.common import batch_map, crc_mod, read_table, text_bytes
from tarnwater.llm.quality import labelled

SAMPLE, NEGATIVES = 1500, 3500
SAMPLE_BYTES, LONGEST = 8 << 20, 1 << 17
WINDOW, STRIDE = 32, 16
WORDS, LEAST_TEXTS, _SLOT_BITS = 8192, 4, 13
SLOTS = 1 << _SLOT_BITS
WORD_DIM, CHAR_DIM, H, ATT = 12, 8, 8, 8
D = WORD_DIM + CHAR_DIM
EPOCHS, ALL_EPOCHS, RATE, DROP = 9, 2, 0.01, 0.15
#: Windows that the network takes at a time.
TOGETHER = 2048

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts.

    ``of`` has the number of each word among the different ones, text after text,
    and ``sizes`` the words of each text.  A different word has a hash, and its
    trigrams' slots stand in ``slots`` from ``first`` on, ``length`` of them.  One
    more word and place at the end stand for none.
    """

    def __init__(self, raws: list[bytes]):
        text = np.frombuffer(b" " + b" ".join(r.translate(_LETTERS) for r in raws) + b"  ", np.uint8)
        letter = text != 32
        change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        start, length = change[::2], change[1::2] - change[::2]
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        self.sizes = np.diff(np.searchsorted(start, ends), prepend=0)
        before = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(before, length)
        power = np.multiply.accumulate(np.full(int(length.max(initial=0)) + 1, _MIX))
        h = np.add.reduceat(text[letter] * power[place], before) if len(start) else np.zeros(0, np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h, at, of = np.unique(h ^ (h >> np.uint64(31)), return_index=True, return_inverse=True)
        self.hashes, self.of = np.append(h, np.uint64(0)), np.append(of, len(h)).astype(np.int32)
        start, self.length = start[at], np.append(length[at], 1)
        self.first = np.cumsum(self.length) - self.length
        grams = np.repeat(start - 1 - self.first[:-1], self.length[:-1]) + np.arange(self.first[-1])
        key = text[grams] | text[grams + 1].astype(np.uint64) << np.uint64(8) | text[grams + 2].astype(np.uint64) << np.uint64(16)
        self.slots = np.append(((key * _MIX) >> np.uint64(64 - _SLOT_BITS)).astype(np.int32), 0)

    def trigrams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of different words, one after the other, and where each begins."""
        n = self.length[words]
        begin = np.cumsum(n) - n
        return self.slots[np.repeat(self.first[words] - begin, n) + np.arange(n.sum())], begin


def windows_of(n: int) -> np.ndarray:
    """First words of all windows of a text of n words."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.tanh(x * np.float32(0.5))
    x += 1
    x *= np.float32(0.5)
    return x


class Network:
    """The parameters and what is computed with them."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        random = np.random.default_rng(seed)
        make = lambda *shape, s=None: (random.standard_normal(shape) * (s or shape[0] ** -0.5)).astype(np.float32)
        self.vocabulary = vocabulary  # hashes, ascending; word i has row i + 1
        self.p = {"word": make(len(vocabulary) + 1, WORD_DIM, s=0.1), "char": make(SLOTS, CHAR_DIM, s=0.2)}
        for side in "fb":
            self.p |= {f"x{side}": make(D, 3 * H), f"h{side}": make(H, 3 * H), f"c{side}": np.zeros(3 * H, np.float32)}
        self.p |= {"att": make(2 * H, ATT), "ask": make(ATT, 1), "out": make(2 * H, 1), "bias": np.zeros(1, np.float32)}

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the word table; 0 for unknown words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)

    def characters(self, words: Words, different: np.ndarray) -> np.ndarray:
        """The mean vector of the trigrams of different words."""
        slots, begin = words.trigrams(different)
        return np.add.reduceat(self.p["char"][slots], begin) / words.length[different][:, None].astype(np.float32)

    def embed(self, words: Words) -> np.ndarray:
        """The vectors of all different words."""
        return np.concatenate([self.p["word"][self.rows(words.hashes)], self.characters(words, np.arange(len(words.hashes)))], axis=1)

    def _states(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States of one direction, shape (WINDOW, windows, H); x: embedded words, time first."""
        u, out = self.p["h" + side], np.empty((len(x), x.shape[1], H), np.float32)
        gates = (x.reshape(-1, D) @ self.p["x" + side] + self.p["c" + side]).reshape(len(x), -1, 3 * H)
        h = np.zeros((x.shape[1], H), np.float32)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            g, hu = gates[t], h @ u
            zr = _sigmoid(g[:, : 2 * H] + hu[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            new = np.tanh(g[:, 2 * H :] + r * hu[:, 2 * H :])
            before = h
            h = new + z * (h - new)
            if mask is not None:
                h = np.where(mask[t], h, before)
            if keep is not None:
                keep.append((t, before, z, r, new, hu[:, 2 * H :]))
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; x (WINDOW, windows, D), mask (WINDOW, windows, 1) or None if all are full."""
        steps = {side: [] if keep is not None else None for side in "fb"}
        s = np.concatenate([self._states(x, mask, side, steps[side]) for side in "fb"], axis=2)
        flat = s.reshape(-1, 2 * H)
        a = np.tanh(flat @ self.p["att"])
        e = (a @ self.p["ask"]).reshape(s.shape[:2])
        if mask is not None:
            e = np.where(mask[:, :, 0], e, np.float32(-30))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, s)
        if keep is not None:
            keep |= {"x": x, "mask": mask, "steps": steps, "s": s, "a": a, "w": w, "pooled": pooled}
        return (pooled @ self.p["out"])[:, 0] + self.p["bias"]

    def gates(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """What words give to the gates of both directions, a column for each of the ``vectors``."""
        return {side: np.ascontiguousarray((vectors @ self.p["x" + side] + self.p["c" + side]).T) for side in "fb"}

    def logits(self, table: dict[str, np.ndarray], words: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """As :meth:`forward` without what learning needs; ``words`` (WINDOW, windows) are columns of the :meth:`gates` table."""
        x, n = words, words.shape[1]
        s = np.empty((len(x), 2 * H, n), np.float32)
        for k, side in enumerate("fb"):
            u, h = np.ascontiguousarray(self.p["h" + side].T), np.zeros((H, n), np.float32)
            for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
                g, hu = table[side].take(x[t], axis=1), u @ h
                zr = g[: 2 * H]
                zr += hu[: 2 * H]
                zr *= np.float32(0.5)
                np.tanh(zr, out=zr)
                zr += 1
                zr *= np.float32(0.5)
                new, after = g[2 * H :], s[t, k * H : (k + 1) * H]
                new += zr[H:] * hu[2 * H :]
                np.tanh(new, out=new)
                np.subtract(h, new, out=after)
                after *= zr[:H]
                after += new
                if mask is not None:
                    after[:] = np.where(mask[t, :, 0], after, h)
                h = after
        a = np.matmul(self.p["att"].T, s)
        np.tanh(a, out=a)
        e = np.matmul(self.p["ask"].T, a)[:, 0]
        if mask is not None:
            e = np.where(mask[:, :, 0], e, np.float32(-30))
        w = np.exp(e - e.max(axis=0))
        return (np.matmul(self.p["out"].T, s)[:, 0] * w).sum(axis=0) / w.sum(axis=0) + self.p["bias"]

    def backward(self, keep: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of the embedded words, from d loss / d logit."""
        s, w, p = keep["s"], keep["w"], self.p
        grad = {"out": keep["pooled"].T @ slope[:, None], "bias": slope.sum(keepdims=True)}
        pooled = slope[:, None] * p["out"][:, 0]
        ds = w[:, :, None] * pooled
        dw = np.einsum("nh,tnh->tn", pooled, s)
        de = w * (dw - (w * dw).sum(axis=0))
        grad["ask"] = keep["a"].T @ de.reshape(-1, 1)
        da = de.reshape(-1, 1) * p["ask"][:, 0] * (1 - keep["a"] ** 2)
        grad["att"] = s.reshape(-1, 2 * H).T @ da
        ds = ds + (da @ p["att"].T).reshape(s.shape)
        dx = np.zeros_like(keep["x"])
        for k, side in enumerate("fb"):
            u, du, dh = p["h" + side], np.zeros((H, 3 * H), np.float32), 0
            dgates = np.empty((len(s), s.shape[1], 3 * H), np.float32)
            for t, before, z, r, new, hun in reversed(keep["steps"][side]):
                total = ds[t][:, k * H : (k + 1) * H] + dh
                m = 1 if keep["mask"] is None else keep["mask"][t]
                inner = total * m
                dn = inner * (1 - z) * (1 - new**2)
                dz = inner * (before - new) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ dhu
                dh = dhu @ u.T + inner * z + total * (1 - m)
            flat = dgates.reshape(-1, 3 * H)
            grad |= {"h" + side: du, "x" + side: keep["x"].reshape(-1, D).T @ flat, "c" + side: flat.sum(axis=0)}
            dx += (flat @ p["x" + side].T).reshape(dx.shape)
        return grad, dx

    def gather(self, words: int, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Places of the words of windows, time first; a mask if some are short."""
        step = np.arange(WINDOW)[:, None]
        inside = step < lengths
        at = np.minimum(starts + np.where(inside, step, 0), words - 1)
        return at, None if inside.all() else inside[:, :, None]

    def window_logits(self, words: Words, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The logits of windows, given by first words and lengths."""
        table, logits = self.gates(self.embed(words)), np.empty(len(starts), np.float32)
        for group in (np.flatnonzero(lengths == WINDOW), np.flatnonzero(lengths < WINDOW)):
            for i in range(0, len(group), TOGETHER):
                part = group[i : i + TOGETHER]
                at, mask = self.gather(len(words.of), starts[part], lengths[part])
                logits[part] = self.logits(table, words.of[at], mask)
        return logits

    def scores(self, raws: list[bytes]) -> np.ndarray:
        """The highest window's probability of each text."""
        words = Words(raws)
        offsets = np.cumsum(words.sizes) - words.sizes
        firsts = [windows_of(n) for n in words.sizes.tolist()]
        counts = np.array([len(f) for f in firsts], np.int64)
        starts = np.concatenate([f + o for f, o in zip(firsts, offsets.tolist(), strict=True)] or [np.zeros(0, np.int64)])
        logits = self.window_logits(words, starts, np.repeat(np.minimum(words.sizes, WINDOW), counts))
        top = np.maximum.reduceat(logits, np.cumsum(counts) - counts) if len(counts) else logits
        return 1 / (1 + np.exp(-top.astype(np.float64)))


def fit(raws: list[bytes], y: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> Network:
    """Train on texts and labels (0 or 1); every sixth text only sets where the logit is 0."""
    aside = np.arange(len(raws)) % 6 == 5
    if len(set(y[aside].tolist())) < 2:
        aside[:] = False
    net = _fit([r for r, a in zip(raws, aside, strict=True) if not a], y[~aside], seed, epochs)
    if aside.any():
        p = np.clip(net.scores([r for r, a in zip(raws, aside, strict=True) if a]), 1e-9, 1 - 1e-9)
        logit, up = np.log(p / (1 - p)), y[aside] == 1
        cuts = np.unique(np.r_[logit, 0.0])
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        wrong = np.array([(logit[up] < c).sum() + (logit[~up] >= c).sum() for c in cuts])
        best = cuts[wrong == wrong.min()]
        net.p["bias"] -= np.float32((best.min() + best.max()) / 2)
    return net


def _vocabulary(words: Words) -> np.ndarray:
    """Hashes of the words that most texts have, ``LEAST_TEXTS`` at least, ascending."""
    text = np.repeat(np.arange(len(words.sizes)), words.sizes)
    pairs = np.unique(text * len(words.hashes) + words.of[:-1]) % len(words.hashes)
    texts = np.bincount(pairs, minlength=len(words.hashes))
    common = np.lexsort((words.hashes, -texts))[:WORDS]
    return np.sort(words.hashes[common[texts[common] >= LEAST_TEXTS]])


def _end_to_end(n: int, random: np.random.Generator) -> np.ndarray:
    """First words of windows that cover a text of n words, end to end from a random place."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.clip(np.arange(-random.integers(WINDOW), n, WINDOW), 0, n - WINDOW))


def _fit(raws: list[bytes], y: np.ndarray, seed: int, epochs: int) -> Network:
    random = np.random.default_rng(seed)
    words = Words(raws)
    net = Network(_vocabulary(words))
    if not y.any() or y.all():
        net.p["bias"][:] = -np.inf
        return net
    row, of, sizes = net.rows(words.hashes), words.of, words.sizes
    offsets = np.cumsum(sizes) - sizes
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, times = 0, max(1, min(5, round(2000 / len(raws))))
    epochs, early = epochs * times, ALL_EPOCHS * times
    for epoch in range(epochs):
        begins = [_end_to_end(n, random) for n in sizes.tolist()]
        text = np.repeat(np.arange(len(raws)), [len(b) for b in begins])
        starts = np.concatenate(begins) + offsets[text]
        lengths = np.minimum(sizes[text], WINDOW)
        share = np.ones(len(text), np.float32)
        if epoch >= early:
            logits = net.window_logits(words, starts, lengths)
            order = np.lexsort((-logits, text))
            top = np.zeros(len(text), bool)
            top[order[np.r_[True, text[order][1:] != text[order][:-1]]]] = True
            pick = np.flatnonzero(top | ((y[text] == 0) & (random.random(len(text)) < 0.25)))
        else:
            pick = np.arange(len(text))
            share = 1 / np.bincount(text)[text].astype(np.float32) * 4
        pick = random.permutation(pick)
        for i in range(0, len(pick), 192):
            part = pick[i : i + 192]
            at, mask = net.gather(len(of), starts[part], lengths[part])
            different, which = np.unique(of[at], return_inverse=True)
            which = which.reshape(at.shape)
            w = np.where(random.random(at.shape) < DROP, 0, row[different][which])  # some words as if unknown
            x = np.concatenate([net.p["word"][w], net.characters(words, different)[which]], axis=2)
            keep: dict = {}
            logit = net.forward(x, mask, keep)
            slope = ((1 / (1 + np.exp(-logit)) - y[text[part]]) * weight[text[part]] * share[part] / len(part)).astype(np.float32)
            grad, dx = net.backward(keep, slope)
            if mask is not None:
                dx = dx * mask
            grad["word"], grad["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(grad["word"], w.ravel(), dx[:, :, :WORD_DIM].reshape(-1, WORD_DIM))
            each = np.zeros((len(different), CHAR_DIM), np.float32)
            np.add.at(each, which.ravel(), dx[:, :, WORD_DIM:].reshape(-1, CHAR_DIM))
            length = words.length[different]
            np.add.at(grad["char"], words.trigrams(different)[0], np.repeat(each / length[:, None].astype(np.float32), length, axis=0))
            step += 1
            rate = RATE * min(1, 2 * (1 - epoch / epochs)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, fold, sample: tuple[int, int] = (NEGATIVES, SAMPLE)) -> Network:
    """Fit on the labelled rows for which ``fold`` (an expression on doc_id) holds."""
    got = labelled(docs, labels, "toxic", fold, sample, LONGEST, SAMPLE_BYTES).collect()
    got.sort(key=lambda r: r.doc_id)
    return fit([bytes(r.raw) for r in got], np.array([r.label for r in got], np.float32))


def scores(docs: DataFrame, network: Network, keep: list[str]) -> DataFrame:
    """``keep``, score and predicted of each row."""
    return batch_map(
        docs.select("*", text_bytes().alias("_tarnwater_raw")),
        lambda: lambda raws: [(float(s), int(s >= 0.5)) for s in (network.scores(raws) if raws else [])],
        "score double, predicted int", keep, ["_tarnwater_raw"],
    )


def op4_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 0
    network = train(docs, read_table(spark, sf_dir, "labels"), ~held)
    return scores(docs, network, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity_bigru": op4_toxicity_bigru}
ORACLES: dict[str, str] = {}
