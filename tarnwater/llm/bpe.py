"""BPE encoding and decoding by tree concatenation.

The tokenizer file says what a token is; this module says in which pieces a text
is encoded.

A text, normalised as the file states, is the root of a tree; its halves are
encoded on their own, down to leaves of ``LEAF`` characters that end at any place
(long texts do their leaves in a thread pool), and joins are mended on the way up:
a window around the join, of the tokens of 1, 2, 4, ... chunks of either side, is
encoded anew until it begins with the left side's chunk and tokens at that place
and ends with the right side's.  A chunk is a run without white space; no match of
the pre-tokeniser holds white space or looks past it, so a chunk's encoding depends
on the chunk alone, and from an agreed chunk on both sides are exact.

A word of more than ``WORD_LEAF`` bytes, which the pre-tokeniser leaves unsplit,
is a tree of the same kind over its bytes, in which a window of tokens must
begin with the left's token and end with the right's.  A sequence of BPE tokens
is the encoding of its bytes exactly if each two neighbours encode to
themselves, and all neighbours here stood next to each other in an exact
encoding; so the agreed join is exact too.

A leaf's chunks pass through the library's model once and are then kept in a
bounded cache of the worker process.

Defined cases: a null text counts as empty and has no tokens; text that spells a
special token in its own case becomes that token, as in the library; repeated rows each get a
row; ids outside the vocabulary are skipped in decoding.  Only doc_id and text
are read.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
from array import array
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from tarnwater.llm.common import batch_map, read_table

LEAF, WORD_LEAF = 2048, 1024
#: Leaves from which a thread pool encodes them, and its threads.
POOLED, THREADS = 32, 2
#: Chunks that each of a cache's two generations holds, and the characters of a chunk worth keeping.
CACHE, CACHED_CHUNK = 350_000, 48
#: Characters on which this module's normaliser and split are known to do as the library's; others go through the library's.
PLAIN = regex.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]*")

#: What cuts a normalised text at white space.
Split = Callable[[str], list[str]]
#: What a node of the tree has: chunks, and the ids of each as bytes.
Node = tuple[list[str], list[bytes]]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Codec:
    """Encodes and decodes as the library does with one tokenizer file."""

    def __init__(self, path: str, leaf: int = LEAF, word_leaf: int = WORD_LEAF):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.leaf, self.word_leaf = leaf, word_leaf
        self.ending = self.library.model
        self.middle = models.BPE(spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]])  # for what no word end follows
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.tokens = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.table = dict(enumerate(byte_characters()))
        self.marks = {c: self._word(c) for c in ".,"}
        self.older: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.specials = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        self.joins = 0  #: of encoded halves so far

    # words

    def _model_ids(self, chars: str, last: bool) -> list[int]:
        return [t.id for t in (self.ending if last else self.middle).tokenize(chars)]

    def _length(self, ids: list[int]) -> int:
        return sum([len(self.tokens[i].removesuffix("</w>")) for i in ids])

    def encode_run(self, chars: str, last: bool = True) -> list[int]:
        """Ids of a run of byte characters; ``last``: a word ends with it."""
        if len(chars) <= self.word_leaf:
            return self._model_ids(chars, last)
        half = len(chars) // 2
        left, right = self.encode_run(chars[:half], False), self.encode_run(chars[half:], last)
        n = 1
        while n < len(left) or n < len(right):
            a, b = left[-n:], right[:n]
            start, stop = half - self._length(a), half + self._length(b)
            window = self._model_ids(chars[start:stop], last and stop == len(chars))
            if (n >= len(left) or window[0] == a[0]) and (n >= len(right) or window[-1] == b[-1]):
                return left[:-n] + window + right[n:]
            n *= 2
        return self._model_ids(chars, last)

    def _word(self, word: str) -> bytes:
        """The ids of one word of the pre-tokeniser, as bytes."""
        chars = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return array("I", self.encode_run(chars)).tobytes()

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Entries of chunks that the cache lacks."""
        found: dict[str, bytes] = {}
        for chunk in chunks:
            word = chunk[:-1]
            if word.isalpha() and chunk[-1] in ".,":  # letters, then one mark: two words by the file's pattern
                ids = self.cache.get(word) or self.older.get(word) or found.get(word)
                if ids is None:
                    ids = found[word] = self._word(word)
                found[chunk] = ids + self.marks[chunk[-1]]
            elif chunk.isalpha():
                found[chunk] = self._word(chunk)
            else:
                words = self.library.pre_tokenizer.pre_tokenize_str(chunk)
                found[chunk] = array("I", [i for word, _ in words for i in self.encode_run(word)]).tobytes()
        if len(self.cache) + len(found) > CACHE:  # what was in use lately stays one round longer
            self.older, self.cache = self.cache, {}
        self.cache.update((c, e) for c, e in found.items() if len(c) <= CACHED_CHUNK)
        return found

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        got = list(map(self.cache.get, chunks))
        if None not in got:
            return got
        missing: dict[str, None] = {}
        for i, e in enumerate(got):
            if e is None:
                if (e := self.older.get(chunks[i])) is None:
                    missing[chunks[i]] = None
                else:
                    got[i] = self.cache[chunks[i]] = e
        found = self._learn(list(missing)) if missing else {}
        return [found[c] if e is None else e for e, c in zip(got, chunks, strict=True)]

    # texts

    def _leaf(self, text: str, split: Split) -> Node:
        chunks = split(text)
        return chunks, self.chunk_ids(chunks)

    def _mend(self, text: str, left: Node, right: Node, low: int, cut: int, high: int, split: Split) -> Node:
        """The node of text[low:high] from those of text[low:cut] and text[cut:high]."""
        self.joins += 1
        (a, a_ids), (b, b_ids) = left, right
        n, start, stop, i, j = 1, cut, cut, 0, 0
        while n <= len(a) or n <= len(b):
            while i < min(n, len(a)):  # between two chunks there is white space alone, so the last place is the place
                i += 1
                start = text.rfind(a[-i], low, start)
            while j < min(n, len(b)):
                stop = text.find(b[j], stop, high) + len(b[j])
                j += 1
            window, ids = self._leaf(text[start:stop], split)
            begins = i == len(a) or (window and window[0] == a[-i] and ids[0] == a_ids[-i])
            ends = j == len(b) or (window and window[-1] == b[j - 1] and ids[-1] == b_ids[j - 1])
            if begins and ends:
                return a[: len(a) - i] + window + b[j:], a_ids[: len(a) - i] + ids + b_ids[j:]
            n *= 2
        return self._leaf(text[low:high], split)

    def tree(self, text: str, split: Split) -> Node:
        """The root of a normalised text, from leaves upward."""
        cuts = [*range(0, len(text), self.leaf), len(text)]
        leaf = lambda i: self._leaf(text[cuts[i] : cuts[i + 1]], split)
        if len(cuts) > POOLED:
            with ThreadPoolExecutor(THREADS) as pool:
                level = list(pool.map(leaf, range(len(cuts) - 1)))
        else:
            level = [leaf(i) for i in range(len(cuts) - 1)]
        while len(level) > 1:
            joined = [self._mend(text, level[i], level[i + 1], cuts[i], cuts[i + 1], cuts[i + 2], split) for i in range(0, len(level) - 1, 2)]
            level = joined + level[len(level) & ~1 :]
            cuts = cuts[::2] if len(cuts) % 2 else [*cuts[::2], cuts[-1]]
        return level[0] if level else ([], [])

    def _parts(self, text: str) -> list[bytes]:
        """The ids of the text's chunks and special tokens; these are recognised in the raw text alone."""
        if "<|" in text and (found := [*self.special.finditer(text)]):
            out, at = [], 0
            for m in found:
                out += [*self._parts(text[at : m.start()]), self.specials[m[0]]]
                at = m.end()
            return out + self._parts(text[at:])
        if PLAIN.fullmatch(text):
            return self.tree(text.lower(), str.split)[1]
        return self.tree(self.library.normalizer.normalize_str(text), lambda x: [c for c in x.split(" ") if c])[1]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text.

        Nothing here makes cycles, and walks of the collector over the cache would
        cost more than the lookups, so it rests meanwhile.
        """
        resting = not gc.isenabled()
        gc.disable()
        try:
            return [np.frombuffer(b"".join(self._parts(text or "")), "<u4") for text in texts]
        finally:
            if not resting:
                gc.enable()

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """The tokens' strings with a space between them, as the file states no decoder."""
        return " ".join(filter(None, map(self.tokens.get, np.asarray(ids).tolist())))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        out = []
        for ids in self.encode_batch(texts):
            out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()))
        return out


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One codec for each worker process, which keeps its cache from task to task."""
    return Codec(path)


def encode(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep``, ids (array) and decoded text of each row: the operator's general output."""

    def make():
        coder = codec(path or vocabulary())

        def many(texts):
            return [(i.astype(np.int64).tolist(), coder.decode(i)) for i in coder.encode_batch(texts)]

        return many

    return batch_map(docs, make, "ids array<bigint>, decoded string", keep, ["text"])


def digests(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of each row."""

    def make():
        return codec(path or vocabulary()).digests

    return batch_map(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep, ["text"])


def token_rows(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep``, n_tokens, ids (as little-endian unsigned 32-bit integers) and decoded_sha256 of each row."""

    def make():
        coder = codec(path or vocabulary())

        def many(texts):
            return [(len(i), i.tobytes(), hashlib.sha256(coder.decode(i).encode()).hexdigest()) for i in coder.encode_batch(texts)]

        return many

    return batch_map(docs, make, "n_tokens bigint, ids binary, decoded_sha256 string", keep, ["text"])


def op6_bpe_tree_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op6_bpe_tree_concatenation": op6_bpe_tree_concatenation}
ORACLES: dict[str, str] = {}
