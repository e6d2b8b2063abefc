import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tarnwater.llm import bpe as m

LIBRARY = Tokenizer.from_file(m.vocabulary())
ODD = ["", " ", "a", "It's  they're we'LL", "--'s ''re '", "<|endoftext|>x <|startoftext|><|endoftext|> y<|", "ΑΣ İstanbul ẞ ǅ ȩ́ café", "漢字かな 🙂🙂 ½ Ⅷ x‍y", "\x1c\x1d\x85\xa0　a b", "a" * 5000, "tab\tnew\n\nline\x0b\x0c", "123 4,5 $%^&*((", "''''''s" * 300, "<|ENDOFTEXT|>", "a <|EndOfText|> <|endoftext|> <|StartOfText|> b", "<|endoftext|><|ENDOFTEXT|>"]


def random_text(r, n):
    alphabet = "abcdefgh'''  \n.,-12éßñ" if r.random() < 0.7 else "abΣİ漢́🙂' sre\x85"
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("leaf,word_leaf", [(3, 4), (16, 8), (m.LEAF, m.WORD_LEAF)])
def test_like_the_library(leaf, word_leaf):
    codec = m.Codec(m.vocabulary(), leaf, word_leaf)
    r = random.Random(leaf)
    texts = ODD + [random_text(r, r.randint(0, 400)) for _ in range(150)] + ["".join(r.choice("abcdehilnorst") for _ in range(3000)) for _ in range(3)]
    for text in texts:
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == want, text[:80]
        assert codec.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)
        ids = hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert codec.digests([text])[0] == (len(want), ids, hashlib.sha256(codec.decode(want).encode()).hexdigest())


def test_ordinary_long_texts_are_joined_from_tokens():
    r = random.Random(9)
    text = " ".join("".join(r.choice("abcdehilnorst") for _ in range(r.randint(2, 9))) for _ in range(3000))
    codec = m.Codec(m.vocabulary())
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert codec.encode(text).tolist() == want and codec.joins == len(text) // m.LEAF
    seen = []
    codec.chunk_ids, plain = (lambda chunks: seen.append(len(chunks)) or plain(chunks)), codec.chunk_ids
    assert codec.encode(text).tolist() == want
    leaves = len(text) // m.LEAF + 1
    assert len(seen) >= 2 * leaves - 1 and max(seen) < 1000  # leaves, and a small window for each join


def test_query(spark, table):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, None, None), (0, "", "en"), (99, "long words " * 20_000, "en")]
    folder = table("documents", spark.createDataFrame(rows, "doc_id bigint, text string, ids string"))
    got = m.op6_bpe_tree_concatenation(spark, folder).collect()
    codec = m.Codec(m.vocabulary())
    assert sorted((x.doc_id or -1, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == sorted((i if i else -1, *codec.digests([t])[0]) for i, t, _ in rows)
    full = m.encode(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"]).where("doc_id = 3").first()
    assert full.ids == LIBRARY.encode(ODD[3], add_special_tokens=False).ids
    empty = table("documents", spark.createDataFrame([], "doc_id bigint, text string"))
    assert m.op6_bpe_tree_concatenation(spark, empty).count() == 0
