"""Token ids against a tokenizer of one's own, as the library reads it from the file."""

import random
import struct
import zlib

import pyarrow as pa
import pytest

from weft.llm import textops as tx
from weft.llm.tokenstore import Encoder, store_tokens


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain(vocabulary):
    from tokenizers import Tokenizer

    return lambda text, tok=Tokenizer.from_file(vocabulary): tok.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_texts(vocabulary, plain):
    rng = random.Random(4)
    parts = ["a", " ", "\n", "é", "漢", "<|endoftext|>", "<|endof", "text|>", "<|", " word", "Zé", ".", "ab", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["", "<|endof", "text|>", "a <|endoftext|> b", "<|endoftext|>"]  # the token across two texts is none
    assert plain("a <|endoftext|> b") == [64, 220, 50256, 275]
    e, n = Encoder(vocabulary), 0
    assert e.cuts
    for i, j, buf, off in tx.chunks(pa.array(texts), 1 << 10):
        ids, bounds = e.encode(buf, off)
        assert len(bounds) == j - i + 1
        for k in range(j - i):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain(texts[i + k]), texts[i + k]
            n += 1
    assert n == len(texts)


def test_store_holds_added_tokens(spark, vocabulary, plain):
    rows = [(1, "first text"), (2, "a <|endoftext|> b"), (3, "last text")]
    want, at = [], 0
    for i, text in rows:
        ids = [*plain(text), 2]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = store_tokens(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == want


def test_very_long_texts(spark, vocabulary, plain):
    """A text of several megabytes, alone and beside others, and one that holds an added token."""
    words = " ".join(f"word{i % 5000} é{i % 7}," for i in range(150_000))
    rows = [(1, words), (2, "x"), (3, words[:400_000] + "<|endoftext|>" + words[:100]), (4, "a" * 200_000)]
    want = {k: len(plain(t)) + 1 for k, t in rows}
    got = {r.doc_id: r.n_tokens for r in store_tokens(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary).collect()}
    assert got == want
