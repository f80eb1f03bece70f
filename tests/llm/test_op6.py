import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gavelflow.llm import bpe
from gavelflow.llm.bpe import Encoder, decode, encode, op6_byte_bpe, rank_path, read_ranks


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(rank_path()), special_tokens={})


def texts():
    r = random.Random(4)
    yield from ["", " ", "  ", "a", "hello world", "it's we'll 'S don't", " lead", "trail ", "a  b   c\n\n d\t e ", "\n", "x  y  z", "\x1c a \x1d", "<|endoftext|> a", "日本語 テスト 123 ４５", "🙂🙂 é ß"]
    yield "a" * 5000
    yield "ab " * 2000 + "é" * 700 + " \n" * 300
    yield "".join(chr(r.randrange(33, 0x250)) for _ in range(4000))
    for _ in range(200):
        alphabet = r.choice(["ab ", "abc  \n", "thein er's12 ,.", "éàß 　x", "the of and ing 's  \t\n!?#"])
        yield "".join(r.choice(alphabet) for _ in range(r.randint(0, 200)))


def test_matches_the_library(reference, monkeypatch):
    want = [reference.encode_ordinary(t) for t in texts()]
    for cache in (200_000, 3):
        monkeypatch.setattr(bpe, "CACHE", cache)
        enc = Encoder(read_ranks(rank_path()), public_tokenizers.PATTERN)
        for _ in range(2):
            got = [np.frombuffer(x, dtype="<u4").tolist() for x in enc.encode_texts(list(texts()))]
            assert got == want
    assert [enc.decode(x).decode() for x in enc.encode_texts(list(texts()))] == list(texts())


def test_query_and_round_trip(spark, make_docs, reference):
    rows = [*enumerate(texts()), (900, None), (None, "no id"), (3, "same id"), (3, "same id")]
    folder = make_docs([(d, t, "en", "s") for d, t in rows])
    want = []
    for d, t in rows:
        ids = reference.encode_ordinary(t or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted([tuple(x) for x in op6_byte_bpe(spark, folder).collect()], key=str) == sorted(want, key=str)
    back = decode(encode(spark.read.parquet(f"{folder}/documents.parquet"))).collect()
    assert sorted([tuple(x) for x in back], key=str) == sorted([(d, t or "") for d, t in rows], key=str)


def test_empty_table(spark, make_docs):
    assert op6_byte_bpe(spark, make_docs([])).collect() == []
