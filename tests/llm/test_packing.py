"""Packing: ids of the untouched tokenizer, every document rebuilt from its pieces, little padding."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wendgraph.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_of_random_texts(tokenizer):
    import public_tokenizers

    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "漢", "1", "23", "'s", "<|endoftext|>", "<|", "|>", ".", "!?", "\u00a0", "\U0001f600", "x" * 70, "Don't"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(3000)]
    own = packing.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), most=500)
    for a in range(0, len(texts), 1000):
        got = [np.frombuffer(x, np.uint32).tolist() for x in own(texts[a : a + 1000])]
        assert got == [e.ids for e in tokenizer.encode_batch(texts[a : a + 1000], add_special_tokens=False)]


def test_documents_are_rebuilt_from_their_pieces(spark, tokenizer):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["one", "two", "three", "ünf", "six,", "seven."]) for _ in range(n))
    texts = {i: prose(rng.choice([0, 1, 5, 50, 400, 2047, 5000])) for i in range(300)} | {1000: None, 1001: "", 1002: "a <|endoftext|> b", 1003: prose(150_000)}
    df = spark.createDataFrame([*texts.items(), (None, "no id")], "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("length", F.lit("x")).repartition(3)
    got = packing.pack(df).toPandas()
    assert not got.isna().drop(columns="doc_id").any().any()
    for d, g in got[got.doc_id.notna()].groupby("doc_id"):
        own = np.array([*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 1], np.uint32)
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(own) and (g.doc_tokens == len(own)).all()
        assert [zlib.crc32(own[a : a + n].astype("<u4").tobytes()) for a, n in zip(g.start, g.length)] == g.ids_crc32.tolist()
    assert set(got.doc_id.dropna()) == set(texts) and got.doc_id.isna().sum() == 1
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and fill.sum() / (2048 * len(fill)) > 0.98
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert sorted(map(tuple, packing.pack(df).select("doc_id", "start", "length", "ids_crc32").toPandas().fillna(-1).values.tolist())) == sorted(map(tuple, got[["doc_id", "start", "length", "ids_crc32"]].fillna(-1).values.tolist()))
