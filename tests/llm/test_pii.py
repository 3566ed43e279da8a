"""Personal data: the field end to end on real texts, blocks, redaction."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wendgraph.llm import pii
from wendgraph.llm.pii import BASE, KINDS, LABELS

SECRET = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def field(docs):
    return pii.train(docs)


def marginals(field, feature, chain, skip, fixed):
    """By adding up all labellings."""
    k, n = len(LABELS), len(feature)
    unary, total = feature @ field.node, np.zeros((n, k))
    for code in range(k**n):
        y = [code // k**i % k for i in range(n)]
        if any(f >= 0 and f != v for f, v in zip(fixed, y)):
            continue
        p = np.exp(sum(unary[i, v] for i, v in enumerate(y)) + sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.tied[y[a], y[b]] for a, b in skip))
        for i, v in enumerate(y):
            total[i, v] += p
    return total / total.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_on_trees_and_near_on_loops():
    rng, k = np.random.default_rng(1), len(LABELS)
    tied = rng.normal(size=(k, k)) * 0.6
    field = pii.Field(rng.normal(size=(pii.FEATURES, k)) * 0.3, rng.normal(size=(k, k)) * 0.6, tied + tied.T)
    f = rng.normal(size=(4, pii.FEATURES))
    chain, fixed = np.array([[0, 1], [1, 2]]), np.array([-1, -1, 3, -1])
    got = pii.infer(field, f, chain, np.array([[3, 1]]), fixed, rounds=80)
    assert np.allclose(got, marginals(field, f, chain, [[3, 1]], fixed), atol=1e-6)
    loop = pii.infer(field, f, pii._next(4), np.array([[3, 0]]), fixed, rounds=80)
    assert np.abs(loop - marginals(field, f, pii._next(4), [[3, 0]], fixed)).max() < 0.1


def test_a_span_that_only_a_tie_finds(spark):
    """Two numbers run together in a document of sf0.1, so that the base pattern rejects them; one is a card elsewhere in it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field = pii.train(docs)
    untied = pii.Field(field.node, field.chain, np.zeros_like(field.tied))
    text = docs.where(F.contains("text", F.lit("7536784127813050 4845168114407329"))).first()["text"]
    ((base, added),), ((same, without),) = pii.detect([text], field), pii.detect([text], untied)
    assert base == same and set(map(tuple, added)) - set(map(tuple, without)) and {k for k, *_ in added} == {"card"}


def test_secrets_without_digits(field):
    text = f'the password = "correcthorsebatterystaple" was used; api_key: {SECRET} and then correcthorsebatterystaple again, as the key thing'
    values = [t for t in pii.tokens(text).text]
    assert values.count("correcthorsebatterystaple") == 2 and "thing" not in values
    ((_, added),) = pii.detect([text], field)
    assert ("secret", text.index(SECRET), text.index(SECRET) + 40) in [tuple(x) for x in added]
    a = text.index("correct")
    assert ("secret", a, a + 25) in [tuple(x) for x in added]


def test_spans_do_not_depend_on_blocks(field, docs):
    texts = [r["text"] or "" for r in docs.select("text").limit(300).collect()]
    texts.insert(7, " ".join(f"{i} a{i}@b.example" for i in range(60_000)))
    together = pii.detect(texts, field)
    assert together == [x for t in texts for x in pii.detect([t], field)] and len(together[7][0]) == 60_000


def test_query_end_to_end(spark, field):
    texts = [None, "", "mail a@b.co and +49 (30) 1234-5678", f"token = \"{SECRET}\" " * 2, "10.0.0.256 10.0.0.1", "4111 1111 1111 1111"]
    df = spark.createDataFrame([*enumerate(texts), (2, texts[2]), (None, texts[4])], "doc_id long, text string").withColumn("spans", F.lit(1))
    rows = pii.find(df, field).collect()
    assert len(rows) == 8
    for r in rows:
        text = texts[4] if r["doc_id"] is None else texts[r["doc_id"]] or ""
        base = pii.base_spans(text)
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in base) for k in BASE]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert set(base) <= set(spans) and len(spans) == len(base) + r["n_added"] and spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    assert {r["doc_id"]: r["n_email"] for r in rows}[2] == 1
    assert pii.find(df.limit(0)).count() == 0


def test_redacted_texts(spark, field):
    texts = {1: "write to a@b.co or 10.0.0.1.", 2: None, 3: "", 4: "é 4111 1111 1111 1111 é", 5: "no data"}
    df = spark.createDataFrame([(i, t, "s", 99) for i, t in texts.items()], "doc_id long, text string, source string, n_chars int")
    got = {r["doc_id"]: r for r in pii.redact(df, field).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "write to [EMAIL] or [IP].", 2: None, 3: "", 4: "é [CARD] é", 5: "no data"}
    assert [got[i]["n_chars"] for i in (1, 2, 3, 4)] == [25, 99, 0, 10] and pii.redact(df, field).schema == df.schema
    overlapping = "+4111111111111111"  # no phone (16 digits), but a card; with an address over it
    ((base, _),) = pii.detect([overlapping + "@b.example"], field)
    assert len(base) >= 2
    one = spark.createDataFrame([(1, "x " + overlapping + "@b.example y")], "doc_id long, text string")
    assert pii.redact(one, field).first()["text"] == "x [EMAIL] y"
