"""Non-negative PU learning: the risk's gradient, the bounds of the samples, and the same model in every run."""

import random

import numpy as np
import pytest

from wendgraph.llm import toxicity, words


def brute_risk(w, b, rows, prior):
    """The two parts of the risk, row by row."""
    loss = lambda z: np.log1p(np.exp(-z))
    z = [(y, b + sum(w[c] for c in on)) for y, on in rows]
    p, u = [v for y, v in z if y], [v for y, v in z if not y]
    return prior * np.mean([loss(v) for v in p]), np.mean([loss(-v) for v in u]) - prior * np.mean([loss(-v) for v in p])


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_gradient_is_that_of_the_risk(shift):
    """By finite differences: of both parts where the second isn't negative, else of the second with the other sign."""
    rng = random.Random(1)
    rows = [(int(i < 6), sorted(rng.sample(range(5), rng.randrange(0, 5)))) for i in range(20)]
    y, doc, col = np.array([r[0] for r in rows]), np.repeat(np.arange(20), [len(r[1]) for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.int64)
    w, b = np.array([0.3, -0.2, 0.5, 0.1, -0.4]) + np.array([0, 0, 0, 0, 0.0]), -0.3
    if shift:  # unlabelled rows look clean, confirmed ones toxic: the second part is negative
        rows = [(t, [4] if t else []) for t, _ in rows]
        y, doc, col = np.array([r[0] for r in rows]), np.flatnonzero([len(r[1]) for r in rows]), np.full(6, 4)
        w, b = np.array([0, 0, 0, 0, 9.0]), -shift
    first, gap, by_w, by_b = toxicity.risk(w, b, y, doc, col, 0.4)
    assert np.allclose((first, gap), brute_risk(w, b, rows, 0.4)) and (gap < 0) == bool(shift)
    value = lambda v: (lambda r: r[0] + r[1] if not shift else -r[1])(brute_risk(v[:-1], v[-1], rows, 0.4))
    v = np.append(w, b)
    for i in range(6):
        e = np.eye(6)[i] * 1e-6
        assert abs((value(v + e) - value(v - e)) / 2e-6 - np.append(by_w, by_b)[i]) < 1e-6


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        t = rng.choices(vocabulary, k=40) + (rng.choices(["vileword", "awfulthing", "nastyone"], k=3) if toxic else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        if i % 2 == 0:
            labels.append((i, 0, int(toxic)))
    rows += [(i, "vileword " * 30_000) for i in (10_000, 10_001)] + [(0, rows[0][1]), (0, "another text")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(10_000, 0, 1), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int"), rows


def test_the_same_model_twice_and_held_out_rows(spark, tables):
    docs, labels, rows = tables
    one, two = toxicity.train(docs, labels), toxicity.train(docs.repartition(7), labels.repartition(3))
    assert (one.weight == two.weight).all() and one.bias == two.bias and 0 < (one.weight != 0).sum() <= 1024
    found = {r["doc_id"]: r for r in toxicity.score(docs, one).where("held_out").collect()}
    right = [(r["predicted"] == 1) == (i % 5 == 0) for i, r in found.items() if i < 900]
    assert len(right) > 250 and sum(right) >= 0.95 * len(right)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in found.values())


def test_learned_rows_are_those_of_the_bounds(spark, tables):
    docs, labels, rows = tables
    sample, _, prior = toxicity._sample(docs, labels, 40, 100, 20_000)
    got = sample.collect()
    assert sum(r["toxic"] for r in got) <= 40 and sum(not r["toxic"] for r in got) <= 100 and len(got) > 100
    assert max(len(r["names"]) for r in got) < 4 * 400
    texts = {np.unique(toxicity.features([t])[1]).astype(np.int32).tobytes() for _, t in rows}
    assert {bytes(r["names"]) for r in got} <= texts and 0.1 < prior < 0.4
    kept = toxicity._kept(sample, 40, 100, 3)
    assert len(kept) == 3 or len(kept) == len(set(kept.tolist()))
    vile = {int(words.words([x], "folded").hash[0] >> np.uint64(64 - toxicity.BITS)) for x in ("vileword", "awfulthing", "nastyone")}
    assert vile & set(toxicity._kept(sample, 40, 100, 1024).tolist())


def test_scores_of_odd_texts(spark, tables):
    docs, labels, _ = tables
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "?!", 3), (None, "vileword", 4), (4, "vileword " * 100_000, 5), (4, "vileword", 6)], "doc_id long, text string, score long")
    got = toxicity.score(odd, model).collect()
    bias = 1 / (1 + np.exp(-model.bias))
    assert len(got) == 6 and all(abs(r["score"] - bias) < 1e-9 for r in got[:3]) and abs(got[4]["score"] - got[5]["score"]) < 1e-12
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3} <= {r["doc_id"] for r in kept.collect()}
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0 and toxicity.keep_clean(docs.limit(0), none).count() == 0
