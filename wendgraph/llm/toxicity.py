"""Toxicity by non-negative positive-unlabelled learning of a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

BITS = 20
PREFIXES = (4, 5)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Which features texts have, as pairs of a text's place and a feature's name, each pair once: the words in
    lower case and, of longer ones, the first 4 and 5 bytes. Names are the top BITS bits of their hashes."""
    w = words.words(texts, "folded")
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    docs, names = [doc], [w.hash]
    for n in PREFIXES:
        at, h = words.prefixes(w, n)
        docs.append(doc[at])
        names.append(h)
    return np.concatenate(docs), (np.concatenate(names) >> np.uint64(64 - BITS)).astype(np.int64)


class Model(NamedTuple):
    weight: np.ndarray  # by name of feature; 0 for the ones that aren't used
    bias: float


def _sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int, chars: int) -> tuple[DataFrame, str, float]:
    """Bounded samples, by a hash of the id, of confirmed toxic and of unlabelled rows outside the held-out fold, as a written
    table of toxic (1 or 0) and names (int32 feature names), with its path; and the share of toxic rows among the labelled
    ones of these folds. An id with several texts has the least of them."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    learned = labels.where((shared.fold(F.col("doc_id")) != 1) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = learned.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    p = shared.hashed_sample(known.where("toxic = 1"), positives, toxic, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where((shared.fold(F.col("doc_id")) != 1) & F.col("doc_id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) <= chars))
    u = texts.select("doc_id").distinct().join(known.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("toxic"))
    u = shared.hashed_sample(u, unlabelled, u.count(), "doc_id")
    wanted = F.broadcast(p.unionByName(u))  # at most positives + unlabelled rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [np.unique(features([t])[1]).astype(np.int32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "names": names})

    rows = texts.join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    path = shared.new_path(spark, "sample")
    rows.mapInPandas(run, "toxic int, names binary").write.parquet(path)
    return spark.read.schema("toxic int, names binary").parquet(path), path, (toxic / n if n else 0.0)


def _kept(sample: DataFrame, n_p: int, n_u: int, used: int) -> np.ndarray:
    """The `used` features that tell the two samples apart best: by how many deviations their shares differ, over 2, and in three
    toxic rows at least. Counted by the tasks, so that only these come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for toxic, names in zip(batch["toxic"], batch["names"]):
                total[int(toxic), np.frombuffer(names, np.int32)] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"name": at.astype(np.int32), "p": total[1, at], "u": total[0, at]})

    counts = sample.mapInPandas(count, "name int, p long, u long").groupBy("name").agg(F.sum("p").alias("in_p"), F.sum("u").alias("in_u"))
    p, u = (F.col("in_p") + 0.5) / (n_p + 1), (F.col("in_u") + 0.5) / (n_u + 1)
    signal = (p - u) / F.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u)
    best = counts.where("in_p >= 3").select("name", signal.alias("signal")).where("signal > 2").orderBy(F.desc("signal"), "name").limit(used)
    return best.toPandas()["name"].to_numpy(np.int64)


def _rows(sample: DataFrame, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sample's labels, and which kept features (by place) its rows have, as pairs: a few numbers for each row. The order
    of rows is by content, so that every run gives the same model."""
    names = np.sort(kept)
    places = np.argsort(kept).astype(np.int32)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch["names"]:
                at = np.searchsorted(names, x := np.frombuffer(x, np.int32))
                on = at < len(names)
                on[on] = names[at[on]] == x[on]
                out.append(np.sort(places[at[on]]).tobytes())
            yield pd.DataFrame({"toxic": batch["toxic"], "on": out})

    found = sample.mapInPandas(pick, "toxic int, on binary").toPandas().sort_values(["toxic", "on"])
    on = [np.frombuffer(x, np.int32) for x in found["on"]]
    return found["toxic"].to_numpy(np.int64), np.repeat(np.arange(len(on)), [len(x) for x in on]), np.concatenate([np.zeros(0, np.int32), *on]).astype(np.int64)


def risk(w: np.ndarray, b: float, y: np.ndarray, doc: np.ndarray, col: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, float]:
    """The two parts of the PU risk, and the gradient that a step follows, by w and b: of both parts, or, if the second is
    negative, of the second with the other sign."""
    pos = y == 1
    n_p, n_u = int(pos.sum()), int((~pos).sum())
    z = b + np.bincount(doc, w[col], minlength=len(y))
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # d loss(-) / dz; d loss(+) / dz is s - 1
    minus = np.logaddexp(0, z)
    first = prior * np.logaddexp(0, -z)[pos].mean()
    gap = minus[~pos].mean() - prior * minus[pos].mean()
    d = np.where(pos, prior * (s - 1) / n_p, 0.0)
    other = np.where(pos, -prior * s / n_p, s / n_u)
    d = d + other if gap >= 0 else -other
    return first, gap, np.bincount(col, d[doc], minlength=len(w)), d.sum()


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 12000, used: int = 1024, steps: int = 300, rate: float = 0.1, decay: float = 1e-4, chars: int = 20_000) -> Model:
    """A linear classifier of the presence of words that minimises the non-negative PU risk

        prior * mean_P loss(+) + max(0, mean_U loss(-) - prior * mean_P loss(-)),

    with the logistic loss and the class prior taken from the labelled rows of the learned folds. When the
    second part falls below zero, its gradient is taken with the other sign, as the method has it. The `used`
    features that tell the two samples apart best are kept. The samples' bounds are the parameters `positives`,
    `unlabelled` and `chars`, the longest text that is learned from; scoring covers every row and the whole of it.
    Without any confirmed toxic row, as in an empty table, the model scores everything 0.
    """
    sample, path, prior = _sample(docs, labels, positives, unlabelled, chars)
    weight = np.zeros(1 << BITS, np.float32)
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = size.get(1, 0), size.get(0, 0)
    if n_p == 0 or n_u == 0 or prior <= 0:
        return Model(weight, -20.0 if n_p == 0 else float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    prior = min(prior, 0.95)
    kept = _kept(sample, n_p, n_u, used)
    y, doc, col = _rows(sample, kept)
    shared.drop(docs.sparkSession, path)
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, steps + 1):
        _, _, by_w, by_b = risk(w, b, y, doc, col, prior)
        g = np.append(by_w + decay * w, by_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weight[kept] = w
    return Model(weight, float(b))


def _dense(names: np.ndarray, values: np.ndarray) -> np.ndarray:
    weight = np.zeros(1 << BITS)
    weight[names] = values
    return weight


def _scores(texts: list[str | None], weight: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(texts), bias)
    for a, b in words.blocks([len(t or "") for t in texts]):
        doc, name = features(texts[a:b])
        on = np.flatnonzero(weight[name])
        pair = np.unique(doc[on] << BITS | name[on])
        total[a:b] += np.bincount(pair >> BITS, weight[pair & ((1 << BITS) - 1)], minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: the whole text is scored, and nothing but the text. A null
    or empty text has the score of the bias alone. Repeated rows each get their row."""
    shared.small_batches(docs.sparkSession)
    kept = np.flatnonzero(model.weight)
    sent = (kept.astype(np.int32), model.weight[kept], model.bias)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = _dense(*sent[:2])
        for batch in batches:
            out = _scores(batch["text"].tolist(), weight, sent[2])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": out, "predicted": (out >= threshold).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (shared.fold(F.col("doc_id")) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of documents whose score is below the threshold, all columns kept; null and empty texts are judged by the
    bias alone, as in `score`."""
    shared.small_batches(docs.sparkSession)
    kept = np.flatnonzero(model.weight)
    sent = (kept.astype(np.int32), model.weight[kept], model.bias)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = _dense(*sent[:2])
        for batch in batches:
            yield pd.Series(_scores(batch.tolist(), weight, sent[2]) < threshold)
        shared.release()

    return docs.where(F.pandas_udf(run, "boolean")(F.col("text").cast("string")))
