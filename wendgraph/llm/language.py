"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, words

LONGEST = 3
_BASE = 0x110000  # code points; an n-gram's name is its code points as digits, after the names of all shorter ones
_FROM = [0, 0, _BASE, _BASE + _BASE**2]
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """Names of all n-grams, n from 1 to LONGEST, of the letters of the text in lower case. Runs of other
    characters count as one boundary (0); n-grams with a boundary inside, or of it alone, are left out."""
    c = _letters()[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])].astype(np.int64)
    on = c > 0
    two = c[:-1] * _BASE + c[1:]
    three = two[:-1] * _BASE + c[2:]
    return np.concatenate([c[on], two[on[:-1] | on[1:]] + _FROM[2], three[on[1:-1]] + _FROM[3]])


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams, in order of name, and how often each occurs."""
    s = np.sort(grams)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[at], np.diff(np.append(at, len(s)))


def ranked(grams: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by name."""
    names, count = counted(grams)
    if len(names) > top:
        least = np.partition(count, len(count) - top)[len(count) - top]
        names, count = names[count >= least], count[count >= least]
    return names[np.argsort(-count, kind="stable")[:top]]


def learn(docs: DataFrame, top: int = 300) -> dict[str, np.ndarray]:
    """The `top` most frequent n-grams of each language, over all rows whose fold isn't held out and that have
    a text and a lang. What comes to the driver is `top` numbers a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                texts = rows["text"].tolist()
                for a, b in words.blocks([len(t) for t in texts]):
                    found = counted(np.concatenate([ngrams(t) for t in texts[a:b]]))
                    total.setdefault(lang, []).append(found)
                    held += len(found[0])
            if held > 1 << 21:
                total = {lang: [_added(found)] for lang, found in total.items()}
                held = sum(len(found[0][0]) for found in total.values())
                if held > 1 << 20:
                    yield from _frames(total)
                    total, held = {}, 0
        yield from _frames(total)

    used = docs.where((shared.fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = used.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInPandas(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "gram", "rank").toPandas()
    return {lang: r.sort_values("rank")["gram"].to_numpy() for lang, r in sorted(rows.groupby("lang"))}


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return names, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def _frames(total: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pd.DataFrame]:
    for lang, found in total.items():
        names, n = _added(found)
        yield pd.DataFrame({"lang": lang, "gram": names, "n": n})


def identify(docs: DataFrame, top: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language whose profile is nearest by out-of-place distance.

    The distance adds up, over the text's `top` most frequent n-grams, how far each one's rank is from its rank
    in the profile, `top` where it has none. The score is the nearest language's share of all languages'
    closeness (one less the distance over the greatest possible): 1 if nothing else is near, 0 for "und".
    Ties go to the language first in order. A null text, one without letters, and any text if nothing was
    learned give "und". Only the text is looked at; repeated rows each get their row; an empty table gives none.
    """
    shared.small_batches(docs.sparkSession)
    profiles = learn(docs, top)
    names = list(profiles)
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
    ranks = np.full((len(names), len(used) + 1), -1, np.int64)  # the last column is that of all other n-grams
    for i, grams in enumerate(profiles.values()):
        ranks[i, np.searchsorted(used, grams)] = np.arange(len(grams))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                grams = ranked(ngrams(text), top) if text and names else ()
                if len(grams) == 0:
                    out.append(("und", 0.0))
                    continue
                at = np.searchsorted(used, grams)
                at[at < len(used)] = np.where(used[at[at < len(used)]] == grams[at < len(used)], at[at < len(used)], len(used))
                r = ranks[:, at]
                far = np.where(r < 0, top, np.minimum(top, np.abs(r - np.arange(len(grams))))).sum(axis=1)
                near = 1 - far / (top * len(grams))
                best = int(np.argmin(far))
                out.append((names[best], float(near[best] / near.sum()) if near.sum() > 0 else 0.0))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [x for x, _ in out], "score": [x for _, x in out]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (shared.fold(F.col("doc_id")) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(predict, SCHEMA)
