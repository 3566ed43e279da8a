"""Rank-order profiles against plain Python."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from wendgraph.llm import language

TOP = 300


def grams(text):
    """n-grams of letters, runs of anything else being one blank: none with a blank inside, or of a blank alone."""
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    t = " " + " ".join(t.split()) + " " if t.split() else " "
    found = [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    return [g for g in found if g.strip() and " " not in g[1:-1] and g != " "]


def ranked(counts):
    order = sorted(counts, key=lambda g: (-counts[g], len(g), [0 if c == " " else ord(c) for c in g]))
    return order[:TOP]


def predictions(rows):
    total = {}
    for d, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str("" if d is None else d).encode()) % 3 != 1:
            total.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in sorted(total.items())}
    for d, text, _ in rows:
        own = ranked(Counter(grams(text))) if text else []
        if not own or not profiles:
            yield d, "und", 0.0
            continue
        far = {lang: sum(min(TOP, abs(p[g] - i)) if g in p else TOP for i, g in enumerate(own)) for lang, p in profiles.items()}
        near = {lang: 1 - f / (TOP * len(own)) for lang, f in far.items()}
        best = min(far, key=far.get)
        yield d, best, near[best] / sum(near.values()) if sum(near.values()) else 0.0


def test_predictions_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", "en"), (9003, "12 !?", "fr"), (9004, "x", None), (None, "the of and", "de"), (9005, "a b " * 60_000, "en"), (9006, "éÉ ß Ａ 漢字 \U0001d400", "es"), (9006, "éÉ ß Ａ 漢字 \U0001d400", "es")], "doc_id long, text string, lang string")
    df = docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("gram", F.lit(1)).withColumn("rank", F.lit("x")).repartition(5)
    rows = [tuple(r)[:3] for r in df.collect()]
    want = sorted(((d, zlib.crc32(str("" if d is None else d).encode()) % 3 == 1, lang, round(s, 9)) for d, lang, s in predictions(rows)), key=str)
    got = language.identify(df).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in got), key=str) == want
    assert language.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
