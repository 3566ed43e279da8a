"""Near duplicates: measured recall of links, dense groups, and what is written for them."""

import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

from wendgraph.llm import neardup

SCHEMA = "doc_id long, text string"


def pair(rng, common, one, two):
    x = rng.integers(0, 2**63, common + one + two, dtype=np.uint64)
    a, b = np.concatenate([x[:common], x[common : common + one]]), np.concatenate([x[:common], x[common + one :]])
    return neardup.signature(np.sort(a)), neardup.signature(np.sort(b))


def frame(spark, signatures):
    s = np.stack(signatures).view(np.int64)
    return spark.createDataFrame(pd.DataFrame({"rep": np.arange(len(s))} | {f"s{i}": s[:, i] for i in range(4)}))


@pytest.mark.parametrize("common,one,two,least", [(178, 22, 22, 0.98), (889, 111, 111, 0.98), (40, 5, 5, 0.97), (12, 0, 3, 0.97), (4, 0, 1, 0.94), (184, 16, 16, 0.99), (189, 11, 10, 0.995)])
def test_recall_of_links(spark, common, one, two, least):
    """Of 600 pairs at similarities of 0.8 (the first five), 0.85 and 0.9, which share the tables find: in buckets of usual
    size, and when buckets of over 16 times `most` are cut."""
    rng = np.random.default_rng(common)
    nodes = frame(spark, [s for _ in range(600) for s in pair(rng, common, one, two)])
    for most in (4096, 2):
        got = {(r["a"], r["b"]) for r in neardup.candidates(nodes, 80, 14 if most > 2 else 5, most, 64).collect()}
        assert sum((2 * i, 2 * i + 1) in got for i in range(600)) >= 600 * least, most


def test_what_is_written_grows_with_the_nodes(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, neardup.BITS, np.uint8)
    bits = np.repeat(base[None], 3000, axis=0)
    for row in bits:
        row[rng.choice(neardup.BITS, 3, replace=False)] ^= 1
    found = neardup.compared(frame(spark, np.packbits(bits, axis=1, bitorder="little").view(np.uint64)), 80, 14, 4096, 64)
    pairs = neardup._pairs(found)
    assert pairs.count() <= 80 * 3000 and found.count() <= 2 * 80 * 3000  # of 4.5 million pairs
    assert pairs.select("b").distinct().count() >= 2990


def test_a_part_of_many_equals_in_a_gigabyte():
    run = """
import resource, numpy as np
from wendgraph.llm import neardup
rng = np.random.default_rng(4)
s = np.repeat(rng.integers(0, 2**63, (1, 4), dtype=np.uint64), 20000, axis=0)
s[:, 0] ^= np.arange(20000, dtype=np.uint64)
rows = sum(len(x) for x in neardup._one_part(np.arange(20000), s, None, 64))
assert rows == 19999 + 20000, rows
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20
"""
    subprocess.run([sys.executable, "-c", run], check=True)


def classes(rows):
    """Brute force: least id of the connected rows, and the sets."""
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for _, t in rows for w in [t.split()]]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                parent[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def test_dense_blobs_that_are_not_one_class(spark):
    """Variants of one text whose signatures are all near, while only some of them are linked; with one id that has two texts."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(42)]
    rows = []
    for i in range(120):
        t = list(base)
        for p in sorted(rng.sample(range(42), 1 + i % 2)):
            t[p] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(7, " ".join(f"v{k}" for k in range(50))), (200, " ".join(f"v{k}" for k in range(51)))]
    want = classes(rows)
    assert len(set(want.values())) > 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = neardup.compared(neardup_nodes(spark, rows), 80, 14, 4096, 64)
    assert found.where("far < 0").count() > 0
    for most in (4096, 16):
        got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df, most=most).collect()}
        assert got == want


def neardup_nodes(spark, rows):
    from wendgraph.llm import words

    sig = []
    for _, t in rows:
        w = words.words([t], "folded")
        sig.append(neardup.signature(words.shingles(w, 0, 5, words.grams(w.hash, 5))))
    return frame(spark, sig)


def test_sets_checked_together_give_the_links_between_groups():
    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(20, 30))), np.uint64) for _ in range(40)]
    sets += [np.append(s[:-1], np.uint64(1000 + i)) for i, s in enumerate(sets[:15])]
    group = list(range(55))
    group[20:24] = [20] * 4
    got = neardup._linked(pd.DataFrame({"rep": range(55), "group": group, "shingles": [s.tobytes() for s in sets]}), 0.8, columns=7)
    parent = list(group)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = lambda i, j: (n := len(set(sets[i].tolist()) & set(sets[j].tolist()))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)
    assert all(linked(a, b) for a, b in got.itertuples(index=False)) and len(got) >= 15
    for a, b in got.itertuples(index=False):
        parent[root(a)] = root(b)
    assert all(root(i) == root(j) for i in range(55) for j in range(i) if linked(i, j))


def test_salted_joins_keep_every_row(spark):
    from wendgraph.llm import shared

    left = spark.createDataFrame([(1, i) for i in range(300)] + [(2, i) for i in range(3)] + [(3, 0)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, w string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, shared.joined(left, right, "k", how, most=16).select("k", "v", "w").collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=str)
