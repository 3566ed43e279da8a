"""Greedy string tiling against its definition, and decontamination by blocks against it."""

import random
import re

import numpy as np
import pytest

from wendgraph.llm import decontamination

DOCS = "doc_id long, text string, item_id long, coverage string, block string"


def naive(a, b, least):
    """Marks the longest run of unmarked words that both have, of equals the first in a, then in b, until none has `least`."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        i, j, k = best
        free_a[i : i + k] = free_b[j : j + k] = [False] * k
        out.append(best)


def test_tiles_are_those_of_the_definition():
    rng = np.random.default_rng(1)
    for n in range(400):
        a, b = (rng.integers(0, 2 + n % 3, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        least = 2 + n % 4
        assert sorted(decontamination.tiles(a, b, least)) == sorted(naive(a.tolist(), b.tolist(), least))


@pytest.mark.parametrize("block", [8_000_000, 120])
def test_matches_and_clean_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", block)
    rng = random.Random(2)
    prose = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(i, prose(rng.randrange(1, 30))) for i in range(12)] + [(3, prose(9)), (None, prose(12)), (20, []), (21, None)]
    rows = []
    for d in range(60):
        t = prose(rng.randrange(0, 40))
        for _, w in rng.sample(items[:14], rng.randrange(0, 3)):
            cut = rng.randrange(len(w) + 1)
            t += w[cut:] + ["zz"] * rng.randrange(2) + w[:cut] + prose(3)
        rows.append((d if d % 9 else None, " ".join(t)))
    rows += [(100, None), (101, ""), (102, "?! ..."), (103, " ".join(prose(20_000)) + " " + " ".join(items[5][1])), rows[1], rows[1]]
    bench = spark.createDataFrame([(i, None if w is None else " ".join(w).upper() + ".", "x") for i, w in items], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(d, t, 1, "c", "b") for d, t in rows], DOCS)
    want, dirty = [], []
    for d, t in rows:
        words = re.findall(r"\w+", (t or "").lower())
        hit = False
        for i, w in items:
            if w and len(words) < 1000:
                done = naive(w, words, min(5, len(w)))
                shares = any(w[x : x + min(5, len(w))] == words[y : y + min(5, len(w))] for x in range(len(w)) for y in range(len(words) - min(5, len(w)) + 1))
                if shares and 2 * sum(k for *_, k in done) >= len(w):
                    want.append((d, i, len(w), sum(k for *_, k in done), len(done)))
                    hit = True
        dirty.append(hit)
    got = [tuple(r)[:5] for r in decontamination.matches(df, bench).collect()]
    assert sorted((r for r in got if r[0] != 103), key=str) == sorted(want, key=str)
    assert any(r[:2] == (103, 5) for r in got)
    left = [tuple(r) for r in decontamination.clean(df, bench).collect()]
    assert sorted(map(str, left)) == sorted(str((d, t, 1, "c", "b")) for (d, t), x in zip(rows, dirty) if not x and d != 103)
    empty = bench.limit(0)
    assert decontamination.matches(df, empty).count() == 0 and decontamination.clean(df, empty).count() == len(rows) and decontamination.matches(df.limit(0), bench).count() == 0
