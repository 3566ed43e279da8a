"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import functools
import heapq
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

SCHEMA = "doc_id long, item_id long, item_words long, covered_words long, tiles long, coverage double"
#: Characters of benchmark text held at once by a worker; of a larger benchmark, each block goes over the documents by itself.
BLOCK_CHARS = 8_000_000


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of item a against text b, both as word hashes: (start in a, start in b, length).

    The search length s starts at half the longest there can be. Running Karp-Rabin hashes of all unmarked runs of s
    words find the matches, which are compared word by word and extended over unmarked words. Matches of twice
    s or more restart the search at their length; else the longest is marked, of equals the first in a, then in b, what
    others have left of their words is put in its place by length, and so on; then s is halved, down to `least`. So
    each tile is the longest there is when it is marked, tiles never overlap, and reordered passages are covered
    piece by piece.
    """
    n, m = len(a), len(b)
    free_a, free_b = np.ones(n, bool), np.ones(m, bool)
    out: list[tuple[int, int, int]] = []
    roll_a, roll_b = words.rolling(a), words.rolling(b)
    s = max(least, min(n, m) // 2)
    while n >= least <= m:
        starts: dict[int, list[int]] = defaultdict(list)
        in_a, in_b = roll_a(s), roll_b(s)
        for i in np.flatnonzero(_all_free(free_a, s)).tolist():
            starts[int(in_a[i])].append(i)
        found = []
        if starts:
            hit = np.flatnonzero(_all_free(free_b, s) & np.isin(in_b, np.fromiter(starts, np.uint64, len(starts))))
            covered: dict[int, int] = {}  # by diagonal, how far its last match reaches
            for j in hit.tolist():
                for i in starts[int(in_b[j])]:
                    if covered.get(j - i, -1) >= j + s:
                        continue
                    k = 0
                    while i + k < n and j + k < m and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                        k += 1
                    if k >= s:
                        covered[j - i] = j + k
                        found.append((-k, i, j))
        longest = max((-f[0] for f in found), default=0)
        if longest >= 2 * s:
            s = longest
            continue
        heapq.heapify(found)
        while found:
            k, i, j = heapq.heappop(found)
            free = free_a[i : i - k] & free_b[j : j - k]
            if free.all():
                free_a[i : i - k] = free_b[j : j - k] = False
                out.append((i, j, -k))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if y - x >= s:  # a shorter one is found again later
                    heapq.heappush(found, (x - y, i + x, j + x))
        if s == least:
            break
        s = max(least, s // 2)
    return out


def _all_free(free: np.ndarray, s: int) -> np.ndarray:
    """Whether each run of s words is unmarked."""
    if len(free) < s:
        return np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(free)])
    return total[s:] - total[:-s] == s


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, least: int = 5) -> DataFrame:
    """Pairs of a document and a benchmark item of whose words tiles cover `coverage` or more.

    Words are compared in lower case without punctuation. A document is held against an item if they share a
    seed, a run of `least` words; items of fewer words match as a whole only. All documents and items are
    compared; the benchmark is the query set, in written blocks of about BLOCK_CHARS characters, which workers read
    themselves: the driver holds none, a worker one at a time. Null or empty texts and items match nothing; an
    empty table, of either, gives no rows. Rows with one item_id are items of their own; repeated rows and
    copies of a document are reported each. A very long text is held against an item as a whole. Other columns are
    not looked at. No order is promised.
    """
    shared.small_batches(docs.sparkSession)

    def of(path: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block = _block(path, least)
            for batch in batches:
                ids = batch["doc_id"].astype("Int64").tolist()
                out = [(ids[i], *found) for i, found in _found(batch["text"].tolist(), block, coverage, least)]
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})
            shared.release()

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SCHEMA)

    found = [of(path) for path in _written(benchmark)]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def _written(benchmark: DataFrame) -> list[str]:
    """The folders of the benchmark's blocks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BLOCK_CHARS))
    path = shared.new_path(benchmark.sparkSession, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition(n, "block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={b}" for b in range(n)]


class _Block(NamedTuple):
    ids: list[int | None]
    item: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]  # by seed length: sorted seeds and their items
    sieve: dict[int, np.ndarray]


@functools.lru_cache(maxsize=1)
def _block(path: str, least: int) -> _Block:
    """A block, read from its folder. A worker keeps the last one from task to task."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type == pyarrow.fs.FileType.NotFound:  # no item fell into it
        return _Block([], [], {}, {})
    rows = pyarrow.dataset.dataset(at, filesystem=fs, format="parquet").to_table(columns=["item_id", "text"])
    ids, texts = rows.column("item_id").to_pylist(), rows.column("text").to_pylist()
    w = words.words(texts, "folded")
    item = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(texts))]
    seeds = {}
    for size in {min(least, len(x)) for x in item if len(x)}:
        pairs = sorted({(h, i) for i, x in enumerate(item) if min(least, len(x)) == size for h in words.grams(x, size).tolist()})
        seeds[size] = (np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64))
    return _Block(ids, item, seeds, {size: _sieve(keys) for size, (keys, _) in seeds.items()})


def _found(texts: list[str | None], block: _Block, coverage: float, least: int) -> Iterator[tuple[int, tuple]]:
    """Of each text that covers items: its place, and item_id, item_words, covered_words, tiles and coverage."""
    for a, b in words.blocks([len(t or "") for t in texts]):
        t = words.words(texts[a:b], "folded")
        for doc, i in sorted(_candidates(t, block.seeds, block.sieve)):
            x = block.item[i]
            marked = tiles(x, t.hash[t.first[doc] : t.first[doc + 1]], min(least, len(x)))
            done = sum(k for *_, k in marked)
            if done >= coverage * len(x):
                yield a + doc, (block.ids[i], len(x), done, len(marked), done / len(x))


def _sieve(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 22, bool)
    bits[keys >> np.uint64(42)] = True
    return bits


def _candidates(t: words.Words, seeds: dict, sieve: dict) -> set[tuple[int, int]]:
    """Pairs of text and item that share a seed."""
    out = set()
    for size, (keys, items) in seeds.items():
        g = words.grams(t.hash, size)
        at = np.flatnonzero(sieve[size][g >> np.uint64(42)])
        lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
        for p, x, y in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            doc = int(np.searchsorted(t.first, p, "right")) - 1
            if p + size <= t.first[doc + 1]:
                out.update((doc, i) for i in items[x:y].tolist())
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, least: int = 5) -> DataFrame:
    """The rows of documents without those whose text covers an item as in `matches`, all columns kept. A row is judged by
    its own text, so no join follows, repeated rows go or stay together, and doc_id plays no part."""
    shared.small_batches(docs.sparkSession)

    def judge(path: str):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            block = _block(path, least)
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[i for i, _ in _found(batch.tolist(), block, coverage, least)]] = False
                yield pd.Series(keep)
            shared.release()

        return F.pandas_udf(run, "boolean")

    for path in _written(benchmark):
        docs = docs.where(judge(path)(F.col("text").cast("string")))
    return docs
