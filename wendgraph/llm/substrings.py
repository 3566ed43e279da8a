"""Exact removal of repeated passages, found through the symbols of a recompression."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words
from .words import mix

#: Characters of text that make up one chunk: a worker's unit of work.
CHUNK = 1 << 22
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: list[np.ndarray] = []


class Level(NamedTuple):
    """Symbols of a round, in order: name, span [start, end) and context [low, high) in slots. A symbol is the same
    wherever its context's words are the same: they alone decide that it exists."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def recompress(slots: np.ndarray, barrier: np.ndarray, rounds: int) -> list[Level]:
    """The symbols after each round, the words first. Texts lie in slots with a barrier on either side.

    A round names maximal runs of one symbol by symbol and number, then pairs of a left and a right symbol by
    both; which of the two a symbol is, its name and the round's number say. A name is a 64-bit hash of what it
    stands for, so all workers give equal parts equal names, and no table of names is kept or shuffled.
    Barriers neither run nor pair.
    """
    n = len(slots)
    at = np.arange(n)
    level = Level(slots, at, at + 1, at, at + 1)
    wall = barrier
    out = [level]
    for r in range(rounds):
        name, start, end, low, high = level
        # runs: what a run is depends on the symbols at either side of it
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | wall[1:] | wall[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(name)) - 1
        size = (last - first + 1).astype(np.uint64)
        low, high = low[np.maximum(first - 1, 0)], high[np.minimum(last + 1, len(name) - 1)]
        name, start, end, wall = np.where(size > 1, mix(name[first] + size * np.uint64(_BASES[0])), name[first]), start[first], end[last], wall[first]
        # pairs: one that isn't made depends on the neighbour with which it would have been
        right = (mix(name ^ np.uint64((r + 1) * _BASES[1] & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
        open_ = ~wall
        joins = np.zeros(len(name), bool)  # a symbol and the next one
        joins[:-1] = open_[:-1] & open_[1:] & ~right[:-1] & right[1:]
        joined = np.zeros(len(name), bool)
        joined[1:] = joins[:-1]
        i = np.flatnonzero(~joined)
        two = joins[i]
        j = np.minimum(i + two, len(name) - 1)
        named = np.where(two, mix(name[i] * np.uint64(_BASES[0]) + mix(name[j] + np.uint64(1))), name[i])
        looks_left, looks_right = ~two & right[i], ~two & ~right[i]
        low2 = np.where(looks_left, low[np.maximum(i - 1, 0)], low[i])
        high2 = np.where(two, high[j], np.where(looks_right, high[np.minimum(i + 1, len(name) - 1)], high[i]))
        level, wall = Level(named, start[i], end[j], low2, high2), wall[i]
        out.append(level)
    return out


def _power(n: int) -> list[np.ndarray]:
    """Powers of the first base, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        _powers[:] = []
        for b in (_BASES[0], pow(_BASES[0], -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers


class Runs:
    """Hashes of any runs of slots, from running sums."""

    def __init__(self, slots: np.ndarray) -> None:
        up, self.inverse = _power(len(slots) + 1)
        self.sums = np.zeros(len(slots) + 1, np.uint64)
        np.cumsum(slots * up[: len(slots)], out=self.sums[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a])


def anchors(levels: list[Level], starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window's anchor: of the highest level that has symbols whose context lies inside the window, the one of the
    least name. Windows with equal words have equal anchors, at equal places in them: contexts decide on
    symbols, and the rule looks at nothing outside the window. Words are their own context, so each window has one.
    Returns low, high and level of the anchors, and each window's anchor."""
    left = np.arange(len(starts))
    low = np.zeros(len(starts), np.int64)
    high, rank = low.copy(), low.copy()
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        s = starts[left]
        f, g = np.searchsorted(level.low, s), np.searchsorted(level.high, s + size, "right")
        has = f < g
        f, g, mine = f[has], g[has], left[has]
        best = _least(level.name, f, g)
        low[mine], high[mine], rank[mine] = level.low[best], level.high[best], k
        left = left[~has]
        if not len(left):
            break
    code = (low << 34) | ((high - low) << 4) | rank
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return low[first], high[first], rank[first], which


def _least(name: np.ndarray, f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where each range [f, g) has its least name, the first of equals; by minima over ranges of 1, 2, 4, ... symbols."""
    out = np.zeros(len(f), np.int64)
    best, step = np.arange(len(name)), 1
    while len(f) and step <= (g - f).max():
        here = np.flatnonzero((g - f >= step) & (g - f < 2 * step))
        if len(here):
            x, y = best[f[here]], best[g[here] - step]
            out[here] = np.where(name[y] < name[x], y, x)
        if len(best) <= step:
            break
        x, y = best[: len(best) - step], best[step:]
        best = np.concatenate([np.where(name[y] < name[x], y, x), best[len(best) - step :]])
        step *= 2
    return out


class Slots(NamedTuple):
    value: np.ndarray
    barrier: np.ndarray
    first: np.ndarray  # of text i: its words are in slots first[i] to first[i] + count[i]
    count: np.ndarray


def slots(texts: list[str]) -> Slots:
    w = words.words(texts, "plain")
    count = np.diff(w.first)
    first = w.first[:-1] + np.arange(len(texts)) + 1
    value = np.zeros(len(w.hash) + len(texts) + 1, np.uint64)
    barrier = np.ones(len(value), bool)
    at = np.arange(len(w.hash)) + np.repeat(np.arange(len(texts)), count) + 1
    value[at], barrier[at] = w.hash, False
    return Slots(value, barrier, first, count)


def _chunks(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[list]]:
    """Columns of some batches at a time; of rows with one key, a chunk has only the first and, as `copies`, how many."""
    rows: dict[str, list] = {}
    size = 0
    for batch in batches:
        for row in batch[columns].itertuples(index=False, name=None):
            if row[0] in rows:
                rows[row[0]][-1] += 1
                continue
            rows[row[0]] = [*row, 1]
            size += len(row[1])
            if size >= CHUNK:
                yield list(map(list, zip(*rows.values())))
                rows, size = {}, 0
    if rows:
        yield list(map(list, zip(*rows.values())))


EMITTED = "chunk string, bucket int, keys binary, meta binary, texts binary"


def _emit(keys: np.ndarray, copies: np.ndarray, meta: list[np.ndarray], texts: list[str], buckets: int) -> Iterator[pd.DataFrame]:
    """A chunk's rows: for each bucket its different keys (n x 1 or n x 2 uint64; one that the chunk has more than once is
    sent twice), and one row with where they come from: meta's first column says which key, in the order sent."""
    chunk = uuid.uuid4().hex
    # order by bucket, then key
    order = np.lexsort(tuple(keys[:, c] for c in range(keys.shape[1] - 1, -1, -1)))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]).any(axis=1)
    which = np.cumsum(new) - 1
    number = np.bincount(which, copies[order].astype(float)).astype(np.int64)
    place = np.zeros(len(keys), np.int64)
    place[order] = which
    k = k[new]
    twice = np.where(number > 1, 2, 1)
    sent_at = np.cumsum(twice) - twice
    sent = np.repeat(k, twice, axis=0)
    bucket = (sent[:, 0] >> np.uint64(64 - buckets)).astype(np.int64) if buckets else np.zeros(len(sent), np.int64)
    ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
    rows = []
    a = 0
    for b in ends.tolist():
        rows.append((chunk, int(bucket[a]), sent[a:b].tobytes(), None, None))
        a = b
    table = np.stack([sent_at[place], *meta], axis=1).astype(np.int32)
    rows.append((chunk, -1, None, table.tobytes(), "\n".join(texts).encode()))
    yield pd.DataFrame(rows, columns=["chunk", "bucket", "keys", "meta", "texts"])


def window_names(text: str, at: np.ndarray, window: int) -> np.ndarray:
    """Digests (BLAKE2b, 128 bits, n x 2) of the windows' words themselves, joined by blanks, at the given places."""
    parts = text.encode("utf-8", "surrogatepass").split()
    whole = b" ".join(parts)
    start = np.cumsum([0, *(len(x) + 1 for x in parts)])
    names = b"".join([hashlib.blake2b(whole[x:y], digest_size=16).digest() for x, y in zip(start[at].tolist(), (start[at + window] - 1).tolist())])
    return np.frombuffer(names, np.uint64).reshape(-1, 2)


def _repeated(rows: DataFrame, width: int, keep: str) -> DataFrame:
    """From `_emit`'s rows, which are written first and deleted at the end: key string, spans binary (int32 start, end pairs of the meta rows of keys that
    occur more than once anywhere), by text. A bucket's keys come together in one task: a bucket holds a bounded share
    of all keys, as their number grows with the input, and of one key at most two entries a chunk."""

    spark = rows.sparkSession
    path = shared.new_path(spark, f"{keep}-keys")
    rows.write.parquet(path)
    emitted = spark.read.schema(EMITTED).parquet(path)

    def flag(df: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, np.uint64).reshape(-1, width) for x in df["keys"]]
        k = np.concatenate(keys)
        order = np.lexsort(tuple(k[:, c] for c in range(width - 1, -1, -1)))
        s = k[order]
        same = (s[1:] == s[:-1]).all(axis=1)
        hit = np.zeros(len(k), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        out, a = [], 0
        for chunk, bucket, x in zip(df["chunk"], df["bucket"], keys):
            h = hit[a : a + len(x)]
            a += len(x)
            out.append((chunk, bucket, len(x), np.packbits(h).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "bucket", "n", "hit"])

    def place(key: tuple, flags: pd.DataFrame, metas: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "spans"]
        if not len(metas):
            return pd.DataFrame([], columns=columns)
        flags = flags.sort_values("bucket")
        hit = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8))[:n] for h, n in zip(flags["hit"], flags["n"])]).astype(bool)
        table = np.frombuffer(metas["meta"].iloc[0], np.int32).reshape(-1, 4)
        texts = metas["texts"].iloc[0].decode().split("\n")
        table = table[hit[table[:, 0]]]
        table = table[np.lexsort((table[:, 2], table[:, 1]))]
        out = []
        for i in np.unique(table[:, 1]).tolist():
            a, b = np.searchsorted(table[:, 1], [i, i + 1])
            out.append((texts[i], merged(table[a:b, 2:]).tobytes()))
        return pd.DataFrame(out, columns=columns)

    flags = emitted.where("bucket >= 0").select("chunk", "bucket", "keys").groupBy("bucket").applyInPandas(flag, "chunk string, bucket int, n int, hit binary")
    metas = emitted.where("bucket < 0").select("chunk", "meta", "texts")
    found = flags.groupBy("chunk").cogroup(metas.groupBy("chunk")).applyInPandas(place, "key string, spans binary")
    kept = shared.written(found.dropDuplicates(["key"]), keep)
    shared.drop(spark, path)
    return kept


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted [start, end) pairs with the touching and overlapping ones made one."""
    if not len(spans):
        return np.zeros((0, 2), np.int32)
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1).astype(np.int32)


def remove_repeats(docs: DataFrame, window: int = 35, rounds: int = 4) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256: words (runs between ASCII white space) covered by a window of
    `window` words that also starts anywhere else, in another row or the same, are removed.

    1. Every text is recompressed (`recompress`), every window gets its anchor (`anchors`), and the hashes of the
       anchors' contexts are counted over all texts: about one for nine words.
    2. Of windows whose anchor occurs once, none is repeated. Of the others, digests of the words themselves are counted, so
       the decision rests on no hash of hashes.
    3. The words under repeated windows go.

    A chunk of texts sends each key once or twice, however often it has it, so copies and passages that a third
    of all rows have stay small in the shuffle. Texts are known by their sha256. Null counts as empty: no words.
    Repeated rows count as copies of each other. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(3, int(chars >> 23).bit_length())  # 2**buckets: about 8 million characters, a million keys, a bucket at most

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, texts, copies in _chunks(batches, ["key", "text"]):
            found = []
            for a, b in words.blocks([len(t) for t in texts]):
                s = slots(texts[a:b])
                n = np.maximum(s.count - window + 1, 0)
                if not n.sum():
                    continue
                text = np.repeat(np.arange(b - a), n)
                starts = s.first[text] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                low, high, rank, which = anchors(recompress(s.value, s.barrier, rounds), starts, window)
                name = mix(Runs(s.value).hash(low, high) + rank.astype(np.uint64))
                # the windows of an anchor, from its first to its last
                at = starts - s.first[text]
                lo, hi = np.full(len(low), 1 << 30), np.full(len(low), -1)
                np.minimum.at(lo, which, at)
                np.maximum.at(hi, which, at)
                of = np.zeros(len(low), np.int64)
                of[which] = text
                found.append((name, of + a, lo, hi + 1))
            if found:
                name, of, lo, hi = map(np.concatenate, zip(*found))
                yield from _emit(name.reshape(-1, 1), np.array(copies)[of], [of, lo, hi], keys, buckets)

    zones = _repeated(rows.select("key", "text").mapInPandas(first, EMITTED), 1, "zones")

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, texts, spans, copies in _chunks(batches, ["key", "text", "spans"]):
            found = []
            for i, (text, zones_) in enumerate(zip(texts, spans)):
                at = np.concatenate([np.arange(x, y) for x, y in np.frombuffer(zones_, np.int32).reshape(-1, 2)])
                found.append((window_names(text, at, window), np.full(len(at), i), at, at + 1))
            k, of, lo, hi = map(np.concatenate, zip(*found))
            yield from _emit(k, np.array(copies)[of], [of, lo, hi], keys, buckets)

    suspect = rows.select("key", "text").join(shared.hinted(zones), "key")
    marks = _repeated(suspect.mapInPandas(second, EMITTED), 2, "marks")

    def third(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch["doc_id"].astype("Int64").tolist(), batch["text"], batch["spans"]):
                kept = text.encode("utf-8", "surrogatepass").split()
                n = len(kept)
                if spans is not None:
                    left, parts = 0, []
                    z = np.frombuffer(spans, np.int32).reshape(-1, 2).copy()
                    z[:, 1] += window - 1
                    for x, y in merged(z).tolist():
                        parts += kept[left:x]
                        left = y
                    kept = parts + kept[left:]
                out.append((doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype({"doc_id": "Int64"})

    return rows.join(shared.hinted(marks), "key", "left").select("doc_id", "text", "spans").mapInPandas(third, "doc_id long, n_words long, n_removed long, kept_sha256 string")
