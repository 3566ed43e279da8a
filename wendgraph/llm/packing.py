"""Packing of token ids into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

END = (1).to_bytes(4, "little")
#: byte_bpe_50k.json's added tokens; none of them takes the blanks beside it.
SPECIAL = {"<|endoftext|>": 50256}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteTokenizer:
    """Ids of byte_bpe_50k.json. Between two other characters, a single blank always begins a new piece of the
    pre-tokenizer's pattern, so texts are cut there; each different piece is encoded once and its ids are
    kept, found by the piece's hash, up to `most` pieces. Texts with other blanks are encoded whole, as are
    pieces of over 64 bytes. The strings of SPECIAL are their one id, and a text is cut there before all else."""

    def __init__(self, ranks_path: str, most: int = 500_000) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = {t: i for t, i in ranks.items() if i not in SPECIAL.values()}
        coding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.encode = functools.partial(coding.encode, allowed_special="all")
        self.ordinary = coding.encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        ids = np.array(self.ordinary(" " + b" ".join(pieces).decode()), np.uint32)
        last = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(x) + 1 for x in pieces]))
        first = np.concatenate([[0], last[:-1] + 1])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.at, self.n = np.concatenate([self.at, len(self.flat) + first])[order], np.concatenate([self.n, last + 1 - first])[order]
        self.keys, self.flat = keys[order], np.concatenate([self.flat, ids])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        tables, odd = [], set()
        for a, b in words.blocks([len(t) for t in texts]):
            w = words.words(texts[a:b], "blank")
            runs = np.diff(w.first)
            long = np.unique(np.searchsorted(w.first, np.flatnonzero(w.end - w.start > 64), "right") - 1)
            odd.update((a + long).tolist())
            for i in range(a, b):
                if runs[i - a] == 0 or texts[i].count(" ") != runs[i - a] - 1 or any(t in texts[i] for t in SPECIAL):
                    odd.add(i)
            tables.append((a, b, w))
        if not tables:
            return out
        keys, where, back = np.unique(np.concatenate([w.hash for *_, w in tables]), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._forget()
        found = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[found < len(self.keys)] = self.keys[found[found < len(self.keys)]] == keys[found < len(self.keys)]
        new = np.flatnonzero(~known)
        if len(new):
            offsets = np.cumsum([0, *(len(w.hash) for *_, w in tables)])
            block = np.searchsorted(offsets, where[new], "right") - 1
            pieces = []
            for i, j in zip(block.tolist(), (where[new] - offsets[block]).tolist()):
                w = tables[i][2]
                pieces.append(w.buffer[w.start[j] : w.end[j]])
            self._learn(keys[new], pieces)
            found = np.searchsorted(self.keys, keys)
        at, n = self.at[found], self.n[found]
        seen = 0
        for a, b, w in tables:
            piece = back[seen : seen + len(w.hash)]
            seen += len(w.hash)
            size = n[piece]
            size[w.first[:-1][np.diff(w.first) > 0]] = 0  # a text's first piece has no blank before it
            ends = np.cumsum(size)
            raw = self.flat[np.repeat(at[piece] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            ends = np.concatenate([[0], ends])[w.first] * 4
            for i in range(a, b):
                if i in odd:
                    out[i] = np.array(self.encode(texts[i]), np.uint32).tobytes()
                elif texts[i]:
                    first = np.array(self.ordinary(texts[i].partition(" ")[0]), np.uint32).tobytes()
                    out[i] = first + raw[ends[i - a] : ends[i - a + 1]]
        return out


@functools.cache
def tokenizer(ranks_path: str) -> ByteTokenizer:
    """One for each Python worker, which keeps its pieces from task to task."""
    return ByteTokenizer(ranks_path)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp differencing into k parts: the two partial partitions of the largest spread are merged
    again and again, the fullest part of one with the emptiest of the other. Returns the items of each part."""
    if not sizes:
        return []
    left, right = [-1] * len(sizes), [-1] * len(sizes)  # of merged parts; items come first
    heap = []
    for i, n in enumerate(sizes):
        sums, parts = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[-1], parts[-1] = n, i
        heap.append((-n, i, sums, parts))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        parts = np.where(x < 0, y, x)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            new = len(left)
            left.extend(x[both].tolist())
            right.extend(y[both].tolist())
            parts[both] = np.arange(new, new + len(both))
        order = np.argsort(sums, kind="stable")
        sums, parts = sums[order], parts[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), serial, sums - sums[0], parts))
        serial += 1
    out = []
    for tree in heap[0][3].tolist():
        part, todo = [], [tree] if tree >= 0 else []
        while todo:
            t = todo.pop()
            if t < len(sizes):
                part.append(t)
            else:
                todo += (left[t], right[t])
        out.append(part)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most `capacity`: as few as the total asks for, and more whenever a part is too full."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += max(1, k // 200)


def gathered(batches: Iterator[pd.DataFrame], most: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of some batches at a time, about `most` characters."""
    docs, texts, size = [], [], 0
    for batch in batches:
        docs += batch["doc_id"].astype("Int64").tolist()
        texts += ["" if t is None else t for t in batch["text"]]
        size += sum(map(len, texts[len(texts) - len(batch) :]))
        if size >= most:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def pack(docs: DataFrame, capacity: int = 2048, piece: int = 512, block: int = 1024, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (its text's, then id 1) fill whole sequences of `capacity` first; the rest is cut into
    pieces of at most `piece` ids. Pieces are packed as they come, `block` at a time, so nothing is
    shuffled and a task holds one batch of texts and one block of pieces. A null or empty text has the
    one id 1. Repeated rows are packed as often as they come, and other columns are not looked at. An
    empty table gives no rows. sequence_id is the partition's number times 2**33 plus a counter: a retried
    task gives the same rows. A null doc_id stays null.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = tokenizer(ranks_path)
        base = TaskContext.get().partitionId() << 33
        serial = 0
        waiting: list[tuple] = []

        def packed(rows: list[tuple]) -> list[tuple]:
            nonlocal serial
            out = []
            for part in windows([r[2] for r in rows], capacity):
                at = 0
                for i in sorted(part):
                    out.append((*rows[i], base + serial, at))
                    at += rows[i][2]
                serial += 1
            return out

        def frame(out: list[tuple]) -> pd.DataFrame:
            df = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")], dtype=object)
            return df.astype({c: "int64" for c in df.columns if c != "doc_id"}).astype({"doc_id": "Int64"})

        for docs_, texts in gathered(batches):
            out: list[tuple] = []
            for doc, ids in zip(docs_, encode(texts)):
                ids += END
                n = len(ids) // 4
                at = 0
                while at < n:
                    size = capacity if n - at >= capacity else min(piece, n - at)
                    row = (doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n)
                    if size == capacity:
                        out.append((*row, base + serial, 0))
                        serial += 1
                    else:
                        waiting.append(row)
                    at += size
                while len(waiting) >= block:
                    out += packed(waiting[:block])
                    waiting = waiting[block:]
            if out:
                yield frame(out)
        if waiting:
            yield frame(packed(waiting))
        shared.release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SCHEMA)
