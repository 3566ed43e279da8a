"""Media columns: content-addressed payloads in tar shards, with digest, offset and length in the rows."""

from __future__ import annotations

import hashlib
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

ROW = 64  # a PNG's width: payloads are whole rows of 8-bit samples
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # bytes of a PNG up to the end of its IHDR chunk
#: Payload bytes of a shard, about; a larger partition writes more shards.
SHARD_BYTES = 256 << 20


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def to_png(samples: bytes) -> bytes:
    """A greyscale PNG of ROW columns with the samples, row by row, none filtered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = ROW.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER bytes."""
    if header[:8] != _SIGNATURE or header[12:16] != b"IHDR" or zlib.crc32(header[12:29]) != int.from_bytes(header[29:33], "big"):
        raise ValueError("no PNG header")
    return int.from_bytes(header[16:20], "big"), int.from_bytes(header[20:24], "big"), header[24]


def from_png(png: bytes) -> bytes:
    width, height, _ = png_size(png[:HEADER])
    at, data = 8, []
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        if png[at + 4 : at + 8] == b"IDAT":
            data.append(png[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class _Shard:
    """A tar file that is written under a name of this attempt's own, so that a retried or doubled task never shares one."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.tar"
        fs, path = _open(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.at = fs.open_output_stream(path), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.file.write(head + data + b"\0" * (-len(data) % 512))
        start = self.at + len(head)
        self.at = start + len(data) + -len(data) % 512
        return start

    def close(self) -> None:
        self.file.write(b"\0" * 1024)
        self.file.close()


_PLACE = "digest binary, n_bytes long, shard string, offset long, length long"


def _stored(texts: DataFrame, folder: str, carried: str) -> DataFrame:
    """Writes the payload of each row (a column `carried`, and text) to shards of its partition; the column and its place."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for batch in batches:
            out = []
            for text in batch["text"]:
                png = to_png(payload(text))
                digest = hashlib.sha256(png).digest()
                if shard is not None and shard.at > SHARD_BYTES:
                    shard.close()
                    shard = None
                if shard is None:
                    shard = _Shard(folder)
                name = digest.hex()
                out.append((digest, len((text or "").encode("utf-8", "surrogatepass")), shard.uri, shard.add(f"{name[:2]}/{name}.png", png), len(png)))
            df = pd.DataFrame(out, columns=[c.split()[0] for c in _PLACE.split(", ")])
            df.insert(0, carried, batch[carried])
            yield df
        if shard is not None:
            shard.close()

    return texts.select(carried, "text").mapInPandas(write, f"{carried} {dict(texts.dtypes)[carried]}, {_PLACE}")


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads, as PNGs, to tar shards under `folder` and returns one row per document: doc_id, digest (sha256 of
    the PNG, which also names it in the shard), n_bytes, shard, offset, length. It is a written table, so only shards of
    tasks that ended well are ever named in it.

    A digest is stored once. Texts that occur once are written by the partition that reads them, so they are never
    shuffled. Which ones occur more often is told by a count of their hashes; of these one copy each is written, and
    all rows are given its place by their hash: a text that a third of all rows have goes through the shuffle once a
    task. Null and empty texts are ROW zero bytes. Payloads of equal bytes have equal places, so a text and the same
    with zero characters at its end share one, too. Shards that a failed or doubled attempt left are deleted.
    """
    shared.small_batches(docs.sparkSession)
    padded = F.rpad(F.encode("text", "utf-8"), F.greatest(F.ceil(F.octet_length("text") / ROW) * ROW, F.lit(ROW)).cast("int"), F.lit(b"\0"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.sha2(padded, 256)))
    again = shared.written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("again")), "repeated")
    rows = rows.join(shared.hinted(again), "key", "left")
    once = shared.written(_stored(rows.where("again is null"), folder, "doc_id"), "media-once")
    copies = rows.where("again is not null")
    places = shared.written(_stored(copies.groupBy("key").agg(F.first("text").alias("text")), folder, "key"), "media-places")
    copies = shared.written(copies.select("doc_id", "key", F.octet_length("text").cast("long").alias("own")), "media-copies")
    found = shared.joined(copies, places, "key").select("doc_id", "digest", F.col("own").alias("n_bytes"), "shard", "offset", "length")
    stored = shared.written(once.unionByName(found), "media-index")
    _forget(once.select("shard").unionByName(places.select("shard")), folder)
    return stored


def _forget(used: DataFrame, folder: str) -> None:
    """Deletes the shards under `folder` that aren't in `used`: a few names for each gigabyte."""
    fs, path = _open(folder)
    there = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    named = {r["shard"].rpartition("/")[2] for r in used.distinct().toLocalIterator()}
    for f in there:
        if f.base_name not in named:
            fs.delete_file(f.path)


def headers(stored: DataFrame) -> DataFrame:
    """stored with width, height and bits, from a range read of each payload's first HEADER bytes alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [png_size(h) for h in _ranges(batch["shard"], batch["offset"], np.full(len(batch), HEADER))]
            yield batch.assign(width=[w for w, _, _ in sizes], height=[h for _, h, _ in sizes], bits=[b for *_, b in sizes])

    return stored.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in stored.dtypes) + ", width long, height long, bits long")


def _ranges(shards, offsets, lengths) -> Iterator[bytes]:
    """The bytes at the given places; a shard stays open while it is the one asked for."""
    last = file = None
    for uri, offset, length in zip(shards, offsets, lengths):
        if uri != last:
            if file is not None:
                file.close()
            fs, path = _open(uri)
            last, file = uri, fs.open_input_file(path)
        data = file.read_at(int(length), int(offset))
        if len(data) != length:
            raise OSError(f"{uri} ends before {offset} + {length}")
        yield data
    if file is not None:
        file.close()


def feature(samples: bytes) -> str:
    """Of 8-bit samples: their mean to three places, how many are zero, and the histogram of their top two bits."""
    x = np.frombuffer(samples, np.uint8)
    return f"mean={x.mean():.3f};zeros={int((x == 0).sum())};quarters=" + "/".join(map(str, np.bincount(x >> 6, minlength=4)))


def features(stored: DataFrame) -> DataFrame:
    """One row per document, computed from the bytes read back from the shards: doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and width and height from the header. Equal
    texts have equal values. The stored form's digest is checked against the row's."""
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            new = ~batch["digest"].isin(known.keys()) & ~batch["digest"].duplicated()
            if len(known) > 10 * len(batch):
                known, new = {}, ~batch["digest"].duplicated()
            fresh = batch[new]
            for digest, n, width, height, png in zip(fresh["digest"], fresh["n_bytes"], fresh["width"], fresh["height"], _ranges(fresh["shard"], fresh["offset"], fresh["length"])):
                if hashlib.sha256(png).digest() != digest:
                    raise OSError("a stored payload differs from its digest")
                samples = from_png(png)
                known[digest] = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(png), digest.hex(), feature(samples), width, height)
            df = pd.DataFrame([(n, *known[d]) for d, n in zip(batch["digest"], batch["n_bytes"])], columns=columns)
            df.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield df

    return headers(stored).mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores the documents' payloads in the shared folder (or `folder`) and returns `features` of what was stored. Repeated
    rows each get their row; an empty table gives none; other columns are not looked at."""
    return features(store(docs, folder or shared.new_path(docs.sparkSession, "media")))
