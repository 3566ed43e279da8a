"""Media columns: every column against the text, one stored payload a digest, shards of failed attempts."""

import hashlib
import os
import random
import tarfile
import zlib

import numpy as np

from wendgraph.llm import media


def rows():
    rng = random.Random(1)
    texts = [None, "", "x", "é" * 40, "\0" * 64, "a" * 64, "a" * 65, "x\0", "\U0001f600 ü", "long " * 100_000]
    texts += ["".join(rng.choice("abc \n") for _ in range(rng.randrange(400))) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(1000 + i, "of a third of all rows") for i in range(40)] + [(3, texts[3]), (None, texts[20]), (None, "no id")]


def test_every_column_and_one_payload_a_digest(spark, tmp_path):
    all_rows = rows()
    df = spark.createDataFrame([(i, t, "k", "d", 1) for i, t in all_rows], "doc_id long, text string, key string, digest string, again long").repartition(6)
    folder = f"file://{tmp_path}/media"
    os.makedirs(f"{tmp_path}/media")
    (tmp_path / "media" / "left-by-a-failed-attempt.tar").write_bytes(b"x" * 10)
    stored = media.store(df, folder)
    found = media.features(stored).toPandas()
    want = []
    for d, t in all_rows:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        png = media.to_png(padded)
        x = np.frombuffer(padded, np.uint8)
        feature = f"mean={sum(padded) / len(padded):.3f};zeros={padded.count(0)};quarters=" + "/".join(str(int(((x >= 64 * q) & (x < 64 * q + 64)).sum())) for q in range(4))
        want.append((d, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature, 64, len(padded) // 64))
    got = [tuple(None if v != v else v for v in r) for r in found.itertuples(index=False)]
    assert sorted((tuple(int(v) if isinstance(v, float) else v for v in r) for r in got), key=str) == sorted(want, key=str)

    shards = sorted(os.listdir(tmp_path / "media"))
    assert "left-by-a-failed-attempt.tar" not in shards
    names = [m.name for s in shards for m in tarfile.open(tmp_path / "media" / s).getmembers()]
    digests = {r[6] for r in want}
    assert sorted(names) == sorted(f"{x[:2]}/{x}.png" for x in digests)
    places = stored.select("digest", "shard", "offset", "length").distinct()
    assert places.count() == len(digests)
    for r in places.collect():
        with open(r["shard"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            assert hashlib.sha256(f.read(r["length"])).digest() == bytes(r["digest"])


def test_a_changed_payload_is_noticed(spark, tmp_path):
    stored = media.store(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), f"file://{tmp_path}/m")
    r = stored.first()
    at = r["shard"].removeprefix("file://")
    raw = bytearray(open(at, "rb").read())
    raw[r["offset"] + r["length"] - 20] ^= 1
    open(at, "wb").write(raw)
    try:
        media.features(stored).collect()
    except Exception as e:
        assert "differs from its digest" in str(e)
    else:
        raise AssertionError("not noticed")
    assert media.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
