"""Each operator against brute force, a round trip or held-out accuracy, and on nulls, empty and very long texts, ties,
repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wendgraph.llm import decontamination, language, licenses, media, neardup, packing, pii, preference, substrings, toxicity, words

SCHEMA = "doc_id long, text string, key string, n long, rep long, spans string, h long, names string, lang string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "s", 3, "x", None) for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = prose(rng, 30000)
    same = prose(rng, 80)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, same), (5, same), (5, same), (6, long), (None, same), (7, "x" * 50000), (8, "é ü " * 40), (9, "1" * 3000), (10, "a@" * 500), (11, same + " " + prose(rng, 40))]
    return rows, table(spark, rows)


def test_every_operator_takes_odd_and_empty_tables(spark, odd):
    rows, df = odd
    empty = df.limit(0)
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (2, None), (None, "")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 1), (3, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    found = {}
    for f in (neardup.near_duplicates, licenses.scan, pii.find, language.identify, substrings.remove_repeats, media.round_trip):
        found[f] = f(df).collect()
        assert len(found[f]) == len(rows), f
        assert f(empty).count() == 0, f
    of = lambda f, c: {r["doc_id"]: r[c] for r in found[f]}
    group = of(neardup.near_duplicates, "class_id")
    assert group[0] == group[1] == 0 and group[2] == 2 and group[4] == group[5] == group[None] == 4 and all(group[i] == i for i in (3, 6, 7, 8, 9, 10, 11))
    assert set(of(licenses.scan, "licenses").values()) == {""}
    spans = of(pii.find, "n_email")
    assert all(spans[i] == 0 for i in spans)
    assert {i for i, x in of(language.identify, "lang_pred").items() if x == "und"} == {i for i, _ in rows}  # nothing to learn from
    removed, n = of(substrings.remove_repeats, "n_removed"), of(substrings.remove_repeats, "n_words")
    assert {i: removed[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 11, None)} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 80, 5: 80, 6: 0, 7: 0, 8: 80, 11: 80, None: 80} and n[6] == 30000
    assert of(media.round_trip, "payload_bytes")[0] == of(media.round_trip, "payload_bytes")[1] == 64
    model = toxicity.train(df, labels)
    assert toxicity.score(df, model).count() == len(rows) and toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0
    assert decontamination.matches(df, bench).count() == 0 and decontamination.matches(empty, bench.limit(0)).count() == 0
    assert packing.pack(df).select("doc_id").where("start = 0").count() == len(rows) and packing.pack(empty).count() == 0
    assert pii.redact(df).columns == df.columns and neardup.one_of_each(df).columns == df.columns


def test_near_duplicates_are_the_components_of_the_similar(spark):
    rng = random.Random(2)
    rows, i = [], 0
    for _ in range(25):
        base = prose(rng, rng.randrange(5, 200)).split()
        for _ in range(rng.randrange(1, 6)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(999)}"
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(i, rows[0][1]), (i + 1, rows[0][1].upper() + "!")]
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for k, t in rows for w in [re.findall(r"\w+", t.lower())]}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(table(spark, rows)).collect()}
    wrong = sum(got[k] != root(k) for k in sets)
    assert wrong <= 0.02 * len(sets)  # the tables' stated misses
    # oversized buckets: the same classes when every bucket is split
    split = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(table(spark, rows), most=2).collect()}
    assert sum(split[k] != root(k) for k in sets) <= 0.05 * len(sets)


def nodes_of_one_bucket(n):
    """n signatures that agree in the first table's first 16 coordinates and differ by 128 bits on average else."""
    rng = np.random.default_rng(n)
    bits = rng.integers(0, 2, (n, neardup.BITS), np.uint8)
    bits[:, neardup.coordinates(1)[0][:16]] = 0
    return rng, bits


def frame_of(spark, bits):
    sig = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    return spark.createDataFrame(pd.DataFrame({"rep": np.arange(len(bits)) * 3} | {f"s{i}": sig[:, i] for i in range(4)}))


def test_oversized_buckets_keep_every_pair(spark):
    rng, bits = nodes_of_one_bucket(300)
    free = np.setdiff1d(np.arange(neardup.BITS), neardup.coordinates(1)[0][:16])
    for i in range(100, 300):  # two copies of each of the first hundred, with flips outside the bucket's name
        bits[i] = bits[i % 100]
        bits[i, rng.choice(free, rng.integers(0, 50), replace=False)] ^= 1
    want = {(3 * a, 3 * b, d) for a in range(300) for b in range(a + 1, 300) if (d := int((bits[a] != bits[b]).sum())) <= 64}
    for most in (16, 299, 300):
        got = neardup.candidates(frame_of(spark, bits), 2, 16, most, 64).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want, most


def test_large_parts_are_compared_whole(spark):
    neardup.shared.small_batches(spark)
    rng, bits = nodes_of_one_bucket(17000)
    bits[:, neardup.coordinates(1)[0]] = 0  # they agree in all sampled coordinates
    for a, b in ((5, 16900), (100, 16400), (16390, 16800)):
        bits[b] = bits[a]
        bits[b, rng.choice(np.setdiff1d(np.arange(neardup.BITS), neardup.coordinates(1)[0]), 30, replace=False)] ^= 1
    want = {(15, 50700, 30), (300, 49200, 30), (49170, 50400, 30)}
    got = {tuple(r) for r in neardup.candidates(frame_of(spark, bits), 2, 16, 1 << 20, 40).collect()}
    assert want <= got


def test_licenses(spark):
    mit = "\n".join(f"// {licenses.SENTENCES[k]}" for k in ("mit_grant", "mit_notice", "mit_warranty", "mit_liability"))
    wrapped = licenses.SENTENCES["bsd_source"].replace(" this list", "\nthis list")
    rows = [(1, "intro\n" + mit + "\nend"), (2, "foo bar\nLicensed under the Apache License, Version 2.0.\nmore"), (3, "// SPDX-License-Identifier: MIT"), (4, licenses.SENTENCES["bsd_grant"] + "\n1. " + wrapped + "\n2. " + licenses.SENTENCES["bsd_binary"]), (5, "released under the mit licence"), (6, None)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(table(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "MIT", 4: "BSD-2-Clause", 5: "", 6: ""}


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_licences_whose_telling_words_are_apart(spark):
    grant = licenses.SENTENCES["unlicense_grant"]
    texts = ["# " + grant.replace("public domain", "public\n# domain"), grant.replace("public domain", "public-domain"), "All rights  reserved.", "All rights\nreserved."]
    got = {r["doc_id"]: r["sequence"] for r in licenses.scan(table(spark, list(enumerate(texts)))).collect()}
    assert got == {0: "unlicense_grant", 1: "unlicense_grant", 2: "all_rights", 3: "all_rights"}


def test_base_patterns():
    rng = random.Random(3)
    for _ in range(8000):
        t = "".join(rng.choice("a1.@-+_ ()0é5\n") for _ in range(60))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_tied_tokens_share_their_label():
    k = len(pii.LABELS)
    field = pii.Field(np.zeros((pii.FEATURES, k)), np.zeros((k, k)), 3 * np.eye(k))
    f = np.zeros((3, pii.FEATURES))
    p = pii.infer(field, f, np.zeros((0, 2), np.int64), np.array([[1, 0]]), np.array([5, -1, -1]))
    assert p[1].argmax() == 5 and p[1, 5] > 0.7 and abs(p[2, 0] - 1 / k) < 1e-6
    assert np.allclose(p[1], np.exp(np.where(np.arange(k) == 5, 3, 0)) / (np.exp(3) + k - 1), atol=1e-3)  # exact on a tree


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert scored[scored.toxic == 1].score.mean() > 0.5 > 0.3 > scored[scored.toxic == 0].score.mean()


def test_substrings_against_brute_force(spark):
    rng = random.Random(4)
    shared = [prose(rng, n, 50) for n in (34, 35, 36, 90)]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randrange(0, 60), 4000)]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            parts += [s, prose(rng, rng.randrange(0, 30), 4000)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(parts))
    texts += ["a " * 34, "a " * 35, "b " * 36, "c " * 50, "c " * 60, "d e " * 30, "d e " * 25, "x " * 40 + prose(rng, 20), "x " * 38 + prose(rng, 20), texts[0]]
    ws = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    count = Counter(tuple(w[j : j + 35]) for w in ws for j in range(len(w) - 34))
    want = {}
    for i, w in enumerate(ws):
        gone = {x for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for x in range(j, j + 35)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in substrings.remove_repeats(table(spark, list(enumerate(texts)))).collect()}
    assert got == want


def test_recompression_is_the_same_inside_equal_runs():
    rng = np.random.default_rng(5)
    inner = rng.integers(0, 5, 60).astype(np.uint64)
    found = []
    for seed in (6, 7):
        r = np.random.default_rng(seed)
        left = r.integers(0, 5, 11 + seed).astype(np.uint64)
        x = np.concatenate([[0], left, inner, r.integers(0, 5, 9).astype(np.uint64), [0]]).astype(np.uint64)
        wall = np.zeros(len(x), bool)
        wall[[0, -1]] = True
        a = 1 + len(left)
        level = substrings.recompress(x, wall, 4)[-1]
        inside = (level.low >= a) & (level.high <= a + 60)
        found.append([(n, s - a, e - a) for n, s, e, i in zip(level.name, level.start, level.end, inside) if i])
    assert found[0] == found[1] and found[0]


def test_tiling_catches_reordered_passages(spark):
    rng = random.Random(8)
    item = prose(rng, 40).split()
    moved = " ".join(item[20:] + ["zz"] + item[:20])
    rows = [(1, prose(rng, 300) + " " + moved.upper() + ". " + prose(rng, 50)), (2, prose(rng, 300)), (3, " ".join(item[:12]))]
    bench = spark.createDataFrame([(9, " ".join(item)), (10, prose(rng, 30))], "item_id long, text string")
    got = decontamination.matches(table(spark, rows), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["covered_words"]) for r in got] == [(1, 9, 40)] and got[0]["tiles"] == 2
    assert [r["doc_id"] for r in decontamination.clean(table(spark, rows), bench).orderBy("doc_id").collect()] == [2, 3]


def test_tiles_never_overlap():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = (rng.integers(0, 3, rng.integers(1, 30)).astype(np.uint64) for _ in range(2))
        marked = decontamination.tiles(a, b, 3)
        for i, j, k in marked:
            assert k >= 3 and (a[i : i + k] == b[j : j + k]).all()
        for side in (0, 1):
            used = [x for m in marked for x in range(m[side], m[side] + m[2])]
            assert len(used) == len(set(used))


def test_media_round_trip(spark, odd):
    rows, df = odd
    got = media.round_trip(df).toPandas()
    want = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        raw += b"\0" * (-len(raw) % 64 if raw else 64)
        want[hashlib.sha256(raw).hexdigest(), len(raw)] += 1
    assert Counter(zip(got.payload_sha256, got.payload_bytes)) == want
    assert media.png_size(media.to_png(b"\1" * 192)[: media.HEADER]) == (64, 3, 8)


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows, df = odd
    texts = [x or "" for _, x in rows] + ["a  b", " a", "a\n\n b", "it's 12 x\ty", "a" * 100 + " b"]
    own = packing.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))(texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in own] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = packing.pack(df).toPandas()
    assert got.length.sum() == sum(len(x) // 4 + 1 for x in own[: len(rows)])
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]


def test_added_tokens_are_those_of_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {x.content: i for i, x in t.get_added_tokens_decoder().items()} == packing.SPECIAL
    e = "<|endoftext|>"
    texts = [f"a {e} b", e, f" {e}", f"{e}{e}", f"one two{e}three four", f"a  b {e}\n c", f"{e} x", f"a{e[:-1]} b", "a b", f"{'y' * 90} {e}"]
    own = packing.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for _ in range(2):
        assert [np.frombuffer(x, np.uint32).tolist() for x in own(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_differencing():
    rng = random.Random(10)
    for k in (1, 2, 7, 30):
        sizes = [rng.randrange(1, 512) for _ in range(200)]
        parts = packing.difference(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(200))
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= 60
    assert all(sum([1500, 1500, 1500][i] for i in p) <= 2048 for p in packing.windows([1500, 1500, 1500], 2048))


def test_preferences(spark):
    turn = lambda r, t: {"role": r, "text": t}
    a = [turn("user", "hi"), turn("assistant", "hello"), turn("user", "more"), turn("assistant", "good")]
    b = a[:3] + [turn("assistant", "bad")]
    schema = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    got = {r["pair_id"]: r for r in preference.pairs(spark.createDataFrame([(1, a, b), (2, a, a), (3, a, None), (4, a, a[:2])], schema)).collect()}
    r = got[1]
    assert r["n_prompt_turns"] == 3 and r["prompt"].count("<|end|>") == 3
    x, y = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][x:y] == "good<|end|>\n" and r["rejected"].startswith("<|assistant|>\nbad")
    assert got[2]["chosen"] == "" == got[2]["rejected"] and got[3]["prompt"] == "" and got[4]["rejected"] == "" and got[4]["n_prompt_turns"] == 2
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.pairs(preference.with_borrowed_replies(empty)).count() == 0


def test_every_conversation_has_its_pair(spark):
    roles = {1: "ua", 4: "uau", 5: "u", 9: "s", 40: "uaua", 41: "a", 1000: "aus", -7: "uaa", 2000: "u", 10**12: "ua"}
    name = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(i, k, name[c], f"{i}-{k}") for i, cs in roles.items() for k, c in enumerate(cs)] + [(None, 0, "assistant", "x"), (50, 0, None, None)]
    got = {r["pair_id"]: r for r in preference.with_borrowed_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    roles[50] = " "
    assert got.keys() == roles.keys()
    replying = sorted(i for i in roles if "a" in roles[i])
    for i, r in got.items():
        assert [t["text"] for t in r["chosen"]] == [f"{i}-{k}" if c != " " else "" for k, c in enumerate(roles[i])]
        if i not in replying or i == replying[-1]:
            assert r["rejected"] is None
            continue
        j, at = replying[replying.index(i) + 1], roles[i].rindex("a")
        want = [f"{i}-{k}" for k in range(len(roles[i]))]
        want[at] = f"{j}-{roles[j].rindex('a')}"
        assert [t["text"] for t in r["rejected"]] == want and [t["role"] for t in r["rejected"]] == [t["role"] for t in r["chosen"]]


def test_words():
    w = words.words(["A b, c", None, "", "a B c"], "folded")
    assert w.first.tolist() == [0, 3, 3, 3, 6] and (w.hash[:3] == w.hash[3:]).all()
    assert len(pd.unique(w.hash)) == 3
