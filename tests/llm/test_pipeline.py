"""The corpus pipeline on a small table with odd rows: each stage's decisions against what its operator's definition says."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wendgraph.llm import decontamination, pii, toxicity, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("length(text) > 300").orderBy("doc_id").first()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"].split()
    half = len(item) // 2
    odd = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, first["text"]), (9004, first["text"]), (9005, first["text"].upper() + "!"), (None, "call +49 (30) 1234-5678 or write to a@b.example"), (None, " ".join(item)), (9006, "start " + " ".join(item[half:] + ["between"] + item[:half]) + " end"), (9007, "w " * 60_000 + "a@b.example"), (9008, "4111 1111 1111 1111")]
    rows = spark.createDataFrame([(i, t, None, "odd", 0 if t is None else len(t)) for i, t in odd], docs.schema)
    docs.unionByName(rows).repartition(4).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return at


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "benchmark"))
    stage = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    clean = stage["toxicity"](spark, docs, sf_dir)
    scored = toxicity._scores([r["text"] for r in docs.collect()], toxicity.train(docs, labels).weight, toxicity.train(docs, labels).bias)
    assert rows_of(clean) == sorted((tuple(r) for r, s in zip(docs.collect(), scored) if s < 0.7), key=str) and clean.columns == columns
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert not {r["doc_id"] for r in clean.collect()} >= toxic

    one = stage["near_duplicates"](spark, clean, sf_dir)
    texts = clean.collect()
    sets = []
    for r in texts:
        w = words.words([r["text"]], "folded")
        sets.append(set(words.shingles(w, 0, 5, words.grams(w.hash, 5)).tolist()))
    linked = lambda i, j: texts[i]["text"] == texts[j]["text"] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i]["doc_id"] is not None and texts[i]["doc_id"] == texts[j]["doc_id"] or (texts[i]["text"] or "") == (texts[j]["text"] or "")
            if None not in (texts[i]["doc_id"], texts[j]["doc_id"]) and (same or linked(i, j)):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(texts):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    want = [tuple(r) for i, r in enumerate(texts) if r["doc_id"] is None or least[root(i)] == r["doc_id"]]
    assert rows_of(one) == sorted(want, key=str) and one.columns == columns and len(want) < len(texts)

    apart = stage["decontamination"](spark, one, sf_dir)
    folded = lambda t: words.words([t], "folded").hash
    items = [folded(r["text"]) for r in bench.collect()]
    covers = lambda t: any(2 * sum(k for *_, k in decontamination.tiles(x, folded(t), 5)) >= len(x) for x in items)
    assert rows_of(apart) == sorted((tuple(r) for r in one.collect() if not covers(r["text"])), key=str)
    left = apart.collect()
    assert 9006 not in {r["doc_id"] for r in left} and sum(r["doc_id"] is None for r in left) == 1

    private = stage["personal_data"](spark, apart, sf_dir)
    before, after = ({r["doc_id"]: r for r in df.collect() if r["source"] == "odd"} for df in (apart, private))
    assert private.columns == columns and before.keys() == after.keys() and private.count() == apart.count()
    assert after[None]["text"] == "call [PHONE] or write to [EMAIL]" and after[None]["n_chars"] == len(after[None]["text"])
    assert after[9008]["text"] == "[CARD]" and after[9007]["text"].endswith("w [EMAIL]")
    for r in private.collect():
        assert not pii.base_spans(r["text"] or "")

    pieces = stage["packing"](spark, private, sf_dir).toPandas()
    ids = {}
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in private.collect():
        ids.setdefault(r["doc_id"], []).append([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    for d, g in pieces[pieces.doc_id.notna()].groupby("doc_id"):
        if len(ids[d]) > 1:
            continue
        own = np.array(ids[d][0], np.uint32)
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(own) and (g.doc_tokens == len(own)).all()
        assert [zlib.crc32(own[a : a + n].astype("<u4").tobytes()) for a, n in zip(g.start, g.length)] == g.ids_crc32.tolist()
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert pieces.length.sum() == sum(len(x) for own in ids.values() for x in own)


def test_run_is_the_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    sizes = lambda df: sorted(map(tuple, df.where("start = 0").select(F.coalesce("doc_id", F.lit(-1)), "doc_tokens").collect()))
    assert sizes(corpus_pipeline.run(spark, sf_dir)) == sizes(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
