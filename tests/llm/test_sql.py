"""The queries that SQL can express, against it, on the given tables and on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from wendgraph.llm import licenses, preference, queries

DIR = "/root/testdata/sf0.01"


def rows(names, found):
    return sorted(repr([x for _, x in sorted(zip(names, r))]) for r in found)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DIR)
    want = con.sql(queries.SQL[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_odd_conversations_against_sql(spark):
    turns = {3: "ua", 4: "u", 9: "", 12: "uau", 40: "a", 41: "sua", 1000: "uaa", -7: "ua", 2000: "u"}
    names = {"u": "user", "a": "assistant", "s": "system"}
    table = [(i, k, names[c], f"é{i}-{k}") for i, cs in turns.items() for k, c in enumerate(cs)]
    table += [(None, 0, "assistant", "x"), (9, None, None, None), (9, None, "assistant", None), (3, 0, "user", "é3-0"), (3, 1, "assistant", "é3-1"), (50, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("other", F.lit("x")).withColumn("turns", F.lit(1))
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(preference.sql())
    got = preference.pairs(preference.with_borrowed_replies(df))
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())
    assert got.count() == len(turns) + 1
    pair = preference.with_borrowed_replies(df).limit(1).withColumn("prompt", F.lit("x"))
    assert preference.pairs(pair.unionByName(pair)).count() == 2


def test_odd_texts_against_sql(spark):
    mit = licenses.SENTENCES["mit_grant"]
    texts = [None, "", " \n", mit + "\n" + mit, mit * 2, "MIT License\n" * 2000 + "x " * 100_000, "# " + licenses.SENTENCES["bsd_grant"], "MIT\nLicense\nMIT License\n", "All rights reserved.\r\nMIT License"]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, mit)], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("sequence", F.lit("x"))
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    got, want = licenses.scan(df), con.sql(licenses.sql())
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())
    assert licenses.scan(df.limit(0)).count() == 0
