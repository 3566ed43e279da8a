"""The property graph over the driver's tables."""

from __future__ import annotations

import functools
import weakref

from pyspark.sql import DataFrame, SparkSession

from .operators.engine import Engine
from .sources.mapping import EdgeType, GraphMapping, NodeType

_OPENED: weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = weakref.WeakKeyDictionary()


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, opened once in a session: its schema isn't read again, nor are its files listed again, until forget."""
    known = _OPENED.setdefault(spark, {})
    if path not in known:
        known[path] = spark.read.parquet(path)
    return known[path]


def forget(spark: SparkSession) -> None:
    """Tables that have been written anew are opened anew."""
    _OPENED.pop(spark, None)


def graph(spark: SparkSession, sf_dir: str) -> GraphMapping:
    t = lambda name: functools.partial(opened, spark, f"{sf_dir}/{name}.parquet")
    kinds = lambda: opened(spark, f"{sf_dir}/events.parquet").select("event_type").distinct()
    nodes = [
        NodeType("region", t("region"), "r_regionkey"),
        NodeType("nation", t("nation"), "n_nationkey"),
        NodeType("customer", t("customer"), "c_custkey"),
        NodeType("supplier", t("supplier"), "s_suppkey"),
        NodeType("part", t("part"), "p_partkey"),
        NodeType("order", t("orders"), "o_orderkey"),
        NodeType("event", t("events"), "event_id", payload="props"),
        NodeType("event_type", kinds, "event_type", prefix=""),
    ]
    edges = [
        EdgeType("has_nation", "region", "nation", t("nation"), "n_regionkey", "n_nationkey", complete=True),
        EdgeType("has_customer", "nation", "customer", t("customer"), "c_nationkey", "c_custkey", "c_acctbal", complete=True),
        EdgeType("has_supplier", "nation", "supplier", t("supplier"), "s_nationkey", "s_suppkey", "s_acctbal", complete=True),
        EdgeType("placed", "customer", "order", t("orders"), "o_custkey", "o_orderkey", "o_totalprice", complete=True),
        EdgeType("contains", "order", "part", t("lineitem"), "l_orderkey", "l_partkey", "l_quantity", {"returnflag": "l_returnflag", "discount": "l_discount", "line": "l_linenumber"}, complete=True),
        EdgeType("emitted", "event_type", "event", t("events"), "event_type", "event_id", "value", complete=True),
    ]
    return GraphMapping(spark, nodes, edges)


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(spark, graph(spark, sf_dir), **options)
