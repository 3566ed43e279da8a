"""The engine: queries, direct node reads, writes and metrics over a graph."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes, keys
from ..metrics import Metrics
from ..plans.compiler import COMPAT_LIMIT, Compiler, weight_filter
from ..plans.logical import COMPAT_MIN_WEIGHT
from ..sources.mapping import GraphMapping
from ..sources.store import GraphStore
from .cypher import plan_of
from .query import Query


class Engine:
    """graph: a GraphStore or a GraphMapping. compat: see plans.compiler. hop_limit: edges that a hop takes from each node,
    the lightest first. Writes replace the engine's store by one that has them too; queries made before keep theirs."""

    def __init__(self, spark: SparkSession, graph: GraphStore | GraphMapping | None = None, node_id: int = 1, compat: bool = False, hop_limit: int | None = None) -> None:
        self.spark, self.compat, self.hop_limit = spark, compat, hop_limit
        self.graph = graph if graph is not None else GraphStore(spark, node_id=node_id)
        self.stats = Metrics()

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Engine:
        return cls(spark, GraphStore.open(spark, path, options.pop("node_id", 1)), **options)

    @classmethod
    def from_config(cls, spark: SparkSession, path: str) -> Engine:
        """An engine as a JSON file says: node_id (1), db_path (a saved store; a new one if there is none), compat (false) and
        hop_limit (none). Other keys are passed over; so is a file that is missing or isn't JSON, for the defaults."""
        try:
            with open(path) as f:
                found = json.load(f)
        except (OSError, ValueError):
            found = {}
        options = {k: found[k] for k in ("node_id", "compat", "hop_limit") if k in found}
        at = found.get("db_path")
        if at is not None and spark._jvm.org.apache.hadoop.fs.Path(f"{at}/nodes").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/nodes")):
            return cls.open(spark, at, **options)
        return cls(spark, **options)

    def compiler(self) -> Compiler:
        return Compiler(self.graph, self.compat, self.hop_limit)

    # queries

    def query(self) -> Query:
        return Query(self)

    def cypher(self, text: str) -> DataFrame:
        return self.compiler().compile(plan_of(self, text))

    def execute(self, text: str) -> list[dict]:
        return self.run(self.cypher(text))

    def run(self, df: DataFrame) -> list[dict]:
        start = time.perf_counter()
        rows = [r.asDict() for r in df.collect()]
        self.stats.hop((time.perf_counter() - start) * 1e6 / max(1, len(rows)))
        return rows

    # writes

    def put_node(self, uuid: str, payload: str) -> None:
        self.graph = self.graph.put_node(uuid, payload)

    def put_nodes(self, df: DataFrame) -> None:
        self.graph = self.graph.put_nodes(df)

    def put_json(self, text: str) -> None:
        """Nodes from one JSON object of ids and payloads."""
        self.graph = self.graph.put_json(text)

    def ingest_json_lines(self, path: str) -> None:
        self.graph = self.graph.ingest_json_lines(path)

    def add_edge(self, src: str, label: str, weight: float, dst: str, props: str | None = None) -> None:
        self.graph = self.graph.add_edge(src, label, weight, dst, props)

    def add_edges(self, df: DataFrame) -> None:
        self.graph = self.graph.add_edges(df)

    # direct reads

    def node(self, uuid: str) -> NodeRef:
        """A lazy handle; the node need not exist."""
        return NodeRef(self, uuid)

    def fetch_nodes(self, uuids: list[str] | DataFrame) -> DataFrame:
        return self.graph.fetch_nodes(uuids)

    def nodes_json(self, uuids: list[str]) -> str:
        """One JSON object of the ids that are nodes and their payloads, as text."""
        found = self.fetch_nodes(list(dict.fromkeys(uuids))).where("payload is not null").collect()
        return json.dumps({r["uuid"]: r["payload"] for r in found})

    def neighbors_json(self, uuid: str, label: str, min_weight: float = 0.0) -> str:
        """The ids that a node's edges of a label and at least the weight lead to, by weight and id, as a JSON array."""
        return json.dumps([r["dst"] for r in self.node(uuid).neighbors(label, min_weight).collect()])

    def cache(self) -> None:
        """Keeps the current view in memory; a later write works on a view of its own, so nothing stale is read."""
        self.graph = self.graph.persist()
        self.stats.cached()

    def uncache(self) -> None:
        """Frees what cache kept."""
        self.graph.unpersist()
        self.stats.cached(False)

    def metrics(self, count: bool = True) -> dict:
        """The counters, and with `count` the numbers of nodes and edges."""
        out = self.stats.report()
        if count:
            types = getattr(self.graph, "types", None)
            for r in self.graph.counts().collect():
                kind = "nodes" if r["kind"] == "node" or (types and r["kind"] in types) else "edges"
                out[kind] = out.get(kind, 0) + r["n"]
        return out


class NodeRef:
    """A node by id: everything is read when it is asked for."""

    def __init__(self, engine: Engine, uuid: str) -> None:
        self.engine, self.uuid = engine, uuid

    def to_df(self) -> DataFrame:
        """uuid and payload; no row if there is no such node."""
        self.engine.stats.read()
        return self.engine.fetch_nodes([self.uuid]).where("payload is not null").select("uuid", "payload")

    def attr(self, key: str, kind: str = "string"):
        """The typed value; None if the node, the key or a value of that type is missing."""
        row = self.to_df().select(attributes.typed(attributes.variant(F.col("payload")), key, kind).alias("v")).first()
        return row["v"] if row else None

    def view(self, key: str) -> str:
        row = self.to_df().select(attributes.view(attributes.variant(F.col("payload")), key).alias("v")).first()
        return row["v"] if row else ""

    def has(self, key: str) -> bool:
        row = self.to_df().select(attributes.has(F.col("payload"), key).alias("v")).first()
        return bool(row and row["v"])

    def edges(self, label: str, min_weight: float | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
        """src, label, weight, dst and props, by weight and then the far end's id."""
        graph, compat = self.engine.graph, self.engine.compat
        df = (graph.in_edges() if reverse and compat and hasattr(graph, "in_edges") else graph.edges()).select("src", "label", "weight", "dst", "props")
        near, far = ("dst", "src") if reverse else ("src", "dst")
        df = df.where((F.col(near) == self.uuid) & (F.col("label") == label))
        if min_weight is None and compat:
            min_weight = COMPAT_MIN_WEIGHT
        df = weight_filter(df, ((">=", float(min_weight)),) if min_weight is not None else (), compat)
        limit = limit or self.engine.hop_limit or (COMPAT_LIMIT if compat else None)
        order = keys.format_weight("weight") if compat else F.col("weight")
        df = df.orderBy(order, far)
        return df.limit(limit) if limit else df

    def neighbors(self, label: str, min_weight: float | None = None, limit: int | None = None) -> DataFrame:
        """dst, by weight and then id."""
        return self.edges(label, min_weight, limit).select("dst")

    def in_neighbors(self, label: str, min_weight: float | None = None) -> DataFrame:
        return self.edges(label, min_weight, reverse=True).select("src")

    def neighbor_nodes(self, label: str, min_weight: float | None = None) -> DataFrame:
        """uuid and payload of the neighbours, NULL for ids without node."""
        found = self.neighbors(label, min_weight)
        return found.join(self.engine.graph.nodes().select(F.col("uuid").alias("dst"), "payload"), "dst", "left").select(F.col("dst").alias("uuid"), "payload")


def edge_attr(key: str, kind: str = "string", props: str = "props") -> Column:
    """A typed edge property: under an object "props" of the edge's document, else at its root."""
    parsed = attributes.variant(F.col(props))
    inner = F.try_variant_get(parsed, "$.props", "variant")
    return F.coalesce(attributes.typed(inner, key, kind), attributes.typed(parsed, key, kind))


__all__ = ["Engine", "NodeRef", "edge_attr"]
