"""A graph of JSON nodes and labelled, weighted edges, as append logs with a last-write-wins view."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes, keys
from .model import EDGES, NODES, Clock, stamped, typed


class GraphStore:
    """Immutable handles on a node log and an edge log: a write gives the store that has it too, and costs nothing until
    it is read or saved. Reads see the latest write of each node (by uuid) and edge (by src, label, weight to four
    decimals, dst); a write with an older stamp changes nothing. Single writes are kept as rows on the driver and become
    one table when they are read."""

    def __init__(self, spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None, node_id: int = 1, clock: Clock | None = None) -> None:
        self.spark, self.clock = spark, clock or Clock(node_id)
        self._saved: dict[str, DataFrame] = {}  # what an opened store had, by log
        self._new: dict[str, tuple[DataFrame, ...]] = {"nodes": (typed(nodes),) if nodes is not None else (), "edges": (typed(edges),) if edges is not None else ()}
        self._rows: dict[str, tuple[list, int]] = {"nodes": ([], 0), "edges": ([], 0)}  # single writes, shared by later stores, and how many are this one's
        self._latest: dict[str, DataFrame] = {}  # views that are known already

    # sources and sinks

    @classmethod
    def open(cls, spark: SparkSession, path: str, node_id: int = 1) -> GraphStore:
        """The store saved under a path."""
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}").select(schema.names)
        store = cls(spark, node_id=node_id)
        store._saved = {"nodes": read("nodes", NODES), "edges": read("edges", EDGES)}
        return store

    @classmethod
    def open_tables(cls, spark: SparkSession, nodes: str, edges: str, node_id: int = 1) -> GraphStore:
        """The view that save_tables wrote, as a store whose reads need no aggregation and whose hops from src none of
        the edges' shuffle; writes give a store that has them too, and aggregates."""
        store = cls(spark, node_id=node_id)
        store._saved = {"nodes": spark.table(nodes), "edges": spark.table(edges)}
        store._latest = dict(store._saved)
        return store

    def save(self, path: str) -> None:
        """Appends what was written since the store was opened, as one batch: nodes, and edges in a folder for each label, so
        that a hop reads its label's only. A label's hot sources are spread over tasks."""
        batch = f"batch=save-{uuid4().hex}"
        self._log("nodes", saved=False).write.parquet(f"{path}/nodes/{batch}")
        edges = self._log("edges", saved=False).repartition("label", "src", F.pmod(F.xxhash64("dst"), F.lit(16)))
        edges.sortWithinPartitions("label", "src", "weight").write.partitionBy("label").parquet(f"{path}/edges/{batch}")

    def compact(self, path: str) -> GraphStore:
        """Writes the current view as a saved store of its own, each node and edge once, and opens it."""
        batch = f"batch=compact-{uuid4().hex}"
        self.nodes().write.parquet(f"{path}/nodes/{batch}")
        self.edges().sortWithinPartitions("label", "src", "weight").write.partitionBy("label").parquet(f"{path}/edges/{batch}")
        return GraphStore.open(self.spark, path, self.clock.node_id)

    def save_tables(self, nodes: str, edges: str, buckets: int = 200) -> None:
        """Writes the current view as bucketed tables, by uuid and src, so that hops join without a shuffle of edges."""
        self.nodes().write.bucketBy(buckets, "uuid").sortBy("uuid").mode("overwrite").saveAsTable(nodes)
        self.edges().write.bucketBy(buckets, "src").sortBy("src", "weight").mode("overwrite").saveAsTable(edges)

    def _log(self, name: str, saved: bool = True) -> DataFrame:
        """All writes of a log, or those since it was opened."""
        schema = NODES if name == "nodes" else EDGES
        parts = list(self._new[name])
        if saved and name in self._saved:
            parts.insert(0, self._saved[name])
        rows, n = self._rows[name]
        if n or not parts:
            parts.append(self.spark.createDataFrame(rows[:n], schema))
        out = parts[0]
        for df in parts[1:]:
            out = out.unionByName(df)
        return out

    @property
    def node_log(self) -> DataFrame:
        return self._log("nodes")

    @property
    def edge_log(self) -> DataFrame:
        return self._log("edges")

    def _copy(self) -> GraphStore:
        store = GraphStore(self.spark, clock=self.clock)
        store._saved, store._new, store._rows, store._latest = self._saved, dict(self._new), dict(self._rows), dict(self._latest)
        return store

    def _with(self, name: str, df: DataFrame | None = None, row: tuple | None = None) -> GraphStore:
        store = self._copy()
        store._latest.pop(name, None)
        if df is not None:
            store._new[name] = (*self._new[name], df)
        else:
            rows, n = self._rows[name]
            if n != len(rows):  # another store went on from here: the rows part
                rows = rows[:n]
            rows.append(row)
            store._rows[name] = (rows, n + 1)
        return store

    def put_node(self, uuid: str, payload: str) -> GraphStore:
        return self._with("nodes", row=(uuid, payload, self.clock.stamp()))

    def put_nodes(self, df: DataFrame) -> GraphStore:
        """From uuid and payload (JSON); ts where the rows have their own stamps, else a later row of a partition wins."""
        return self._with("nodes", stamped(df.select("uuid", "payload", *[c for c in ("ts",) if c in df.columns]), self.clock))

    def put_json(self, text: str) -> GraphStore:
        """Nodes from one JSON object of ids and payloads, the form of a batch write."""
        one = self.spark.createDataFrame([(text,)], "text string").select(F.explode(F.from_json("text", "map<string,string>")).alias("uuid", "payload"))
        return self.put_nodes(one.where("payload is not null"))

    def add_edge(self, src: str, label: str, weight: float, dst: str, props: str | None = None) -> GraphStore:
        return self._with("edges", row=(src, label, float(weight), dst, props or None, self.clock.stamp()))

    def add_edges(self, df: DataFrame) -> GraphStore:
        """From src, label, weight, dst; props and ts where there are any."""
        props = F.col("props").cast("string") if "props" in df.columns else F.lit(None).cast("string")
        rows = df.select("src", "label", F.col("weight").cast("double").alias("weight"), "dst", props.alias("props"), *[c for c in ("ts",) if c in df.columns])
        return self._with("edges", stamped(rows, self.clock))

    def ingest_json_lines(self, path: str) -> GraphStore:
        """Lines with uuid and payload are nodes, lines with src, label, weight, dst and props are edges. Other lines are left
        out."""
        raw = self.spark.read.text(path).select(F.try_parse_json("value").alias("v"))
        get = lambda k, t: F.try_variant_get("v", f"$.{k}", t).alias(k)
        as_json = lambda k: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) == "STRING", F.try_variant_get("v", f"$.{k}", "string")).otherwise(F.to_json(F.try_variant_get("v", f"$.{k}", "variant"))).alias(k)
        nodes = raw.select(get("uuid", "string"), as_json("payload")).where("uuid is not null")
        edges = raw.select(get("src", "string"), get("label", "string"), get("weight", "double"), get("dst", "string"), as_json("props")).where("src is not null and dst is not null")
        return self.put_nodes(nodes).add_edges(edges)

    # views

    def nodes(self) -> DataFrame:
        """uuid, payload, ts of each node's latest write."""
        if "nodes" in self._latest:
            return self._latest["nodes"]
        last = self.node_log.groupBy("uuid").agg(F.max_by(F.struct("payload", "ts"), "ts").alias("x"))
        return last.select("uuid", "x.payload", "x.ts")

    def edges(self) -> DataFrame:
        """Out-edges: the latest write of each src, label, weight (four decimals) and dst."""
        if "edges" in self._latest:
            return self._latest["edges"]
        last = self.edge_log.groupBy("src", "label", keys.quantized("weight").alias("weight"), "dst").agg(F.max_by(F.struct("props", "ts"), "ts").alias("x"))
        return last.select("src", "label", "weight", "dst", "x.props", "x.ts")

    def in_edges(self) -> DataFrame:
        """In-edge records: the latest write of each dst, label and src, over all weights."""
        last = self.edge_log.groupBy("dst", "label", "src").agg(F.max_by(F.struct("weight", "props", "ts"), "ts").alias("x"))
        return last.select("src", "label", keys.quantized("x.weight").alias("weight"), "dst", "x.props", "x.ts")

    def persist(self) -> GraphStore:
        """The same store with its views kept in memory until unpersist; later writes give stores of their own, so they are
        never stale."""
        store = self._copy()
        store._latest = {"nodes": self.nodes().persist(), "edges": self.edges().persist()}
        return store

    def unpersist(self) -> None:
        for df in self._latest.values():
            df.unpersist()
        self._latest = {}

    # what the compiler asks of a graph

    def root_type(self, uuids: list[str] | None, label: str | None, reverse: bool) -> None:
        return None

    def ids(self, uuids: list[str], kind: None) -> list[str]:
        return list(dict.fromkeys(uuids))

    def uuid(self, column: Column, kind: None) -> Column:
        return column

    def node_frame(self, kind: None, wanted: dict[str, tuple[str, str]]) -> DataFrame:
        """id and the wanted columns: name -> (key, "text" or "type"). The payload is parsed once."""
        df = self.nodes().select(F.col("uuid").alias("id"), "payload")
        if any(how == "type" for _, how in wanted.values()):
            df = df.withColumn("parsed", attributes.variant(F.col("payload")))
        return df.select("id", *[(attributes.text(F.col("payload"), k) if how == "text" else attributes.json_type(F.col("parsed"), k)).alias(n) for n, (k, how) in wanted.items()])

    def edge_frame(self, label: str, reverse: bool, kind: None, wanted: dict[str, tuple[str, str]], compat: bool = False, nodes: dict[str, tuple[str, str]] | None = None) -> tuple[DataFrame, None, set[str]]:
        """src, dst, weight and the wanted properties, in the direction of the walk; the type it leads to; and which of the
        far nodes' attributes asked for are among the columns: none. Backwards, a walk takes every edge, as forwards; compat
        has the in-edge records, which keep one weight."""
        df = (self.in_edges() if reverse and compat else self.edges()).where(F.col("label") == label)
        a, b = ("dst", "src") if reverse else ("src", "dst")
        props = F.col("props")
        return df.select(F.col(a).alias("src"), F.col(b).alias("dst"), "weight", F.col(b).alias("rank"), *[attributes.text(props, k).alias(n) for n, (k, _) in wanted.items()]), None, set()

    # direct reads

    def fetch_nodes(self, uuids: list[str] | DataFrame) -> DataFrame:
        """pos, uuid and payload in the order asked for, with repeats; payload is NULL for ids without node."""
        if not isinstance(uuids, DataFrame):
            uuids = self.spark.createDataFrame(list(enumerate(uuids)), "pos long, uuid string")
        return uuids.join(self.nodes().select("uuid", "payload"), "uuid", "left").select("pos", "uuid", "payload").orderBy("pos")

    def counts(self) -> DataFrame:
        """kind ("node" or an edge label) and n."""
        return self.nodes().agg(F.lit("node").alias("kind"), F.count("*").alias("n")).unionByName(self.edges().groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")))
