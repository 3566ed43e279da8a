"""Typed tables seen as a graph: attributes are columns, and ids are decoded to keys when a query is planned."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes

_KINDS = {"string": "string", "int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "double": "double", "float": "double", "boolean": "bool"}


@dataclass(frozen=True)
class NodeType:
    """Nodes of a table: uuid is the prefix, "_" and the key, or the key alone if the prefix is empty. Attributes are the
    columns, and the keys of the JSON column `payload` where there is one. Keys are unique and not null."""

    name: str
    source: DataFrame | Callable[[], DataFrame]  # a function opens the table when it is first asked for
    key: str
    prefix: str | None = None
    payload: str | None = None

    @functools.cached_property
    def table(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()

    def uuid(self, key: Column) -> Column:
        return key.cast("string") if self.prefix == "" else F.concat(F.lit((self.prefix or self.name) + "_"), key.cast("string"))

    def decode(self, uuid: str):
        """The key of an id of this type, typed as the column, so that it reaches the scan as a plain predicate; None for
        ids of other types."""
        if self.prefix != "":
            head = (self.prefix or self.name) + "_"
            if not uuid.startswith(head):
                return None
            uuid = uuid[len(head) :]
        kind = self.table.schema[self.key].dataType.simpleString()
        if _KINDS.get(kind) == "int":
            return int(uuid) if uuid.lstrip("-").isdecimal() and str(int(uuid)) == uuid else None
        return uuid


@dataclass(frozen=True)
class EdgeType:
    """Edges of a table. complete: src and dst are foreign keys, so that both ends are nodes."""

    label: str
    src_type: str
    dst_type: str
    source: DataFrame | Callable[[], DataFrame]
    src: str
    dst: str
    weight: str | None = None
    props: dict[str, str] = field(default_factory=dict)
    complete: bool = False

    @functools.cached_property
    def table(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()


class GraphMapping:
    """Node and edge types over tables. A label's tables are the only ones that a hop reads, and hops join on native keys."""

    def __init__(self, spark: SparkSession, nodes: list[NodeType], edges: list[EdgeType]) -> None:
        self.spark = spark
        self.types = {t.name: t for t in nodes}
        self.labels = {e.label: e for e in edges}

    def root_type(self, uuids: list[str] | None, label: str | None, reverse: bool) -> str | None:
        if label is not None:
            e = self.labels.get(label)
            return None if e is None else e.dst_type if reverse else e.src_type
        for t in sorted(self.types.values(), key=lambda t: t.prefix == ""):
            if uuids and all(t.decode(u) is not None for u in uuids):
                return t.name
        return None

    def ids(self, uuids: list[str], kind: str | None) -> list:
        found = [self.types[kind].decode(u) for u in uuids] if kind else []
        return list(dict.fromkeys(x for x in found if x is not None))

    def uuid(self, column: Column, kind: str | None) -> Column:
        return self.types[kind].uuid(column) if kind else column.cast("string")

    def node_frame(self, kind: str | None, wanted: dict[str, tuple[str, str]]) -> DataFrame:
        if kind is None:
            return self.spark.createDataFrame([], "id string, " + ", ".join(f"{n} string" for n in wanted) if wanted else "id string")
        t = self.types[kind]
        return t.table.select(F.col(t.key).alias("id"), *[self._attribute(t, *of).alias(n) for n, of in wanted.items()])

    def _attribute(self, t: NodeType, key: str, how: str) -> Column:
        """A column of the type's table: an attribute as "text" or its JSON "type"."""
        if key in t.table.columns and key != t.payload:
            of = _KINDS.get(t.table.schema[key].dataType.simpleString(), "string")
            return F.col(key) if how == "text" else F.when(F.col(key).isNotNull(), F.lit(of))
        if t.payload is not None:
            payload = F.col(t.payload)
            return attributes.text(payload, key) if how == "text" else attributes.json_type(attributes.variant(payload), key)
        return F.lit(None).cast("string")

    def edge_frame(self, label: str, reverse: bool, kind: str | None, wanted: dict[str, tuple[str, str]], compat: bool = False, nodes: dict[str, tuple[str, str]] | None = None) -> tuple[DataFrame, str | None, set[str]]:
        """src, dst, weight and the wanted properties, in the direction of the walk; the type it leads to; and which of the
        far nodes' attributes asked for are among the columns: all where the edges' table is the nodes' own, so that no
        table is joined with itself, and the key where every edge leads to a node."""
        e = self.labels.get(label)
        if e is None or (kind is not None and kind != (e.dst_type if reverse else e.src_type)):
            return self.spark.createDataFrame([], "src string, dst string, weight double, rank string" + "".join(f", {n} string" for n in wanted)), None, set()
        a, b, to = (e.dst, e.src, e.src_type) if reverse else (e.src, e.dst, e.dst_type)
        t = self.types[to]
        weight = F.col(e.weight).cast("double") if e.weight else F.lit(1.0)
        props = [(F.col(e.props[k]) if k in e.props else F.lit(None).cast("string")).alias(n) for n, (k, _) in wanted.items()]
        own = b == t.key and e.table is t.table
        found = {n: self._attribute(t, key, how) if own else F.col(b) for n, (key, how) in (nodes or {}).items() if own or (e.complete and key == t.key and how == "text")}
        return e.table.select(F.col(a).alias("src"), F.col(b).alias("dst"), weight.alias("weight"), t.uuid(F.col(b)).alias("rank"), *props, *[c.alias(n) for n, c in found.items()]), to, set(found)

    def nodes(self) -> DataFrame:
        """All nodes as uuid and payload."""
        out = None
        for t in self.types.values():
            df = t.table.select(t.uuid(F.col(t.key)).alias("uuid"), F.to_json(F.struct(*t.table.columns)).alias("payload"))
            out = df if out is None else out.unionByName(df)
        return out

    def edges(self) -> DataFrame:
        """All edges as src, label, weight, dst and props."""
        out = None
        for e in self.labels.values():
            weight = F.col(e.weight).cast("double") if e.weight else F.lit(1.0)
            props = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in e.props.items()])) if e.props else F.lit(None).cast("string")
            df = e.table.select(self.types[e.src_type].uuid(F.col(e.src)).alias("src"), F.lit(e.label).alias("label"), weight.alias("weight"), self.types[e.dst_type].uuid(F.col(e.dst)).alias("dst"), props.alias("props"))
            out = df if out is None else out.unionByName(df)
        return out

    def fetch_nodes(self, uuids: list[str] | DataFrame) -> DataFrame:
        """pos, uuid and payload in the order asked for, with repeats; payload is NULL for ids without node. Ids given as
        a list are decoded here, so that only their types' tables are read, by key."""
        if isinstance(uuids, DataFrame):
            return uuids.join(self.nodes(), "uuid", "left").select("pos", "uuid", "payload").orderBy("pos")
        asked = self.spark.createDataFrame(list(enumerate(uuids)), "pos long, uuid string")
        found = None
        for t in self.types.values():
            keys = [k for k in (t.decode(u) for u in dict.fromkeys(uuids)) if k is not None]
            if keys:
                df = t.table.where(F.col(t.key).isin(keys)).select(t.uuid(F.col(t.key)).alias("uuid"), F.to_json(F.struct(*t.table.columns)).alias("payload"))
                found = df if found is None else found.unionByName(df)
        if found is None:
            found = self.spark.createDataFrame([], "uuid string, payload string")
        return asked.join(found, "uuid", "left").select("pos", "uuid", "payload").orderBy("pos")

    def counts(self) -> DataFrame:
        """kind (a node type or an edge label) and n."""
        out = None
        for name, table in [*((t.name, t.table) for t in self.types.values()), *((e.label, e.table) for e in self.labels.values())]:
            df = table.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
            out = df if out is None else out.unionByName(df)
        return out
