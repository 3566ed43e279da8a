"""From a plan to a DataFrame: one equi-join a hop, on native keys, with predicates where Catalyst can push them.

The two modes differ where the engine's stated behaviour and its code do. Intent (default): predicates hold for every
alias, a walk without anchor id starts at all nodes, values come from the alias that is named, weights compare as
numbers and nothing is capped. Compat: only the first anchor id and the last alias's predicates count, values come
from the last node, weights compare as text, scans end at 1000 edges, and missing values are empty strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attributes, keys
from .logical import COMPAT_MIN_WEIGHT, Hop, Plan

COMPAT_LIMIT = 1000


def weight_filter(df: DataFrame, weights: tuple[tuple[str, float], ...], compat: bool) -> DataFrame:
    """Edges whose weight, to four decimals, satisfies all comparisons. A bare bound on the column goes first: it follows
    from the rounded one and reaches the scan."""
    conditions = []
    for op, x in weights:
        x = float(x)
        if compat:
            conditions.append(f"format_string('%012.4f', weight) >= format_string('%012.4f', double('{x}'))")
            continue
        if op in (">=", ">", "="):
            conditions.append(f"weight >= double('{x - 0.0001}')")
        if op in ("<=", "<", "="):
            conditions.append(f"weight <= double('{x + 0.0001}')")
        conditions.append(f"round(weight, 4) {op} round(double('{x}'), 4)")
    return df.where(" AND ".join(conditions)) if conditions else df


def capped(df: DataFrame, limit: int, compat: bool = False) -> DataFrame:
    """Each source's `limit` edges of the least weight, ties by the id they lead to. Capping the edges before the join is
    the same as capping each walk's scan, and is planned as a partial and a final group limit."""
    by = keys.format_weight("weight") if compat else F.col("weight")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(by, "rank"))
    return df.withColumn("rn", rank).where(F.col("rn") <= limit).drop("rn")


class Compiler:
    def __init__(self, graph, compat: bool = False, hop_limit: int | None = None) -> None:
        self.graph, self.compat = graph, compat
        self.hop_limit = COMPAT_LIMIT if compat and hop_limit is None else hop_limit

    def compile(self, plan: Plan) -> DataFrame:
        plan = self._compat(plan) if self.compat else plan.bound()
        df, kinds = self._walk(plan)
        names = list(dict.fromkeys(r.name for r in plan.returns))
        value = lambda n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) if self.compat else F.col(f"`{n}`")
        out = df.select(*[value(n).alias(n) for n in names])
        if plan.order:
            out = out.orderBy(*[F.col(f"`{r.name}`").desc() if down else F.col(f"`{r.name}`").asc() for r, down in plan.order])
        return out if plan.limit is None else out.limit(plan.limit)

    def counts(self, plan: Plan) -> DataFrame:
        """id (native key) of the last node and n_walks. Between hops, walks that stand at one node are one row with their
        number, so that walks don't multiply; predicates on earlier aliases are applied as they are passed."""
        df, _ = self._walk(plan.bound().but(returns=()), counted=True)
        return df.groupBy(F.col("cur").alias("id")).agg(F.sum("m").alias("n_walks"))

    def _compat(self, plan: Plan) -> Plan:
        """The plan as the code would run it."""
        last = plan.hops[-1].alias if plan.hops else None
        anchor = next((e for e in plan.eqs if e.alias == plan.root and e.key == "id"), None)
        kept = tuple(e for e in plan.eqs if plan.hops and e.alias == last)
        hops = tuple(Hop(h.label, tuple((">=", x) for _, x in h.weights), h.alias, h.edge_alias, h.reverse, h.limit) for h in plan.hops)
        return plan.but(eqs=((anchor,) if anchor else ()) + kept, has=(), hops=hops)

    def _walk(self, plan: Plan, counted: bool = False) -> tuple[DataFrame, str | None]:
        graph, compat = self.graph, self.compat
        hops = plan.hops
        anchors = [e.values for e in plan.eqs if e.alias == plan.root and e.key == "id"]
        uuids = None
        for values in anchors:
            uuids = list(values) if uuids is None else [u for u in uuids if u in values]
        first = hops[0] if hops else None
        kind = graph.root_type(uuids, first.label if first else None, first.reverse if first else False)
        root_wanted = self._wanted(plan, plan.root)
        final_alias = hops[-1].alias if hops else plan.root

        if uuids is None and compat:
            frame = graph.node_frame(kind, {})
            df = frame.where(F.lit(False)).select(F.col("id").alias("cur"))
        elif uuids is None or self._filters(plan, plan.root) or root_wanted or not hops:
            if compat and uuids is not None:  # a handle exists whether its node does or not
                df = self._literal(graph.ids(uuids, kind), kind)
                df = self._attach(df, plan, plan.root, kind) if not hops else df
            else:
                df = graph.node_frame(kind, root_wanted)
                if uuids is not None:
                    df = df.where(F.col("id").isin(graph.ids(uuids, kind)))
                df = self._filtered(df, plan, plan.root).withColumnRenamed("id", "cur")
                df = self._ids(df, plan, plan.root, kind)
        else:
            df = None  # the first hop's edges are filtered by the anchor's key themselves
        if df is not None and counted:
            df = df.withColumn("m", F.lit(1).cast("long"))

        for i, hop in enumerate(hops):
            wanted = {f"{hop.edge_alias}.{r.key}": (r.key, "text") for r in plan.returns if hop.edge_alias and r.alias == hop.edge_alias and r.key not in ("weight", "label", "src", "dst")}
            seen = bool(hop.alias) and (not compat or hop.alias == final_alias)
            asked = self._wanted(plan, hop.alias) if seen else {}
            edges, to, have = graph.edge_frame(hop.label, hop.reverse, kind, wanted, compat, asked)
            if df is None:
                edges = edges.where(F.col("src").isin(graph.ids(uuids, kind)))
            edges = weight_filter(edges, hop.weights, compat)
            limit = hop.limit or self.hop_limit
            if limit:
                edges = capped(edges, limit, compat)
            edges = edges.select("src", "dst", *self._edge_columns(plan, hop, kind, to), *[F.col(f"`{n}`") for n in (*wanted, *(n for n in asked if n in have))])
            if have:
                edges = self._filtered(edges, plan, hop.alias)
            if df is None:
                df = edges.withColumnRenamed("dst", "cur").drop("src")
                if counted:
                    df = df.withColumn("m", F.lit(1).cast("long"))
            else:
                df = df.join(edges, df["cur"] == edges["src"]).drop("cur", "src").withColumnRenamed("dst", "cur")
            kind = to
            if counted:
                df = df.groupBy("cur").agg(F.sum("m").alias("m"))
            if seen:
                df = self._attach(df, plan, hop.alias, kind, have)
        return df, kind

    def _literal(self, ids: list, kind: str | None) -> DataFrame:
        typed = "long" if ids and isinstance(ids[0], int) else "string"
        return self.graph.spark.createDataFrame([(i,) for i in ids], f"cur {typed}")

    def _attach(self, df: DataFrame, plan: Plan, alias: str, kind: str | None, have: set[str] = frozenset()) -> DataFrame:
        """Joins the node's attributes that are filtered or returned, but for those that the edges had; a node that isn't
        there keeps its walk, with NULLs, and fails all predicates."""
        wanted = {n: of for n, of in self._wanted(plan, alias).items() if n not in have}
        if wanted:
            nodes = self.graph.node_frame(kind, wanted)
            inner = any(n.startswith(("eq.", "has.")) for n in wanted) and not self.compat
            if inner:
                nodes = self._filtered(nodes, plan, alias)
            df = df.join(nodes, df["cur"] == nodes["id"], "inner" if inner else "left").drop("id")
            if self.compat:
                df = self._filtered(df, plan, alias)
        return self._ids(df, plan, alias, kind)

    def _ids(self, df: DataFrame, plan: Plan, alias: str, kind: str | None) -> DataFrame:
        """Predicates on, and columns of, the id itself."""
        is_root = alias == plan.root
        for e in plan.eqs:
            if e.alias == alias and e.key == "id" and not is_root:
                df = df.where(F.col("cur").isin(self.graph.ids(list(e.values), kind)))
        for r in plan.returns:
            if r.key == "id" and (r.alias == alias or (self.compat and alias == (plan.hops[-1].alias if plan.hops else plan.root))):
                df = df.withColumn(r.name, self.graph.uuid(F.col("cur"), kind))
        return df

    def _wanted(self, plan: Plan, alias: str) -> dict[str, tuple[str, str]]:
        last = plan.hops[-1].alias if plan.hops else plan.root
        out = {f"eq.{alias}.{e.key}": (e.key, "text") for e in plan.eqs if e.alias == alias and e.key != "id"}
        out |= {f"has.{alias}.{h.key}": (h.key, "type") for h in plan.has if h.alias == alias}
        out |= {r.name: (r.key, "text") for r in plan.returns if r.key != "id" and (r.alias == alias if not self.compat else alias == last)}
        return out

    def _filters(self, plan: Plan, alias: str) -> bool:
        return any(e.alias == alias and e.key != "id" for e in plan.eqs) or any(h.alias == alias for h in plan.has)

    def _filtered(self, df: DataFrame, plan: Plan, alias: str) -> DataFrame:
        """The rows that satisfy those of the alias's predicates whose columns are here; the columns go."""
        here = set(df.columns)
        for e in plan.eqs:
            if e.alias == alias and f"eq.{alias}.{e.key}" in here:
                column = F.col(f"`eq.{alias}.{e.key}`").cast("string")
                if self.compat:
                    column = F.coalesce(column, F.lit(""))
                df = df.where(column.isin(list(e.values)) if len(e.values) != 1 else column == e.values[0])
        for h in plan.has:
            if h.alias == alias and f"has.{alias}.{h.key}" in here:
                column = F.col(f"`has.{alias}.{h.key}`")
                found = column.isNotNull() & (column != "null")
                if h.kind is not None:
                    wanted = next((k for k in attributes.JSON_TYPES if attributes.same_type(k, h.kind)), None)
                    if wanted is None:
                        raise ValueError(f"unknown type {h.kind!r}; one of {', '.join(attributes.JSON_TYPES)}")
                    found = column == wanted
                df = df.where(found)
        return df.drop(*[c for c in df.columns if c.startswith((f"eq.{alias}.", f"has.{alias}."))])

    def _edge_columns(self, plan: Plan, hop: Hop, kind: str | None, to: str | None) -> list[Column]:
        if not hop.edge_alias or self.compat:
            return []
        ends = (("dst", to), ("src", kind)) if hop.reverse else (("src", kind), ("dst", to))
        out = []
        for r in plan.returns:
            if r.alias != hop.edge_alias:
                continue
            if r.key == "weight":
                out.append(F.col("weight").alias(r.name))
            elif r.key == "label":
                out.append(F.lit(hop.label).alias(r.name))
            elif r.key in ("src", "dst"):
                column, of = ends[0] if r.key == "src" else ends[1]
                out.append(self.graph.uuid(F.col(column), of).alias(r.name))
        return out


__all__ = ["COMPAT_LIMIT", "COMPAT_MIN_WEIGHT", "Compiler", "capped", "weight_filter"]
