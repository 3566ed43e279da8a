"""The driver's queries over the property graph, built through the engine's API, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import attributes, keys
from .operators.engine import Engine
from .plans.compiler import weight_filter
from .sources.mapping import EdgeType, GraphMapping
from .sources.store import GraphStore
from .tables import engine, graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def renamed(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


@query("SELECT c.c_name AS name FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2 AND c.c_acctbal >= 0.0 AND c.c_mktsegment = 'BUILDING'")
def walk_2hop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("r").where_eq("r", "id", "region_2").out("has_nation").as_("n")
    return renamed(q.out("has_customer", 0.0).as_("c").where_eq("c", "c_mktsegment", "BUILDING").return_("c", "c_name").to_df(), "name")


@query("SELECT p.p_name AS name FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE o.o_custkey = 7 AND o.o_totalprice >= 50000 AND l.l_quantity >= 10")
def walk_2hop_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("c").where_eq("c", "id", "customer_7").out("placed", 50000).as_("o")
    return renamed(q.out("contains", 10).as_("p").return_("p", "p_name").to_df(), "name")


@query("SELECT p.p_name AS part_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE c.c_nationkey = 5 AND p.p_brand = 'Brand#17'")
def walk_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("n").where_eq("n", "id", "nation_5").out("has_customer", None).as_("c")
    q = q.out("placed", None).as_("o").out("contains", None).as_("p").where_eq("p", "p_brand", "Brand#17")
    return renamed(q.return_("p", "p_name").to_df(), "part_name")


@query("SELECT l.l_partkey AS dst, count(*) AS n_walks FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey IN (7, 8, 9) GROUP BY l.l_partkey")
def walk_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("c").where_in("c", "id", ["customer_7", "customer_8", "customer_9"])
    return renamed(q.out("placed").as_("o").out("contains").as_("p").counts(), "dst", "n_walks")


@query("SELECT l2.l_partkey AS dst, count(*) AS n_walks FROM orders o JOIN lineitem l1 ON l1.l_orderkey = o.o_orderkey JOIN lineitem l0 ON l0.l_partkey = l1.l_partkey JOIN lineitem l2 ON l2.l_orderkey = l0.l_orderkey WHERE o.o_custkey = 7 GROUP BY l2.l_partkey")
def walk_4hop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("c").where_eq("c", "id", "customer_7").out("placed").as_("o").out("contains").as_("p")
    return renamed(q.in_("contains").as_("o2").out("contains").as_("p2").counts(), "dst", "n_walks")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def anchor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("c").where_eq("c", "id", "customer_7").return_("c", "c_custkey", "c_name")
    return renamed(q.to_df(), "c_custkey", "c_name")


@query("SELECT CAST(v.pos AS BIGINT) AS pos, c.c_name FROM (SELECT 1 AS pos, 7 AS id UNION ALL SELECT 2, 3 UNION ALL SELECT 3, 7 UNION ALL SELECT 4, -1) v LEFT JOIN customer c ON c.c_custkey = v.id")
def fetch_nodes_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir).fetch_nodes(["customer_7", "customer_3", "customer_7", "customer_-1"])
    return found.select((F.col("pos") + 1).alias("pos"), attributes.text(F.col("payload"), "c_name").alias("c_name"))


@query("SELECT o_orderkey AS dst FROM orders WHERE o_custkey = 7 AND round(o_totalprice, 4) >= round(CAST(50000 AS DOUBLE), 4)")
def hop_min_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query().match("c").where_eq("c", "id", "customer_7").out("placed", 50000).as_("o").return_("o", "o_orderkey").to_df().toDF("dst")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, 'event_' || event_id) AS rn FROM events) x WHERE rn <= 1000")
def hub_fanout_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir, hop_limit=1000).query().match("t").out("emitted", None).as_("e").return_("t", "event_type").return_("e", "event_id")
    return renamed(q.to_df(), "event_type", "event_id")


@query("SELECT n.n_nationkey, c.c_name FROM nation n LEFT JOIN customer c ON c.c_custkey = n.n_nationkey * 100000")
def neighbors_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    far = g.types["nation"].table.select("n_nationkey", (F.col("n_nationkey") * 100000).cast("long").alias("to"))
    g = GraphMapping(spark, list(g.types.values()), [EdgeType("sends_to", "nation", "customer", far, "n_nationkey", "to")])
    return renamed(Engine(spark, g).query().match("n").out("sends_to").as_("c").return_("n", "n_nationkey").return_("c", "c_name").to_df(), "n_nationkey", "c_name")


def _contains(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The lines as an edge log: of an edge's writes the highest line number is the last."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    stamp = F.struct(F.lit(0).cast("long").alias("wall_time"), F.col("l_linenumber").cast("int").alias("logical"), F.lit(1).cast("long").alias("node_id"))
    rows = lines.select(F.col("l_orderkey").alias("src"), F.lit("contains").alias("label"), F.col("l_quantity").alias("weight"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("props"), stamp.alias("ts"))
    return GraphStore(spark, edges=rows)


@query("SELECT l_orderkey, l_partkey, round(l_quantity, 4) AS w, max(l_linenumber) AS ln FROM lineitem GROUP BY 1, 2, 3")
def edge_upsert_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contains(spark, sf_dir).edges().select(F.col("src").alias("l_orderkey"), F.col("dst").alias("l_partkey"), F.col("weight").alias("w"), F.col("props").alias("ln"))


@query("SELECT DISTINCT l_partkey, l_orderkey FROM lineitem")
def in_edge_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contains(spark, sf_dir).in_edges().select(F.col("dst").alias("l_partkey"), F.col("src").alias("l_orderkey"))


@query("SELECT 'out' AS side, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, round(l_quantity, 4) AS w FROM lineitem) x UNION ALL SELECT 'in' AS side, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) y")
def dual_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _contains(spark, sf_dir)
    return store.edges().agg(F.lit("out").alias("side"), F.count("*").alias("n")).unionByName(store.in_edges().agg(F.lit("in").alias("side"), F.count("*").alias("n")))


@query("SELECT user_id, event_type, arg_max(value, row(ts, event_id)) AS v FROM events GROUP BY 1, 2")
def edge_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("wall_time"), F.lit(0).alias("logical"), F.col("event_id").alias("node_id"))
    log = events.select(F.col("user_id").alias("src"), F.lit("did").alias("label"), F.lit(1.0).alias("weight"), F.col("event_type").alias("dst"), F.col("value").alias("props"), stamp.alias("ts"))
    return GraphStore(spark, edges=log).edges().select(F.col("src").alias("user_id"), F.col("dst").alias("event_type"), F.col("props").alias("v"))


@query("SELECT o_orderkey, printf('%012.4f', o_totalprice) AS w FROM orders")
def weight_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", keys.format_weight("o_totalprice").alias("w"))


@query("SELECT o_orderkey, concat('e:out:{customer_', o_custkey, '}:placed:', printf('%012.4f', o_totalprice), ':order_', o_orderkey) AS k FROM orders")
def edge_out_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    src, dst = g.types["customer"].uuid(F.col("o_custkey")), g.types["order"].uuid(F.col("o_orderkey"))
    return g.labels["placed"].table.select("o_orderkey", keys.edge_out_key(src, F.lit("placed"), "o_totalprice", dst).alias("k"))


@query("SELECT o_orderkey, concat('n:{order_', o_orderkey, '}') AS node_key, concat('e:out:{customer_', o_custkey, '}:placed:') AS prefix, concat('e:in:{order_', o_orderkey, '}:placed:customer_', o_custkey) AS in_key FROM orders")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    src, dst, label = g.types["customer"].uuid(F.col("o_custkey")), g.types["order"].uuid(F.col("o_orderkey")), F.lit("placed")
    return g.labels["placed"].table.select("o_orderkey", keys.node_key(dst).alias("node_key"), keys.edge_prefix(src, label).alias("prefix"), keys.edge_in_key(dst, label, src).alias("in_key"))


@query("SELECT c_custkey FROM customer WHERE printf('%012.4f', c_acctbal) >= printf('%012.4f', (-999999.0)::DOUBLE)")
def negative_weight_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, *_ = graph(spark, sf_dir).edge_frame("has_customer", False, "nation", {})
    return weight_filter(edges, ((">=", -999999.0),), compat=True).select(F.col("dst").alias("c_custkey"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def attr_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", attributes.typed(attributes.variant(F.col("props")), "k", "int").alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.zz') IS NOT NULL AS has_zz FROM events")
def attr_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", attributes.typed(attributes.variant(F.col("props")), "k", "int").alias("k"), attributes.has(F.col("props"), "zz").alias("has_zz"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS s FROM events")
def attr_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string view of a key that holds a string in a third of the payloads, a number in another, and is missing in the rest."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    payload = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("v")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("value").alias("v")))).otherwise(F.col("props"))
    return events.select("event_id", attributes.view(attributes.variant(payload), "v").alias("s"))


@query("SELECT o_orderstatus AS status FROM orders WHERE o_custkey = 7 AND o_totalprice >= 50000")
def cypher_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renamed(engine(spark, sf_dir).cypher("MATCH (c {id: 'customer_7'})-[e:placed]->(o) WHERE e.weight >= 50000 RETURN o.o_orderstatus"), "status")


@query("SELECT o_orderpriority AS priority FROM orders WHERE o_custkey = 11 AND o_orderstatus = 'F'")
def cypher_target_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renamed(engine(spark, sf_dir).cypher("MATCH (c {id: 'customer_11'})-[e:placed]->(o {o_orderstatus: 'F'}) RETURN o.o_orderpriority"), "priority")


@query("SELECT o_orderstatus AS status FROM orders WHERE o_custkey = 7 AND printf('%012.4f', o_totalprice) >= printf('%012.4f', 50000::DOUBLE)")
def cypher_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text, where > and what follows are read as the code reads them."""
    text = "MATCH (c {id: 'customer_7', c_mktsegment: 'none'})-[e:placed]->(o) WHERE e.weight > 50000 AND o.x = 1 RETURN o.o_orderstatus"
    return renamed(engine(spark, sf_dir, compat=True).cypher(text), "status")


@query("SELECT o.o_orderkey AS dst FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_custkey = 7 AND c.c_mktsegment = 'MACHINERY'")
def root_predicate_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("c").where_eq("c", "id", "customer_7").where_eq("c", "c_mktsegment", "MACHINERY")
    return renamed(q.out("placed", None).as_("o").return_("o", "o_orderkey").to_df(), "dst")


@query("SELECT l.l_partkey AS dst FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = 7 AND o.o_orderstatus = 'F' AND l.l_quantity >= 10")
def mid_predicate_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("c").where_eq("c", "id", "customer_7").out("placed", None).as_("o").where_eq("o", "o_orderstatus", "F")
    return renamed(q.out("contains", 10).as_("p").return_("p", "p_partkey").to_df(), "dst")


@query("SELECT c.c_name AS cust, o.o_orderkey AS ord, o.o_totalprice AS w FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 5 AND o.o_totalprice >= 300000")
def project_two_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("n").where_eq("n", "id", "nation_5").out("has_customer", None).as_("c").out("placed", 300000).as_("o", edge="e")
    return renamed(q.return_("c", "c_name").return_("o", "o_orderkey").return_("e", "weight").to_df(), "cust", "ord", "w")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')")
def where_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("t").where_eq("t", "id", "click").out("emitted", None).as_("e").where_has("e", "k", "int")
    return renamed(q.return_("e", "event_id").to_df(), "event_id")


@query("SELECT l_partkey AS dst, l_quantity AS weight, l_returnflag AS returnflag, l_linenumber AS line FROM lineitem WHERE l_quantity >= 10")
def edge_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("o").out("contains", 10).as_("p", edge="e")
    return renamed(q.return_("p", "p_partkey").return_("e", "weight", "returnflag", "line").to_df(), "dst", "weight", "returnflag", "line")


@query("SELECT l_orderkey AS src FROM lineitem WHERE l_partkey = 17 AND l_quantity >= 25")
def in_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renamed(engine(spark, sf_dir).query().match("p").where_eq("p", "id", "part_17").in_("contains", 25).as_("o").return_("o", "o_orderkey").to_df(), "src")


@query("SELECT 'customer_7' AS src, 'order_' || o_orderkey AS dst, o_totalprice AS weight, 'placed' AS label FROM orders WHERE o_custkey = 7")
def edge_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("c").where_eq("c", "id", "customer_7").out("placed", None).as_("o", edge="e")
    return renamed(q.return_("e", "src", "dst", "weight", "label").to_df(), "src", "dst", "weight", "label")


@query("SELECT 'customer_' || c_custkey AS uuid, c_name FROM customer WHERE c_nationkey = 3")
def neighbor_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = engine(spark, sf_dir).query().match("n").where_eq("n", "id", "nation_3").out("has_customer", None).as_("c").return_("c", "id", "c_name")
    return renamed(q.to_df(), "uuid", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk without anchor id starts at all nodes of the type that its first hop leaves from; here they are all."""
    q = engine(spark, sf_dir).query().match("n").out("has_customer", None).as_("c").where_eq("c", "c_mktsegment", "BUILDING")
    return renamed(q.return_("c", "c_custkey", "c_name").to_df(), "c_custkey", "c_name")


@query("SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT 'placed', count(*) FROM orders UNION ALL SELECT 'contains', count(*) FROM lineitem")
def metrics_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    kept = GraphMapping(spark, [g.types[t] for t in ("customer", "order")], [g.labels[x] for x in ("placed", "contains")])
    return kept.counts()


@query("SELECT CAST(count(*) AS BIGINT) AS n_edges, count(DISTINCT o_custkey) AS n_sources FROM orders")
def one_hop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop from all anchors of a type: the throughput query."""
    edges, *_ = graph(spark, sf_dir).edge_frame("placed", False, "customer", {})
    return edges.agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_sources"))


@query("SELECT 'customer_' || c_custkey AS uuid, true AS same, true AS known, true AS balanced FROM customer")
def owner_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's owner: the same one by number of owners and by their ids, one of them, and none has twice its share."""
    t = graph(spark, sf_dir).types["customer"]
    uuid = t.uuid(F.col("c_custkey"))
    owned = t.table.select(uuid.alias("uuid"), keys.owner(uuid, 8).alias("owner"), keys.owner(uuid, [17, 12, 11, 13, 10, 14, 16, 15]).alias("named"))
    shares = owned.groupBy("owner").agg(F.count("*").alias("n")).select("owner", (F.col("n") * 8 < 2 * F.sum("n").over(Window.partitionBy())).alias("balanced"))  # eight rows
    return owned.join(F.broadcast(shares), "owner").select("uuid", (F.col("named") == F.col("owner") + 10).alias("same"), F.col("owner").between(0, 7).alias("known"), "balanced")


@query("SELECT o_custkey, true AS placed, 1 AS bits, true AS unset FROM orders GROUP BY o_custkey")
def label_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's label filter: what it says of its edges' label, how many bits it has, and that an empty one excludes nothing."""
    bits = graph(spark, sf_dir).labels["placed"].table.groupBy("o_custkey").agg(F.bit_or(keys.bloom_bit(F.lit("placed"))).alias("bloom"))
    return bits.select("o_custkey", keys.might_have_edge("bloom", "placed").alias("placed"), F.bit_count("bloom").cast("int").alias("bits"), keys.might_have_edge(F.lit(0).cast("long"), "contains").alias("unset"))


@query("SELECT 'customer_' || c_custkey AS uuid, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END AS v FROM customer")
def node_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of node writes without stamps, the second with two writes of each node: the last one is read."""
    t = graph(spark, sf_dir).types["customer"]
    uuid = t.uuid(F.col("c_custkey")).alias("uuid")
    write = lambda df, v: df.select(uuid, F.to_json(F.struct(v.cast("long").alias("v"))).alias("payload"))
    table = t.table.repartition(7)
    twice = table.where("c_custkey % 2 = 0").withColumn("n", F.explode(F.array(F.lit(2), F.lit(3))))
    store = GraphStore(spark).put_nodes(write(table, F.lit(1))).put_nodes(write(twice, F.col("n")))
    return store.nodes().select("uuid", attributes.typed(attributes.variant(F.col("payload")), "v", "int").cast("int").alias("v"))


def _lines(spark: SparkSession, sf_dir: str) -> GraphStore:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lines.select(F.concat(F.lit("order_"), "l_orderkey").alias("src"), F.lit("contains").alias("label"), F.col("l_quantity").alias("weight"), F.concat(F.lit("part_"), "l_partkey").alias("dst"))
    return GraphStore(spark).add_edges(rows)


@query("SELECT 'order_' || l_orderkey AS src FROM (SELECT DISTINCT l_orderkey, round(l_quantity, 4) AS w FROM lineitem WHERE l_partkey = 17 AND l_quantity >= 25) x")
def store_in_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backwards over a store's edges: the same ones that lead there forwards, with all their weights."""
    q = Engine(spark, _lines(spark, sf_dir)).query().match("p").where_eq("p", "id", "part_17").in_("contains", 25).as_("o")
    return q.return_("o", "id").to_df().toDF("src")


@query("SELECT dst, w FROM (SELECT DISTINCT 'part_' || l_partkey AS dst, round(l_quantity, 4) AS w FROM lineitem WHERE l_orderkey = 7 AND l_quantity >= 10) x")
def store_out_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Engine(spark, _lines(spark, sf_dir)).query().match("o").where_eq("o", "id", "order_7").out("contains", 10).as_("p", edge="e")
    return renamed(q.return_("p", "id").return_("e", "weight").to_df(), "dst", "w")


@query("SELECT o_orderkey, o_totalprice AS w FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def order_and_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty heaviest edges of a label: a top-k report."""
    q = engine(spark, sf_dir).query().match("c").out("placed", None).as_("o", edge="e").return_("o", "o_orderkey").return_("e", "weight")
    return renamed(q.order_by("e", "weight", descending=True).order_by("o", "o_orderkey").limit(20).to_df(), "o_orderkey", "w")


@query()
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into an edge log in micro-batches, and the latest write of each edge."""
    import tempfile
    from uuid import uuid4

    from .streaming.ingest import ingest_edges

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="wendgraph-")
    at = f"{base}/stream-{uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    stamp = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("wall_time"), F.lit(0).alias("logical"), F.col("event_id").alias("node_id"))
    rows = events.select(F.concat(F.lit("user_"), F.col("user_id")).alias("src"), F.lit("did").alias("label"), F.lit(1.0).alias("weight"), F.col("event_type").alias("dst"), F.to_json(F.struct("value")).alias("props"), stamp.alias("ts"))
    ingest_edges(rows, at, f"{at}-checkpoint").awaitTermination()
    from .sources.model import EDGES

    log = spark.read.schema(EDGES).parquet(f"{at}/edges").select(EDGES.names)
    found = GraphStore(spark, edges=log).edges()
    return found.select("src", "dst", attributes.typed(attributes.variant(F.col("props")), "value", "double").alias("v"))


SQL["stream_ingest"] = "SELECT 'user_' || user_id AS src, event_type AS dst, arg_max(value, row(ts, event_id)) AS v FROM events GROUP BY 1, 2"
