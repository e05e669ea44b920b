"""Networks derived from the star-schema tables.

* trade graph: nations, an arc per (supplier nation, customer nation),
* bipartite graph: suppliers and parts,
* planar points: the first two embedding components, streets along equal labels,
* event timeline: users' event values by day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftnet.plans.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arc_id, src_node, dst_node, cost, qty, cap): no self loops; one row per ordered pair of nations."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst_node"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src_node"))
    joined = (
        line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
        .join(orders, line["l_orderkey"] == orders["o_orderkey"])
        .join(customer, orders["o_custkey"] == customer["c_custkey"])
        .filter("src_node <> dst_node")
    )
    pairs = joined.groupBy("src_node", "dst_node").agg(
        F.min(F.round("l_extendedprice").cast("long")).alias("cost"), F.sum("l_quantity").cast("long").alias("qty")
    )
    # a row per pair of nations: ordered in one task, whatever the size of the fact tables
    order = Window.partitionBy(F.lit(0)).orderBy("src_node", "dst_node")
    numbered = pairs.withColumn("arc_id", F.row_number().over(order).cast("long") - 1)
    return stage(numbered.select("arc_id", "src_node", "dst_node", "cost", "qty", F.expr("qty div 2").alias("cap")))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("region"))


def trade_commodities(arcs: DataFrame, step: int = 5) -> DataFrame:
    """(k, src, dst, demand): a commodity for each arc out of a nation that ``step`` divides; 1 takes all arcs."""
    some = arcs.filter(F.col("src_node") % step == 0)
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("arc_id")).cast("long") - 1
    return some.select(k.alias("k"), F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), (F.col("qty") % 50 + 1).alias("demand"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v): suppliers 2k and parts 2k + 1 that occur together."""
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_suppkey") * 2).alias("u"), (F.col("l_partkey") * 2 + 1).alias("v")).distinct()


def planar_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, label)."""
    e = table(spark, sf_dir, "embeddings")
    x, y = (F.get("embedding", F.lit(k)).cast("double") * 1000 for k in (0, 1))
    return e.select(F.col("vec_id").alias("id"), x.alias("x"), y.alias("y"), "label")


def planar_streets(points: DataFrame) -> DataFrame:
    """(edge_id, u, v, ux, uy, vx, vy, len_m): consecutive points of labels 5 to 9."""
    w = Window.partitionBy("label").orderBy("id")
    nxt = points.filter("label >= 5").select(
        F.col("id").alias("u"), F.lead("id").over(w).alias("v"), F.col("x").alias("ux"), F.col("y").alias("uy"),
        F.lead("x").over(w).alias("vx"), F.lead("y").over(w).alias("vy"),
    )
    length = F.sqrt((F.col("vx") - F.col("ux")) ** 2 + (F.col("vy") - F.col("uy")) ** 2)
    return nxt.filter("v is not null").select(F.col("u").alias("edge_id"), "u", "v", "ux", "uy", "vx", "vy", length.alias("len_m"))


def planar_demand(points: DataFrame) -> DataFrame:
    """(poi, x, y, demand)."""
    return points.filter("label <= 4").select(F.col("id").alias("poi"), "x", "y", (F.col("label") + 1).cast("double").alias("demand"))


def event_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, k, qty): whole units of event value per day and user."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(day.alias("t"), F.col("user_id").alias("k")).agg(F.sum(F.floor("value")).cast("long").alias("qty"))
