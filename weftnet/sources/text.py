"""Text formats: instances, street graphs, points, results. Lines are split at blanks; ``c`` starts a comment.

Scans read through Spark, so any store it knows will do; ids are ordinals, given by
the order of a file's lines. Sinks that must keep an
order write one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftnet.plans.staging import stage


class BadFile(ValueError):
    """A file breaks its format: an unknown tag, a wrong count, an id out of range."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, tag, f): numbered lines without comments; f are the fields after the tag."""
    # the reader's parts keep the order of a file's lines; their sizes give each its first number
    raw = spark.read.text(path).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id())
    raw = stage(raw)
    counts = raw.groupBy("_part").agg(F.count("*").alias("n"))
    first = counts.select("_part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy("_in")).cast("long") + F.col("first") - 1
    fields = F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " ")
    rows = raw.join(first, "_part").select(number.alias("line_no"), fields.alias("all"))
    rows = rows.select("line_no", F.get("all", F.lit(0)).alias("tag"), F.slice("all", 2, 1000).alias("f"))
    return rows.filter((F.col("tag") != "") & ~F.col("tag").startswith("c"))


def _field(k: int, kind: str) -> Column:
    return F.get("f", F.lit(k)).cast(kind)


def _expect(ok: bool, what: str) -> None:
    if not ok:
        raise BadFile(what)


def read_instance(spark: SparkSession, path: str) -> tuple[int, DataFrame, DataFrame]:
    """(nodes, arcs, commodities) of ``p nodes arcs commodities``, ``a tail head cost cap``, ``k src dst demand``; cap below 0 is none."""
    rows = stage(lines(spark, path).withColumn("id", F.row_number().over(Window.partitionBy("tag").orderBy("line_no")).cast("long") - 1))
    tags = {r["tag"]: r["n"] for r in rows.groupBy("tag").agg(F.count("*").alias("n")).limit(20).collect()}
    _expect(set(tags) <= {"p", "a", "k"}, f"unknown tags {sorted(set(tags) - {'p', 'a', 'k'})}")
    _expect(tags.get("p") == 1, "one p line is needed")
    n, m, k = (int(x) for x in rows.filter("tag = 'p'").first()["f"][:3])
    _expect((tags.get("a", 0), tags.get("k", 0)) == (m, k), "counts differ from the p line")
    cap = F.when(_field(3, "double") >= 0, _field(3, "double"))
    arcs = rows.filter("tag = 'a'").select(F.col("id").alias("arc_id"), _field(0, "long").alias("src_node"), _field(1, "long").alias("dst_node"), _field(2, "double").alias("cost"), cap.alias("cap"))
    coms = rows.filter("tag = 'k'").select(F.col("id").alias("k"), _field(0, "long").alias("src"), _field(1, "long").alias("dst"), _field(2, "double").alias("demand"))
    outside = arcs.filter(f"not (src_node between 0 and {n - 1} and dst_node between 0 and {n - 1})")
    _expect(outside.isEmpty() and coms.filter(f"not (src between 0 and {n - 1} and dst between 0 and {n - 1})").isEmpty(), "a node id is out of range")
    return n, arcs, coms


def read_street_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, lon, lat, midblock) and arcs (arc_id, src_node, dst_node, cost) of ``g nodes arcs``, ``v id lon lat [m]``, ``e tail head meters``."""
    rows = stage(lines(spark, path).withColumn("id", F.row_number().over(Window.partitionBy("tag").orderBy("line_no")).cast("long") - 1))
    tags = {r["tag"]: r["n"] for r in rows.groupBy("tag").agg(F.count("*").alias("n")).limit(20).collect()}
    _expect(set(tags) <= {"g", "v", "e"} and tags.get("g") == 1, "one g line and only v and e lines beside it are allowed")
    n, m = (int(x) for x in rows.filter("tag = 'g'").first()["f"][:2])
    _expect((tags.get("v", 0), tags.get("e", 0)) == (n, m), "counts differ from the g line")
    nodes = rows.filter("tag = 'v'").select(_field(0, "long").alias("node"), _field(1, "double").alias("lon"), _field(2, "double").alias("lat"), F.coalesce(_field(3, "string") == "m", F.lit(False)).alias("midblock"))
    arcs = rows.filter("tag = 'e'").select(F.col("id").alias("arc_id"), _field(0, "long").alias("src_node"), _field(1, "long").alias("dst_node"), _field(2, "double").alias("cost"))
    _expect(arcs.filter(f"not (src_node between 0 and {n - 1} and dst_node between 0 and {n - 1})").isEmpty(), "an arc's node is out of range")
    return nodes, arcs


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(poi, node, demand) of ``node [demand]``; no demand is 1."""
    rows = stage(lines(spark, path))
    poi = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("line_no")).cast("long") - 1
    return rows.select(poi.alias("poi"), F.col("tag").cast("long").alias("node"), F.coalesce(F.get("f", F.lit(0)).try_cast("double"), F.lit(1.0)).alias("demand"))


def read_demand_csv(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, demand) of a CSV file with a header; blank or missing demand is 1, the text 0 stays 0."""
    raw = spark.read.option("header", True).csv(path)
    demand = F.coalesce(F.trim("demand").try_cast("double"), F.lit(1.0)) if "demand" in raw.columns else F.lit(1.0)
    return raw.select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), demand.alias("demand"))


def _number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def write_lines(df: DataFrame, path: str) -> None:
    """``df`` (place, value) as one ordered text part."""
    df.repartition(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


def _places(parts: list[tuple[DataFrame, list[Column], Column]]) -> DataFrame:
    out = None
    for rank, (df, columns, order) in enumerate(parts):
        part = df.select(F.struct(F.lit(rank).alias("rank"), order.cast("long").alias("at")).alias("place"), F.concat_ws(" ", *columns).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def write_instance(n: int, arcs: DataFrame, commodities: DataFrame, path: str) -> None:
    spark = arcs.sparkSession
    head = spark.createDataFrame([(n, arcs.count(), commodities.count())], "n long, m long, k long")
    cap = F.coalesce(F.col("cap").cast("double"), F.lit(-1.0))
    write_lines(_places([
        (head, [F.lit("p"), F.col("n"), F.col("m"), F.col("k")], F.lit(0)),
        (arcs, [F.lit("a"), F.col("src_node"), F.col("dst_node"), _number("cost"), _number(cap)], F.col("arc_id")),
        (commodities, [F.lit("k"), F.col("src"), F.col("dst"), _number("demand")], F.col("k")),
    ]), path)


def write_street_graph(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    head = nodes.sparkSession.createDataFrame([(nodes.count(), arcs.count())], "n long, m long")
    mark = F.when(F.col("midblock"), F.lit("m"))
    write_lines(_places([
        (head, [F.lit("g"), F.col("n"), F.col("m")], F.lit(0)),
        (nodes, [F.lit("v"), F.col("node"), _number("lon"), _number("lat"), mark], F.col("node")),
        (arcs, [F.lit("e"), F.col("src_node"), F.col("dst_node"), _number("cost")], F.col("arc_id")),
    ]), path)


def write_points(points: DataFrame, path: str) -> None:
    write_lines(_places([(points, [F.col("node"), _number("demand")], F.col("poi"))]), path)


def write_keys(spark: SparkSession, values: dict, path: str) -> None:
    """``key value`` lines of a result; lists are joined by blanks, nulls left out."""
    text = lambda v: " ".join(map(str, v)) if isinstance(v, list | tuple) else repr(v) if isinstance(v, float) else str(v)
    rows = [(i, f"{k} {text(v)}") for i, (k, v) in enumerate(values.items()) if v is not None]
    write_lines(spark.createDataFrame(rows, "place long, value string"), path)


def read_keys(spark: SparkSession, path: str) -> dict[str, str]:
    return {(p := r["value"].split(" ", 1))[0]: p[-1] for r in spark.read.text(path).limit(1000).collect()}


def write_flow(flow: DataFrame, path: str, least: float = 1e-9) -> None:
    """``f n nonzero`` and ``a arc flow`` lines."""
    some = flow.filter(F.col("flow") > least)
    head = flow.sparkSession.createDataFrame([(some.count(),)], "n long")
    write_lines(_places([(head, [F.lit("f"), F.col("n"), F.col("n")], F.lit(0)), (some, [F.lit("a"), F.col("arc_id"), _number("flow")], F.col("arc_id"))]), path)


def write_design(tables: dict[str, DataFrame], path: str) -> None:
    """``h hub``, ``e u v load``, ``p node hub`` lines."""
    write_lines(_places([
        (tables["hubs"], [F.lit("h"), F.col("hub")], F.col("hub")),
        (tables["used_edges"], [F.lit("e"), F.col("u"), F.col("v"), _number("load")], F.xxhash64("u", "v")),
        (tables["assignment"], [F.lit("p"), F.col("node"), F.col("hub")], F.col("poi")),
    ]), path)
