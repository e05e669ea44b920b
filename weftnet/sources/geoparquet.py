"""GeoParquet: Parquet with a WKB geometry column and a ``geo`` entry in the file metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.functions import wkb


def read_places(spark: SparkSession, path: str, least_confidence: float | None = None, bbox: tuple | None = None) -> DataFrame:
    """(lon, lat, confidence) of point geometries; a null confidence passes, null or other geometry doesn't."""
    raw = spark.read.parquet(path).select("geometry", "confidence")
    if least_confidence is not None:
        raw = raw.filter(F.col("confidence").isNull() | (F.col("confidence") >= least_confidence))
    at = F.get("c", F.lit(0))
    rows = raw.withColumn("c", wkb.coordinates("geometry")).filter(F.size("c") == 1).select(at["lon"].alias("lon"), at["lat"].alias("lat"), "confidence")
    if bbox:
        x0, y0, x1, y1 = bbox
        rows = rows.filter(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
    return rows


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(subtype, class, points): points is an array of struct(lon, lat), null for other geometry."""
    raw = spark.read.parquet(path).select("subtype", "class", "geometry")
    return raw.select("subtype", "class", wkb.coordinates("geometry").alias("points"))


def every_kth(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Row ``int(i * n / limit)`` for each i below ``limit``: a systematic subsample in a given order."""
    from pyspark.sql import Window

    n = rows.count()
    if n <= limit:
        return rows
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1
    wanted = rows.sparkSession.range(limit).select(F.floor(F.col("id") * F.lit(n / limit)).cast("int").alias("_i"))
    return rows.withColumn("_i", place).join(wanted, "_i", "left_semi").drop("_i")


def write(features: DataFrame, path: str, geometry: str = "geometry", kinds: tuple[str, ...] = ()) -> None:
    """Write ``features``; then put the ``geo`` entry, which Spark can't, into a local file's footer.

    Files on a store that only Spark reaches keep their rows and columns and lack the entry.
    """
    from pathlib import Path

    features.write.mode("overwrite").parquet(path)
    folder = Path(path.removeprefix("file://"))
    if not folder.is_dir():
        return
    import pyarrow.parquet as pq

    entry = json.dumps({"version": "1.0.0", "primary_column": geometry, "columns": {geometry: {"encoding": "WKB", "geometry_types": list(kinds)}}})
    for file in folder.glob("part-*.parquet"):
        table = pq.read_table(file)
        pq.write_table(table.replace_schema_metadata({**(table.schema.metadata or {}), b"geo": entry.encode()}), file)
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
