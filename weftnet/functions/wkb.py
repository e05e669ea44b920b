"""Well-known binary: points and line strings."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT, LINE = 1, 2


def point_bytes(lon: float, lat: float) -> bytes:
    return struct.pack("<BIdd", 1, POINT, lon, lat)


def line_bytes(coordinates: list[tuple[float, float]]) -> bytes:
    flat = [c for xy in coordinates for c in xy]
    return struct.pack(f"<BII{len(flat)}d", 1, LINE, len(coordinates), *flat)


def parse(raw: bytes | None) -> list[tuple[float, float]] | None:
    """Coordinates of a point or line string; None for null, other or damaged geometry."""
    if raw is None or len(raw) < 5:
        return None
    order = "<" if raw[0] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", raw, 1)
    try:
        if kind == POINT:
            return [struct.unpack_from(order + "dd", raw, 5)]
        if kind == LINE:
            (n,) = struct.unpack_from(order + "I", raw, 5)
            flat = struct.unpack_from(f"{order}{2 * n}d", raw, 9)
            return list(zip(flat[::2], flat[1::2]))
    except struct.error:
        return None
    return None


PAIRS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


@F.pandas_udf(PAIRS)
def coordinates(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if (c := parse(b)) is None else [{"lon": x, "lat": y} for x, y in c])


@F.pandas_udf(T.BinaryType())
def point(lon: pd.Series, lat: pd.Series) -> pd.Series:
    return pd.Series([None if x != x or y != y else point_bytes(x, y) for x, y in zip(lon, lat)])


@F.pandas_udf(T.BinaryType())
def segment(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series([line_bytes([(a, b), (c, d)]) for a, b, c, d in zip(lon1, lat1, lon2, lat2)])
