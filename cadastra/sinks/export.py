"""Compact JSON, versions, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.geo import lonlat
from cadastra.functions.text import cell


def compact(df: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """json: each row without nulls, empty texts and lists, false flags, and values that are the default."""
    kept = []
    for name, kind in df.dtypes:
        c = F.col(name)
        keep = c if kind == "boolean" else F.size(c) > 0 if kind.startswith("array") else c != "" if kind == "string" else c.isNotNull()
        if defaults and name in defaults:
            keep = keep & (c != defaults[name])
        kept.append(F.when(keep, c).alias(name))
    return df.select(F.to_json(F.struct(*kept)).alias("json"))


def content_version(lines: DataFrame) -> DataFrame:
    """lines, version: a sum of the lines' hashes, so it needs no order and no task holds all. lines: line."""
    part = F.conv(F.substring(F.sha2("line", 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.count("*").alias("lines"), F.sum(part).cast("string").alias("version"))


def as_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as cells of text, in a fixed order."""
    kinds = dict(df.dtypes)
    return df.select(*[cell(F.col(c), kinds[c]).alias(c) for c in columns])


def write_table(df: DataFrame, columns: list[str], key: list[str], path: str) -> None:
    """CSV in order of the key: range-partitioned, so the files in order are the table in order."""
    as_table(df.orderBy(*key), columns).write.csv(path, header=True, mode="overwrite", emptyValue="")


def write_json(df: DataFrame, path: str, defaults: dict[str, object] | None = None) -> None:
    compact(df, defaults).write.text(path)


def feature(parts: Column, properties: dict[str, Column], decimals: int = 5) -> Column:
    """A GeoJSON feature of a Polygon, or of a MultiPolygon if there are several parts.

    parts: polygons as arrays of rings (the rim, counter-clockwise, before its holes) of points x, y in metres; they
    come out as longitude and latitude, each ring closed by its first point.
    """

    def point(p: Column) -> Column:
        lon, lat = lonlat(p["x"], p["y"])
        return F.array(F.round(lon, decimals), F.round(lat, decimals))

    closed = lambda ring: F.concat(F.transform(ring, point), F.transform(F.slice(ring, 1, 1), point))
    coordinates = F.transform(parts, lambda rings: F.transform(rings, closed))
    shape = lambda kind, c: F.struct(F.lit("Feature").alias("type"), F.struct(*[v.alias(n) for n, v in properties.items()]).alias("properties"), F.struct(F.lit(kind).alias("type"), c.alias("coordinates")).alias("geometry"))
    return F.when(F.size(parts) == 1, F.to_json(shape("Polygon", coordinates[0]))).otherwise(F.to_json(shape("MultiPolygon", coordinates)))


def write_features(features: DataFrame, order: list[str], path: str) -> None:
    """features (json and the columns of order) as lines of GeoJSON, one feature a line, in order: the files in order are the collection."""
    features.orderBy(*order).select("json").write.text(path)


def quarantine(events: DataFrame, summaries: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The events with their text replaced by a summary, and the texts apart, both under the key."""
    texts = events.select(*key, "description").filter(F.coalesce("description", F.lit("")) != "")
    public = events.drop("description").join(summaries.select(*key, F.col("summary").alias("description")), key, "left")
    return public, texts
