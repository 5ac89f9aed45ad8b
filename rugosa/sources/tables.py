"""The driver's tables read as surfaces: line scans, maps and nonuniform profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface_id, scan_id, ix, h): uniform line scans of 64 points, one for each embedding; a container for each label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("surface_id"), F.col("vec_id").alias("scan_id"), F.posexplode("embedding").alias("ix", "v")).select("surface_id", "scan_id", "ix", F.col("v").cast("double").alias("h"))


def scan_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface_id, scan_id, heights): the same, a row a scan."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("surface_id"), F.col("vec_id").alias("scan_id"), F.col("embedding").cast("array<double>").alias("heights"))


def small_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, ix, iy, h): maps of 8 x 8, one for each embedding."""
    p = line_scans(spark, sf_dir)
    return p.select("scan_id", F.expr("ix div 8").cast("int").alias("ix"), (F.col("ix") % 8).alias("iy"), "h")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, ix, x, h): nonuniform line scans, one for each user; x in hours since 2024."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts")
    return e.select(F.col("user_id").alias("scan_id"), (F.row_number().over(w) - 1).alias("ix"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 3.6e9D").alias("x"), F.col("value").alias("h"))


def height_map(spark: SparkSession, sf_dir: str, where: str | None = None, value: str = "l_extendedprice", unit: int = 100) -> DataFrame:
    """(ix, iy, h): the defined pixels of one map, means of integer units (exact sums) over l_quantity and l_suppkey."""
    t = table(spark, sf_dir, "lineitem")
    t = t.where(where) if where else t
    t = t.select((F.col("l_quantity").cast("int") - 1).alias("ix"), F.col("l_suppkey").cast("int").alias("iy"), F.round(F.col(value) * unit).cast("long").alias("u"))
    return t.groupBy("ix", "iy").agg((F.sum("u") / F.count("*") / float(unit)).alias("h"))
