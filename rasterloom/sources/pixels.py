"""Pixel tables: the shape all raster operators work on, and a derived one over relational tables.

A pixel row is (frame, y, x, r, g, b, a); a > 0 means opaque. Frames are independent, so every operator partitions by
frame and never gathers more than a frame's aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 32


def derived_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 32x32 made of orders (places) and part (colours of 4x4 blocks); only complete frames."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    counts = orders.agg(F.floor(F.count("*") / 1024).alias("frames")).crossJoin(part.agg(F.count("*").alias("parts")))
    rows = orders.crossJoin(F.broadcast(counts)).filter("k div 1024 < frames")  # counts is one row
    frame, y, x = F.expr("k div 1024"), F.expr("(k % 1024) div 32"), F.expr("k % 32")
    rows = rows.select("k", "parts", frame.cast("int").alias("frame"), y.cast("int").alias("y"), x.cast("int").alias("x"))
    rows = rows.withColumn("cell", F.expr("(frame * 64 + (y div 4) * 8 + x div 4) % parts"))
    joined = rows.join(part, F.col("cell") == F.col("p_partkey"))
    clear = F.col("p_size") % 7 == 0
    colour = lambda c: F.when(clear, 0).otherwise(c).cast("int")
    return joined.select(
        "frame", "y", "x", colour(40 * (F.col("p_size") % 6) + F.when(F.col("k") % 97 == 0, 3).otherwise(0)).alias("r"), colour(60 * (F.col("p_size") % 4)).alias("g"),
        colour(50 * (F.col("p_size") % 5)).alias("b"), colour(F.lit(255)).alias("a"))


#: The same table in DuckDB's SQL, as a common table expression named px.
PIXELS_SQL = """px as (
  select (k // 1024)::int as frame, ((k % 1024) // 32)::int as y, (k % 32)::int as x,
         case when p_size % 7 = 0 then 0 else 40 * (p_size % 6) + (case when k % 97 = 0 then 3 else 0 end) end::int as r,
         case when p_size % 7 = 0 then 0 else 60 * (p_size % 4) end::int as g,
         case when p_size % 7 = 0 then 0 else 50 * (p_size % 5) end::int as b,
         case when p_size % 7 = 0 then 0 else 255 end::int as a
  from (select o_orderkey as k, (select count(*) from orders) // 1024 as frames, (select count(*) from part) as parts from orders) o
  join part on p_partkey = ((k // 1024) * 64 + ((k % 1024) // 32 // 4) * 8 + (k % 32) // 4) % parts
  where k // 1024 < frames)"""


def with_frame_size(pixels: DataFrame) -> DataFrame:
    """pixels with width and height of their frame."""
    size = pixels.groupBy("frame").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return pixels.join(size, "frame")
