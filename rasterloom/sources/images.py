"""Image files as pixels, through Spark's own image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """frame (files in order of name), y, x, r, g, b, a of the images under path; those without alpha are opaque."""
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    names = image.select("origin").distinct().sort("origin")
    from pyspark.sql.window import Window

    numbered = names.withColumn("frame", F.row_number().over(Window.orderBy("origin")) - 1)  # one row per file
    rows = image.join(numbered, "origin").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    width = F.col("width") * F.col("nChannels")
    rows = rows.withColumn("line", F.substring(F.col("data"), F.col("y") * width + 1, width)).drop("data").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    byte = lambda i: F.conv(F.hex(F.substring(F.col("line"), F.col("x") * F.col("nChannels") + i + 1, F.lit(1))), 16, 10).cast("int")
    grey = F.col("nChannels") == 1
    return rows.select("frame", "y", "x", F.when(grey, byte(0)).otherwise(byte(2)).alias("r"), F.when(grey, byte(0)).otherwise(byte(1)).alias("g"), byte(0).alias("b"), F.when(F.col("nChannels") == 4, byte(3)).otherwise(255).alias("a"))
