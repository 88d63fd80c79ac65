"""Counts, luma, profiles and runs of pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RGBA = ("r", "g", "b", "a")


def opaque(pixels: DataFrame) -> DataFrame:
    return pixels.filter("a > 0")


def histogram(pixels: DataFrame, width: int) -> DataFrame:
    """Opaque colours of each frame with their count and first place in reading order."""
    return opaque(pixels).groupBy("frame", "r", "g", "b").agg(F.count("*").alias("n"), F.min(F.col("y") * width + F.col("x")).alias("first_pos"))


def colour_key() -> Column:
    return (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("key")


def sprite_histogram(pixels: DataFrame) -> DataFrame:
    """Colours of all frames: packed key, opaque pixels, frames that have it, and whether any pixel isn't fully opaque.

    Counted per (frame, colour) first, so the distinct count of frames needs no second shuffle of pixels.
    """
    by_frame = opaque(pixels).groupBy("frame", "r", "g", "b").agg(F.count("*").alias("w"))
    alpha = pixels.agg(F.coalesce(F.bool_or(F.col("a") < 255), F.lit(False)).alias("alpha_present"))
    counted = by_frame.groupBy("r", "g", "b").agg(F.sum("w").alias("w"), F.count("*").alias("frames"))
    return counted.crossJoin(F.broadcast(alpha)).select(colour_key(), "r", "g", "b", "w", "frames", "alpha_present")  # alpha is one row


def colour_count(pixels: DataFrame) -> DataFrame:
    return opaque(pixels).select("frame", "r", "g", "b").distinct().groupBy("frame").agg(F.count("*").alias("colours"))


def luma() -> Column:
    return F.when(F.col("a") == 0, 0.0).otherwise(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))


def profiles(pixels: DataFrame) -> DataFrame:
    """For each column and row of a frame the sum of absolute central differences of luma across it; 0 at the edges."""
    grey = pixels.select("frame", "y", "x", luma().alias("v"))

    def axis(name: str, along: str, across: str) -> DataFrame:
        w = Window.partitionBy("frame", across).orderBy(along)
        step = F.abs(F.lead("v").over(w) - F.lag("v").over(w))
        return grey.select("frame", F.lit(name).alias("axis"), F.col(along).alias("pos"), F.coalesce(step, F.lit(0.0)).alias("d"))

    both = axis("x", "x", "y").unionByName(axis("y", "y", "x"))
    return both.groupBy("frame", "axis", "pos").agg(F.sum("d").alias("value"))


def runs(pixels: DataFrame) -> DataFrame:
    """Lengths of runs of equal opaque pixels along rows and columns, pooled: frame, len, cnt."""

    def axis(along: str, across: str) -> DataFrame:
        w = Window.partitionBy("frame", across).orderBy(along)
        here, before = F.struct(*RGBA), F.lag(F.struct(*RGBA)).over(w)
        # islands: a new one starts wherever the colour changes
        marked = pixels.select("frame", across, along, "a", F.when(before.isNull() | (before != here), 1).otherwise(0).alias("new"))
        numbered = marked.withColumn("island", F.sum("new").over(w))
        return opaque(numbered).groupBy("frame", F.col(across).alias("line"), "island").agg(F.count("*").alias("len")).select("frame", "len")

    return axis("x", "y").unionByName(axis("y", "x")).groupBy("frame", "len").agg(F.count("*").alias("cnt"))
