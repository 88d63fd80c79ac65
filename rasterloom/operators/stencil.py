"""Neighbourhood operators: repair, neutral snap, outline; and crop, padding and scaling.

A stencil is an equi-join on shifted places: neighbours are pixels repeated for eight literal offsets, reduced by place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.colour import clamp_channel
from rasterloom.functions.options import outline_kind
from rasterloom.operators.grid import key_text, vote

# fixed values
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
FILL, CLEAR = 8, 1
#: Side of the tiles by which regions meet pixels.
TILE = 16
STEPS = {"4-way": FOUR, "8-way": EIGHT}


def neighbours(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each opaque pixel at the places that it neighbours: frame, y, x, r, g, b, a."""
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    moved = pixels.filter("a > 0").withColumn("s", F.explode(shifts))
    return moved.select("frame", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "r", "g", "b", "a")


def repair(pixels: DataFrame) -> DataFrame:
    """Fills a hole that opaque pixels surround with their most frequent colour; clears an opaque pixel with at most one
    opaque neighbour. All at once, on the old image."""
    near = neighbours(pixels, EIGHT)
    counts = near.groupBy("frame", "y", "x").agg(F.count("*").alias("n"))
    most = vote(near, ["frame", "y", "x"]).select("frame", "y", "x", *[F.col(c).alias(f"m_{c}") for c in "rgba"])
    rows = pixels.join(counts.join(most, ["frame", "y", "x"]), ["frame", "y", "x"], "left")
    n = F.coalesce("n", F.lit(0))
    new = lambda c: F.when((F.col("a") == 0) & (n >= FILL), F.col(f"m_{c}")).when((F.col("a") > 0) & (n <= CLEAR), 0).otherwise(F.col(c)).cast("int").alias(c)
    return rows.select("frame", "y", "x", *[new(c) for c in "rgba"])


def snap_neutral(pixels: DataFrame) -> DataFrame:
    """Nearly neutral pixels become grey, or a warm off-white beside warm and bright ones."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    warm, bright = (r > g + 5) & (r > b + 5), (r >= 240) & (g >= 240) & (b >= 200)
    near = neighbours(pixels, EIGHT).groupBy("frame", "y", "x").agg(F.sum(warm.cast("int")).alias("warm"), F.sum(bright.cast("int")).alias("bright"))
    rows = pixels.join(near, ["frame", "y", "x"], "left")
    snaps = (F.col("a") > 0) & ~((r == g) & (g == b)) & (F.abs(r - g) <= 2) & (F.abs(g - b) <= 2)
    grey = F.floor((r + g + b) / 3.0).cast("int")
    tinted = (F.col("warm") >= 2) & (F.col("bright") >= 2)
    new = lambda c, shift: F.when(snaps & tinted, clamp_channel(grey + shift)).when(snaps, grey).otherwise(c).cast("int")
    return rows.select("frame", "y", "x", new(r, 15).alias("r"), new(g, -1).alias("g"), new(b, -1).alias("b"), "a")


def outline(pixels: DataFrame, kind: str = "4-way") -> DataFrame:
    """A white line of one pixel around opaque pixels, inside the frame."""
    near = neighbours(pixels, STEPS[outline_kind(kind)]).select("frame", "y", "x").distinct().withColumn("near", F.lit(True))
    drawn = (F.col("a") == 0) & F.col("near")
    return pixels.join(near, ["frame", "y", "x"], "left").select("frame", "y", "x", *[F.when(drawn, 255).otherwise(F.col(c)).cast("int").alias(c) for c in "rgba"])


def upscale(pixels: DataFrame, factor: int = 10) -> DataFrame:
    steps = lambda: F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    wide = pixels.withColumn("i", steps()).withColumn("j", steps())
    return wide.select("frame", (F.col("y") * factor + F.col("i")).alias("y"), (F.col("x") * factor + F.col("j")).alias("x"), "r", "g", "b", "a")


def crop(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """Pixels of each region (label, bx, by, bw, bh) in the region's own coordinates.

    A region is spread to its tiles of TILE x TILE places, so the join is on (y div TILE, x div TILE), and the rest of the
    test is left to a filter: keys are as many as tiles, however high a frame is.
    """
    ends = lambda at, size: F.sequence(F.floor(F.col(at) / TILE), F.floor((F.col(at) + F.col(size) - 1) / TILE))
    tiles = regions.select("label", "bx", "by", "bw", "bh", F.explode(ends("by", "bh")).alias("tile_y")).withColumn("tile_x", F.explode(ends("bx", "bw")))
    placed = pixels.withColumn("tile_y", F.floor(F.col("y") / TILE)).withColumn("tile_x", F.floor(F.col("x") / TILE))
    inside = "x >= bx and x < bx + bw and y >= by and y < by + bh"
    return placed.join(tiles, ["tile_y", "tile_x"]).filter(inside).select("label", "frame", (F.col("y") - F.col("by")).alias("y"), (F.col("x") - F.col("bx")).alias("x"), "r", "g", "b", "a")


def fit(pixels: DataFrame, sizes: DataFrame, width: int, height: int) -> DataFrame:
    """Frames (sizes: frame, width, height) padded or cropped to one size around the centre."""
    dx, dy = F.floor((F.lit(width) - F.col("width")) / 2), F.floor((F.lit(height) - F.col("height")) / 2)
    moved = pixels.join(sizes, "frame").select("frame", (F.col("y") + dy).cast("int").alias("y"), (F.col("x") + dx).cast("int").alias("x"), "r", "g", "b", "a").filter((F.col("x").between(0, width - 1)) & (F.col("y").between(0, height - 1)))
    grid = sizes.select("frame").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.join(moved, ["frame", "y", "x"], "left").select("frame", "y", "x", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in "rgba"])


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """frame, compared, mismatched over the pixels that both have."""
    other = right.select("frame", "y", "x", F.struct("r", "g", "b", "a").alias("q"))
    both = left.join(other, ["frame", "y", "x"])
    return both.groupBy("frame").agg(F.count("*").alias("compared"), F.sum((F.struct("r", "g", "b", "a") != F.col("q")).cast("long")).alias("mismatched"))


__all__ = ["crop", "difference", "fit", "key_text", "neighbours", "outline", "repair", "snap_neutral", "upscale"]
