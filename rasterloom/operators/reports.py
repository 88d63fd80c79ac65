"""Reports on pixel tables: counts by layer and frame, leading colours, colours of places, pairs and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import layers as L
from rasterloom.operators import stencil

SIZE_TOLERANCE, LISTED = 2, 20


def hex_colour() -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in "rgb"])


def layer_profile(layers: DataFrame) -> DataFrame:
    """level, name, opaque, colours: for each layer (layer, z, opacity and pixels) as it is, and for each frame and in
    total for all laid over each other."""
    colour = F.when(F.col("a") > 0, F.struct("r", "g", "b"))
    counts = [F.count(colour).alias("opaque"), F.count_distinct(colour).alias("colours")]
    own = layers.groupBy("layer").agg(*counts).select(F.lit("layer").alias("level"), F.col("layer").cast("string").alias("name"), "opaque", "colours")
    levels = L.composite(layers).select("frame", "r", "g", "b", "a").cube("frame").agg(F.grouping("frame").alias("all"), *counts)
    of = F.col("all") == 1
    return own.unionByName(levels.select(F.when(of, "total").otherwise("frame").alias("level"), F.when(of, "").otherwise(F.col("frame").cast("string")).alias("name"), "opaque", "colours"))


def leading_colours(pixels: DataFrame, most: int = 60) -> DataFrame:
    """colour (as #RRGGBB), n: the most frequent opaque colours; ties to the smaller colour."""
    counts = pixels.filter("a > 0").groupBy("r", "g", "b").agg(F.count("*").alias("n"))
    return counts.select(hex_colour().alias("colour"), "n").orderBy(F.desc("n"), "colour").limit(most)


def greenish(pixels: DataFrame) -> DataFrame:
    """r, g, b, n of opaque colours in which green leads by more than 12 over red and 4 over blue."""
    return pixels.filter("a > 0 and g > r + 12 and g > b + 4").groupBy("r", "g", "b").agg(F.count("*").alias("n"))


def region_colours(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """label, colour, n: the opaque colours inside each region (label, bx, by, bw, bh), over all frames."""
    return stencil.crop(pixels.filter("a > 0"), regions).groupBy("label", hex_colour().alias("colour")).agg(F.count("*").alias("n"))


def pairs(source: DataFrame, output: DataFrame, colours: list[str]) -> DataFrame:
    """frame, y, x, source, output: source pixels of some colours (#RRGGBB) and what is at their place; null for nothing."""
    wanted = source.filter("a > 0").select("frame", "y", "x", hex_colour().alias("source")).filter(F.col("source").isin(colours))
    return wanted.join(output.select("frame", "y", "x", hex_colour().alias("output")), ["frame", "y", "x"], "left")


def most_vivid(entries: DataFrame, most: int = 12) -> DataFrame:
    """key, chroma, lab_l, w: the colours of highest chroma; then the lighter, the more frequent, the greater."""
    return entries.select("key", "chroma", "lab_l", "w").orderBy(F.desc("chroma"), F.desc("lab_l"), F.desc("w"), F.desc("key")).limit(most)


def _extent(pixels: DataFrame, prefix: str) -> DataFrame:
    return pixels.groupBy("frame").agg((F.max("x") + 1).alias(f"{prefix}_w"), (F.max("y") + 1).alias(f"{prefix}_h"))


def compared(left: DataFrame, right: DataFrame, tolerance: int = SIZE_TOLERANCE) -> DataFrame:
    """frame, compared, mismatched, status: equal, different, or of other sizes. Sizes may differ by the tolerance, and then
    only what both cover is held against each other; a frame that one side lacks is of another size."""
    sizes = _extent(left, "l").join(_extent(right, "r"), "frame", "full")
    other = right.select("frame", "y", "x", F.struct("r", "g", "b", "a").alias("q"))
    both = left.join(other, ["frame", "y", "x"]).groupBy("frame").agg(F.count("*").alias("compared"), F.sum((F.struct("r", "g", "b", "a") != F.col("q")).cast("long")).alias("mismatched"))
    near = (F.abs(F.col("l_w") - F.col("r_w")) <= tolerance) & (F.abs(F.col("l_h") - F.col("r_h")) <= tolerance)
    fits = F.coalesce(near, F.lit(False))
    rows = sizes.join(both, "frame", "left")
    n = lambda c: F.when(fits, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("long")
    return rows.select("frame", n("compared").alias("compared"), n("mismatched").alias("mismatched"), F.when(~fits, "size").when(n("mismatched") > 0, "different").otherwise("equal").alias("status"))


def first_mismatches(left: DataFrame, right: DataFrame, most: int = LISTED) -> DataFrame:
    """frame, y, x of the first places in reading order where both have a pixel and it differs, `most` of a frame."""
    from pyspark.sql.window import Window

    other = right.select("frame", "y", "x", F.struct("r", "g", "b", "a").alias("q"))
    differ = left.join(other, ["frame", "y", "x"]).filter(F.struct("r", "g", "b", "a") != F.col("q")).select("frame", "y", "x")
    nth = F.row_number().over(Window.partitionBy("frame").orderBy("y", "x"))
    return differ.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")
