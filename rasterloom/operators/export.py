"""Regions, names and layers of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.operators.stencil import crop

_NUMBERED = "^(.*?)([0-9]+)$"


def frame_name(base: Column, index: Column) -> Column:
    """A base that ends in digits continues that number in its width; another gets three digits."""
    digits = F.regexp_extract(base, _NUMBERED, 2)
    number = (F.try_to_number(digits, F.lit("9" * 18)) + index - 1).cast("long").cast("string")
    padded = F.lpad(number, F.greatest(F.length(digits), F.length(number)), F.lit("0"))
    return F.when(digits != "", F.concat(F.regexp_extract(base, _NUMBERED, 1), padded)).otherwise(F.concat(base, F.lpad(index.cast("string"), F.greatest(F.lit(3), F.length(index.cast("string"))), F.lit("0"))))


def last_component(path: Column) -> Column:
    """The last part of a path; null for none or a drive letter."""
    part = F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)
    return F.when((part == "") | part.rlike("^[A-Za-z]:$"), None).otherwise(part)


def token_name(label: Column, path: Column) -> Column:
    return F.concat(label, F.lit(" Token "), last_component(path), F.lit(" "))


def regions(slices: DataFrame, width: int, height: int) -> DataFrame:
    """label, bx, by, bw, bh of slices (idx, name, bx, by, bw, bh); the whole image if there are none.

    An unnamed slice is called by its number. A slice that is empty or leaves the image is an error.
    """
    bad = (F.col("bw") <= 0) | (F.col("bh") <= 0) | (F.col("bx") < 0) | (F.col("by") < 0) | (F.col("bx") + F.col("bw") > width) | (F.col("by") + F.col("bh") > height)
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("slice #"), F.col("idx").cast("string")))
    named = slices.select(F.when(bad, F.raise_error(F.concat(F.lit("region outside the image: "), label))).otherwise(label).cast("string").alias("label"), "bx", "by", "bw", "bh")
    spark = slices.sparkSession
    whole = spark.range(1).select(F.lit("sprite").alias("label"), F.lit(0).alias("bx"), F.lit(0).alias("by"), F.lit(width).alias("bw"), F.lit(height).alias("bh"))
    some = slices.agg(F.count("*").alias("n"))
    return named.unionByName(whole.crossJoin(F.broadcast(some)).filter("n = 0").drop("n"))  # one row


def nonempty(regions: DataFrame, pixels: DataFrame) -> DataFrame:
    """regions with an opaque pixel in some frame; places are reduced over frames before they meet regions."""
    places = pixels.filter("a > 0").select("y", "x").distinct().select(F.lit(0).alias("frame"), "y", "x", *[F.lit(0).alias(c) for c in "rgba"])
    found = crop(places, regions).select("label").distinct()
    return regions.join(found, "label", "left_semi")


def numbered(outputs: DataFrame) -> DataFrame:
    """outputs (base, region_idx, frame) with the running index of their base and the file name."""
    index = F.row_number().over(Window.partitionBy("base").orderBy("region_idx", "frame"))
    return outputs.withColumn("index", index).withColumn("name", frame_name(F.col("base"), F.col("index")))


def visible_layers(spark, view: str, layers: DataFrame) -> DataFrame:
    """Layers (id, parent_id, kind, visible) that show: visible with all the groups around them, and no group."""
    layers.createOrReplaceTempView(view)
    return spark.sql(f"""
        with recursive shown(id, kind) as (
          select id, kind from {view} where parent_id is null and visible
          union all
          select c.id, c.kind from {view} c join shown p on c.parent_id = p.id where c.visible)
        select id, kind from shown where kind <> 'group'""")


# fixed values: blend modes by number, and the class names older files use
BLEND_MODES = (
    (0, "Normal", "normal", "NormalBlendOp"),
    (1, "Multiply", "multiply", "MultiplyBlendOp"),
    (2, "Additive", "addition", "AdditiveBlendOp"),
    (3, "Color Burn", "color_burn", "ColorBurnBlendOp"),
    (4, "Color Dodge", "color_dodge", "ColorDodgeBlendOp"),
    (5, "Reflect", None, "ReflectBlendOp"),
    (6, "Glow", None, "GlowBlendOp"),
    (7, "Overlay", "overlay", "OverlayBlendOp"),
    (8, "Difference", "difference", "DifferenceBlendOp"),
    (9, "Negation", None, "NegationBlendOp"),
    (10, "Lighten", "lighten", "LightenBlendOp"),
    (11, "Darken", "darken", "DarkenBlendOp"),
    (12, "Screen", "screen", "ScreenBlendOp"),
    (13, "XOR", None, "XorBlendOp"),
)


def blend_modes(spark) -> DataFrame:
    return spark.createDataFrame([*BLEND_MODES], "blend_id int, blend_name string, mode string, class string")


def resolved_blend(layers: DataFrame) -> DataFrame:
    """layers (id, value, class) with blend_id, mode and warning: the number, else the class's number, else 0; modes that
    the target lacks become normal, with a warning."""
    modes = blend_modes(layers.sparkSession)
    by_class = layers.join(F.broadcast(modes.select("class", F.col("blend_id").alias("by_class"))), "class", "left")  # 14 rows
    chosen = by_class.withColumn("blend_id", F.coalesce("value", "by_class", F.lit(0)))
    known = chosen.join(F.broadcast(modes.select("blend_id", "blend_name", "mode")), "blend_id", "left")
    warning = F.when(F.col("mode").isNull(), F.concat(F.lit("blend mode "), F.coalesce("blend_name", F.col("blend_id").cast("string")), F.lit(" became normal")))
    return known.select("id", "blend_id", F.coalesce("mode", F.lit("normal")).alias("mode"), warning.alias("warning"))
