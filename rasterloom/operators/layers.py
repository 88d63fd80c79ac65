"""Layers and what is made of them: composites, palettes by frame, new layers, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import clustering, export, histogram

PALETTE = 256


def composite(layers: DataFrame) -> DataFrame:
    """frame, y, x, r, g, b, a of layers (z, opacity, frame, y, x, r, g, b, a) laid over each other from the lowest z.

    Each pixel is laid over what is below it by its alpha times the layer's opacity; channels and alpha are rounded
    once, at the end. Places that no layer covers stay away; a place that is clear in all layers is 0, 0, 0, 0.
    """
    part = F.struct("z", (F.col("a") / 255.0 * F.col("opacity") / 255.0).alias("s"), *[F.col(c).cast("double").alias(c) for c in "rgb"])
    stacks = layers.groupBy("frame", "y", "x").agg(F.array_sort(F.collect_list(part)).alias("stack"))  # as many as there are layers

    def lay(below: Column, top: Column) -> Column:
        left = below["a"] * (1.0 - top["s"])
        alpha = top["s"] + left
        mixed = [F.when(alpha > 0, (top[c] * top["s"] + below[c] * left) / alpha).otherwise(0.0).alias(c) for c in "rgb"]
        return F.struct(*mixed, alpha.alias("a"))

    empty = F.struct(*[F.lit(0.0).alias(c) for c in "rgba"])
    flat = stacks.select("frame", "y", "x", F.aggregate("stack", empty, lay).alias("p"))
    return flat.select("frame", "y", "x", *[F.round(F.col(f"p.{c}")).cast("int").alias(c) for c in "rgb"], F.round(F.col("p.a") * 255.0).cast("int").alias("a"))


def working_layers(layers: DataFrame) -> DataFrame:
    """Layers (id, parent_id, kind, visible, is_background) without backgrounds. An error, when read, if none of them shows."""
    kept = layers.filter("not is_background")
    shown = export.visible_layers(layers.sparkSession, "rasterloom_working_layers", kept).agg(F.count("*").alias("shown"))
    checked = F.when(F.col("shown") == 0, F.raise_error(F.lit("no visible layer to export")).cast("boolean")).otherwise(F.lit(True))
    return kept.crossJoin(F.broadcast(shown)).filter(checked).drop("shown")  # one row


def palette_of_frames(frames: DataFrame, palettes: DataFrame) -> DataFrame:
    """frames (frame, from 1) with palette_idx: the palette of their number, or the last one. palettes: palette_idx, from 1."""
    last = palettes.agg(F.max("palette_idx").alias("last"))
    return frames.crossJoin(F.broadcast(last)).select("frame", F.least("frame", "last").alias("palette_idx"))  # one row


def as_rgb(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """Indexed pixels (frame, y, x, idx) in the colours of palette (idx, r, g, b, a); an index without a colour is clear."""
    small = palette.select("idx", *"rgba")
    return indexed.join(small, "idx", "left").select("frame", "y", "x", *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in "rgba"])


def reduced_palette(pixels: DataFrame, most: int = PALETTE) -> DataFrame:
    """r, g, b, n: the opaque colours if there are no more than `most`, else the centres that they are quantised to."""
    counts = pixels.filter("a > 0").groupBy("r", "g", "b").agg(F.count("*").alias("n"))
    if len(counts.limit(most + 1).collect()) <= most:
        return counts
    listed = counts.select(F.lit(0).alias("frame"), "r", "g", "b", "n", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("first_pos"))
    found = clustering.quantised(listed, most).select("key", *[F.col(c).alias(f"q_{c}") for c in "rgb"])
    joined = counts.withColumn("key", F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).join(found, "key")
    return joined.groupBy(*[F.col(f"q_{c}").alias(c) for c in "rgb"]).agg(F.sum("n").alias("n"))


def free_names(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (base) with name: the base, or the base and the smallest number from 2 that `existing` (name) doesn't have."""
    numbered = existing.select("name").distinct()
    taken = wanted.join(numbered, F.col("name").startswith(F.col("base"))).select("base", "name")  # names that begin alike
    tries = wanted.join(taken.groupBy("base").agg(F.count("*").alias("n")), "base", "left").withColumn("k", F.explode(F.sequence(F.lit(1), (F.coalesce("n", F.lit(0)) + 1).cast("int"))))
    tries = tries.withColumn("name", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" "), F.col("k").cast("string"))))
    return tries.join(taken, ["base", "name"], "left_anti").groupBy("base").agg(F.min_by("name", "k").alias("name"))


def remapped_layer(pixels: DataFrame, lookup: DataFrame, name: str) -> DataFrame:
    """layer, frame, y, x, r, g, b, a: the composite in the colours of lookup (key, r, g, b) as a layer of its own; the
    pixels it is made of stay as they are, clear ones get no row."""
    new = lookup.select("key", *[F.col(c).alias(f"n_{c}") for c in "rgb"])
    keyed = pixels.filter("a > 0").withColumn("key", histogram.colour_key())
    return keyed.join(new, "key", "left").select(F.lit(name).alias("layer"), "frame", "y", "x", *[F.coalesce(f"n_{c}", c).alias(c) for c in "rgb"], "a")


def summary(exported: DataFrame, regions: DataFrame, kept: DataFrame) -> DataFrame:
    """One row, message: images written (exported: label, frame), regions with content, and those left out as empty."""
    images = exported.select("label", "frame").distinct().agg(F.count("*").alias("images"))
    counts = images.crossJoin(regions.agg(F.count("*").alias("all"))).crossJoin(kept.agg(F.count("*").alias("kept")))  # one row each
    empty = F.col("all") - F.col("kept")
    left_out = F.when(empty > 0, F.concat(F.lit("; "), empty.cast("string"), F.lit(" empty regions left out"))).otherwise("")
    return counts.select(F.concat(F.col("images").cast("string"), F.lit(" images of "), F.col("kept").cast("string"), F.lit(" regions; background layers ignored"), left_out).alias("message"))


def warnings(layers: DataFrame) -> DataFrame:
    """file and message of documents with warnings or errors: all of a document's lines in the order of its layers."""
    line = F.when(F.col("error").isNotNull(), F.col("error")).otherwise(F.concat("name", F.lit(": "), "warning"))
    rows = layers.select("file", F.coalesce("idx", F.lit(0)).alias("idx"), line.alias("line")).filter("line is not null")
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("message"))
