"""Whole runs: downscale frames to their true size, compress a palette, export regions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions import colour as C
from rasterloom.operators import clustering, cuts, export, grid, histogram, palette, pitch, ramps, stencil
from rasterloom.sources.scratch import settled

#: Ramps that are tried for, at most.
MOST_CLUSTERS = 8


@dataclass(frozen=True)
class Downscale:
    colours: int = 32
    sampler_least: int = 3
    sampler_most: int = 8


def downscale(pixels: DataFrame, options: Downscale = Downscale()) -> tuple[DataFrame, str]:
    """(frame, y, x, r, g, b, a at the frames' true size, status). Without a common pitch the pixels come back as they are.

    Two stages around one barrier: each frame's pitch, then the common one (a single row, read on the driver), then a
    strategy for each frame: regularised cuts, content-anchored cells, elastic cells, or point samples.
    """
    pixels = settled(pixels)
    sizes = pixels.groupBy("frame").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    profiles = settled(histogram.profiles(pixels))
    by_runs, by_profiles = settled(pitch.from_runs(settled(histogram.runs(pixels)))), settled(pitch.from_profiles(profiles))
    combined = settled(pitch.combine(by_runs, by_profiles, sizes))
    common = pitch.common(combined).first()
    if common["status"] != "ok":
        return pixels, common["status"]
    base, size = int(common["base_pitch"]), sizes.agg(F.max("width").alias("w"), F.max("height").alias("h")).first()
    integer = options.sampler_least <= base <= options.sampler_most and size["w"] % base == 0 and size["h"] % base == 0
    unit = base if integer or base <= 2 else float(common["pitch"])
    keys = ["frame", "ty", "tx"]

    def voted(spans: DataFrame, share: float) -> DataFrame:
        return grid.vote(cuts.in_spans(pixels, spans).select(*keys, *"rgba"), keys, share)

    def by_cut(method: str, which: DataFrame, step: float) -> DataFrame:
        held = cuts.frame_cuts(profiles.join(which, "frame", "left_semi"), method, step)
        return grid.by_cuts(pixels, held).select(*keys, *"rgba")

    transitions, box = settled(grid.transitions(pixels)), settled(grid.bounds(pixels))
    anchored = voted(cuts.content_spans(transitions, box, sizes, cuts.half_up(unit) if not integer else base, "anchored"), 0.3)
    if integer:
        ends = grid.trailing_empty(grid.block_counts(pixels, base))
        agree = by_runs.select("frame", F.col("clear").alias("r_clear"), F.col("base_pitch").alias("r_base"))
        choice = by_profiles.join(ends, "frame").join(agree, "frame").filter(F.col("clear") & ~F.col("anchored") & ((F.col("score") < 0.75) | (F.col("r_clear") & (F.abs(F.col("r_base") - F.col("base_pitch")) <= 1)))).select("frame")
        regular = grid.vote(by_cut("regularised", choice, base), keys, grid.REGULAR_ALPHA)
        stretched = voted(cuts.content_spans(transitions, box, sizes, base, "elastic"), grid.SAMPLE_ALPHA)
        sampled = stencil.repair(grid.point_sample(pixels, base).withColumnsRenamed({"ty": "y", "tx": "x"})).withColumnsRenamed({"y": "ty", "x": "tx"})
        ordered = [regular, anchored, stretched, sampled]
    else:
        lookup = clustering.quantised(histogram.histogram(pixels, size["w"]), options.colours)
        quantised = pixels.withColumn("key", F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).join(lookup.select("frame", "key", *[F.col(c).alias(f"q_{c}") for c in "rgb"]), ["frame", "key"], "left")
        flat = quantised.select("frame", "y", "x", *[F.when(F.col("a") > 0, F.col(f"q_{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"], "a")
        held = cuts.frame_cuts(profiles, "uniform" if base <= 2 else "snapped", unit)
        ordered = [anchored, grid.vote(grid.by_cuts(flat, held).select(*keys, *"rgba"), keys)]
    # of several strategies the first that has a frame gives all of it
    result = None
    for one in ordered:
        result = one if result is None else result.unionByName(one.join(result.select("frame").distinct(), "frame", "left_anti"))
    return result.select("frame", F.col("ty").alias("y"), F.col("tx").alias("x"), *"rgba"), "ok"


@dataclass(frozen=True)
class Compress:
    clusters: int | None = None
    slots: int = palette.SLOTS
    target: int | None = None
    grey_stops: int = 3
    style: ramps.Style = ramps.Style()


def compress(pixels: DataFrame, options: Compress = Compress()) -> tuple[DataFrame, DataFrame]:
    """(pixels in the new palette, the palette): accents kept as they are, ramps shifted in hue, greys for neutral colours.

    Pixels are touched twice: by the histogram, and by the lookup at the end. All between are tables of colours.
    """
    style = options.style
    counted = settled(histogram.sprite_histogram(pixels))
    entries = settled(palette.entries(counted))
    frames = pixels.agg(F.count_distinct("frame").alias("tf"))
    scores = settled(palette.accent_scores(entries, frames))
    vivid, neutral = palette.chromatic(entries), entries.filter(F.col("chroma") < palette.NEUTRAL)
    n = vivid.count()
    cap = min(options.slots, max(0, (n - 1) // 3))
    taken = settled(palette.accents(scores, max(1, cap // 2) if n >= 4 else 0).select("key", (-F.round("score", 9)).alias("o")))
    grey_stops = options.grey_stops if neutral.head(1) else 0
    alpha = bool((counted.select("alpha_present").first() or [False])[0])
    n_taken, least = taken.count(), 2
    if options.target:
        # accents give way until two stops for each ramp, the greys and the transparent entry fit
        expected = options.clusters or min(MOST_CLUSTERS, max(0, n - n_taken))
        room = options.target - 2 * expected - grey_stops - int(alpha)
        if n_taken > max(0, room):
            n_taken = max(0, room)
            taken = settled(taken.orderBy("o", "key").limit(n_taken))
        least = max(least, min(math.floor(math.sqrt(max(4, options.target - n_taken)) + 0.5), MOST_CLUSTERS))
    pool = palette.without(vivid, taken)
    totals = settled(palette.totals(entries))
    clustered = settled(pool.join(clustering.hue_clusters(pool.withColumn("sprite", F.lit("all")), options.clusters, least=least).select("key", "cluster"), "key"))
    left = max(0, options.slots - n_taken)
    sparse = settled(palette.sparse_clusters(clustered, totals.select("total"), min(left, max(2, left // 2))))
    rest = settled(palette.without(clustered, sparse))
    outliers = settled(palette.cluster_outliers(rest, totals.select("pixel_floor"), max(0, left - sparse.count())))
    clustered = settled(palette.without(rest, outliers))
    # in the order they were found; colours of sparse clusters stay as they are
    part = lambda df, block, order, verbatim: df.select("key", F.lit(block).alias("block"), F.col(order).cast("double").alias("o"), F.lit(verbatim).alias("verbatim"))
    kept = settled(part(taken, 0, "o", False).union(part(sparse, 1, "cluster", True)).union(part(outliers.withColumn("o", -F.col("score")), 2, "o", False)))
    budget = None
    if options.target:
        spans = clustered.groupBy("cluster").agg((F.max("lab_l") - F.min("lab_l")).alias("span")).orderBy("cluster").collect()  # a row per cluster, few
        stops = ramps.stop_budget(options.target - kept.count(), [r["span"] for r in spans], grey_stops, alpha, style.shared_shadow, style.light_end)
        if spans:
            budget = pixels.sparkSession.createDataFrame([(r["cluster"], s) for r, s in zip(spans, stops)], "cluster int, n int")
    made = ramps.chromatic(clustered, budget, style)
    for light in [False] * style.shared_shadow + [True] * style.light_end:
        made = ramps.shared_end(made, light)
    made = settled(made)
    greys = settled(ramps.grey(neutral, grey_stops or None))
    lab = lambda df: df.withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), C.oklab(F.col("r"), F.col("g"), F.col("b")))))
    lookup = palette.remap(clustered.withColumnRenamed("cluster", "ramp"), lab(made)).join(made.select("ramp", "stop", *"rgb"), ["ramp", "stop"]).select("key", *"rgb")
    grey_lookup = palette.remap(neutral.withColumn("ramp", F.lit(-1)), lab(greys).withColumn("ramp", F.lit(-1))).join(greys.select("stop", *"rgb"), "stop").select("key", *"rgb")
    few = ["r", "g", "b", "lab_l", "lab_a", "lab_b"]
    accents = [r.asDict() for r in entries.join(kept, "key").orderBy("block", "o", "key").select("key", "verbatim", *few).collect()]  # at most `slots` rows
    held = [r.asDict() for r in lab(made).orderBy("base_hue", "stop").select(*few).collect()] if accents else []  # at most 16 stops of a few ramps
    new, found = ramps.merged_accents(held, accents)
    session = pixels.sparkSession
    own = session.createDataFrame([(k, e["r"], e["g"], e["b"]) for k, e in found.items()], "key int, r int, g int, b int")
    ranked = session.createDataFrame([(e["r"], e["g"], e["b"], i) for i, e in enumerate(new, 1)], "r int, g int, b int, rank int")
    final = settled(palette.override(lookup.unionByName(grey_lookup), own))
    several = made.select("ramp").distinct().count() > 1
    return palette.apply_lookup(pixels, final), ramps.palette(made, greys, ranked, alpha, style.shared_shadow and several, style.light_end and several)


@dataclass(frozen=True)
class Export:
    name: str = "sprite"
    scale: int | None = 10
    outline: str | None = "4-way"


def export_regions(pixels: DataFrame, slices: DataFrame, width: int, height: int, options: Export = Export()) -> DataFrame:
    """label, frame, name, y, x, r, g, b, a of each region that isn't empty in each frame: cropped, outlined, scaled."""
    regions = export.nonempty(export.regions(slices, width, height), pixels)
    numbered = regions.withColumn("region_idx", F.row_number().over(Window.orderBy("by", "bx", "label")))
    cropped = stencil.crop(pixels, numbered).join(numbered.select("label", "region_idx"), "label")
    # each output is a frame of its own for the stencils
    key = cropped.withColumn("out", F.col("frame")).withColumn("frame", F.struct("region_idx", "frame"))
    image = key.select("frame", "y", "x", *"rgba")
    if options.outline:
        image = stencil.outline(image, options.outline)
    if options.scale:
        image = stencil.upscale(image, options.scale)
    outputs = numbered.select("label", "region_idx").crossJoin(pixels.select("frame").distinct()).withColumn("base", F.lit(options.name))  # every region in every frame
    names = export.numbered(outputs).select("label", "region_idx", "frame", "name")
    flat = image.select(F.col("frame.region_idx").alias("region_idx"), F.col("frame.frame").alias("frame"), "y", "x", *"rgba")
    return flat.join(names, ["region_idx", "frame"]).select("label", "frame", "name", "y", "x", *"rgba")
