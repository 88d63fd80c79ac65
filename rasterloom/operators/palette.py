"""Colours in a perceptual space: accents, clusters, ramps and remapping.

Everything here is a table of distinct colours, which is small beside the pixels; OKLab is worked out once for each
colour and joined back to pixels as a lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions import colour as C

# fixed values
NEUTRAL, ACCENT, SLOTS, FLOOR, GATE, SPARSE = 0.02, 0.80, 8, 0.06, 0.10, 6


def entries(histogram: DataFrame) -> DataFrame:
    """key, r, g, b, w, frames and the colour in OKLab and polar form."""
    light, a, b = C.oklab(F.col("r"), F.col("g"), F.col("b"))
    lab = histogram.select("key", "r", "g", "b", "w", "frames", light.alias("lab_l"), a.alias("lab_a"), b.alias("lab_b"))
    return lab.withColumn("chroma", C.chroma(F.col("lab_a"), F.col("lab_b"))).withColumn("hue", C.hue(F.col("lab_a"), F.col("lab_b")))


def chromatic(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("chroma") >= NEUTRAL)


def totals(entries: DataFrame) -> DataFrame:
    """One row: opaque pixels, and the least count of a colour that isn't noise."""
    total = entries.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("total"))
    return total.withColumn("pixel_floor", F.when(F.col("total") < 512, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("total") / 2000))).cast("long"))


def accent_scores(entries: DataFrame, total_frames: DataFrame) -> DataFrame:
    """key and score of every chromatic colour; none if there are fewer than four. total_frames: one row, tf."""
    pool = chromatic(entries)
    middle = pool.agg(F.expr("percentile(chroma, 0.5)").alias("median"), F.max("w").alias("most"), F.count("*").alias("n"))
    apart = pool.crossJoin(F.broadcast(middle)).filter("n >= 4")  # one row
    spread = apart.agg(F.expr("percentile(abs(chroma - median), 0.5)").alias("mad"))
    rows = apart.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(totals(entries))).crossJoin(F.broadcast(total_frames))  # one row each
    sigma = F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(1e-4))
    tf = F.greatest(F.lit(1), F.col("tf"))
    gated = (F.col("w") < F.col("pixel_floor")) | (F.col("w") >= F.greatest(F.lit(1.0), F.col("total") * 0.12)) | ((tf > 1) & (F.col("frames") == 1) & (F.col("w") <= 2))
    strong = C.clamp((F.col("chroma") - F.col("median")) / sigma / 3.0, 0.0, 1.0)
    steady = F.lit(0.85) + F.lit(0.15) * F.least(F.lit(1.0), F.col("frames") / F.greatest(F.lit(2.0), tf * 0.5))
    return rows.select("key", "chroma", "w", F.when(gated, 0.0).otherwise(strong * steady).alias("score"))


def accents(scores: DataFrame, slots: int, threshold: float = ACCENT) -> DataFrame:
    """The highest scores over the threshold; ties to the smaller key."""
    return scores.filter(F.col("score") >= threshold).orderBy(F.desc(F.round("score", 9)), "key").limit(slots)


def cluster_outliers(clustered: DataFrame, pixel_floor: DataFrame, slots: int) -> DataFrame:
    """Of clusters of three or more colours those far more vivid than their cluster's median, the best over all clusters.

    clustered: entries with cluster; pixel_floor: one row.
    """
    medians = clustered.groupBy("cluster").agg(F.expr("percentile(chroma, 0.5)").alias("median"), F.count("*").alias("n")).filter("n >= 3")
    vivid = clustered.join(medians, "cluster").crossJoin(F.broadcast(pixel_floor)).filter((F.col("chroma") > F.greatest(F.lit(FLOOR), F.col("median") * 1.8)) & (F.col("w") >= F.col("pixel_floor")))
    score = F.col("chroma") * (F.lit(1.0) + F.log(F.lit(1.0) + F.col("w")))
    return vivid.select("cluster", "key", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "key").limit(slots)


def sparse_clusters(clustered: DataFrame, totals: DataFrame, slots: int) -> DataFrame:
    """The vivid members of small, light clusters, in order of cluster and key, as far as slots go."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("w").alias("mass"), F.max("chroma").alias("most"))
    small = sizes.crossJoin(F.broadcast(totals)).filter((F.col("n") <= SPARSE) & (F.col("mass") <= F.least(F.col("total") * 0.02, F.lit(64.0))) & (F.col("most") >= GATE))
    return clustered.join(small.select("cluster"), "cluster").filter(F.col("chroma") >= FLOOR).select("cluster", "key").orderBy("cluster", "key").limit(slots)


def without(entries: DataFrame, taken: DataFrame) -> DataFrame:
    return entries.join(taken.select("key"), "key", "left_anti")


def nearest_rank(column: str, share: float) -> Column:
    """An aggregate: the value in place round(share * (n - 1)), unweighted."""
    values = F.array_sort(F.collect_list(column))
    return F.get(values, F.round(F.lit(share) * (F.size(values) - 1)).cast("int"))


def circular_mean(hue: str, weight: str) -> Column:
    """An aggregate: the weighted mean angle, 0 if nothing is left of it."""
    x, y = F.sum(F.cos(F.radians(hue)) * F.col(weight)), F.sum(F.sin(F.radians(hue)) * F.col(weight))
    angle = F.degrees(F.atan2(y, x))
    return F.when((x == 0) & (y == 0), 0.0).when(angle < 0, angle + 360).otherwise(angle)


def anchors(stops: DataFrame) -> DataFrame:
    """One row: the weighted mean of one stop per ramp; stops: lab_l, lab_a, lab_b, weight."""
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1)
    return stops.agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in ("lab_l", "lab_a", "lab_b")])


def remap(entries: DataFrame, stops: DataFrame) -> DataFrame:
    """key, stop: for each colour the nearest stop of its own ramp; ties to the first. An equi-join on the ramp."""
    mine = stops.select("ramp", "stop", *[F.col(c).alias(f"s_{c}") for c in ("lab_l", "lab_a", "lab_b")])
    d2 = C.distance2((F.col("lab_l"), F.col("lab_a"), F.col("lab_b")), (F.col("s_lab_l"), F.col("s_lab_a"), F.col("s_lab_b")))
    near = entries.join(mine, "ramp").groupBy("key", "ramp").agg(F.min(F.struct(F.round(d2, 12).alias("d2"), "stop")).alias("best"))
    return near.select("key", "ramp", F.col("best.stop").alias("stop"))


def apply_lookup(pixels: DataFrame, lookup: DataFrame) -> DataFrame:
    """pixels with the colours of lookup (key, r, g, b); alpha stays, and so do pixels without an entry."""
    new = lookup.select("key", *[F.col(c).alias(f"n_{c}") for c in "rgb"])
    keyed = pixels.withColumn("key", F.when(F.col("a") > 0, F.col("r") * 65536 + F.col("g") * 256 + F.col("b")))
    return keyed.join(new, "key", "left").select("frame", "y", "x", *[F.coalesce(f"n_{c}", c).alias(c) for c in "rgb"], "a")


def override(base: DataFrame, winning: DataFrame) -> DataFrame:
    """Union of two lookups (key, r, g, b) in which the second wins."""
    return winning.unionByName(base.join(winning.select("key"), "key", "left_anti"))


def survival(source: DataFrame, output: DataFrame, least: float = 0.08, near: float = 0.04) -> DataFrame:
    """key, distance, survived: vivid source colours and their nearest output colour. Both are small tables of colours."""
    out = output.select(*[F.col(c).alias(f"s_{c}") for c in ("lab_l", "lab_a", "lab_b")])
    d2 = C.distance2((F.col("lab_l"), F.col("lab_a"), F.col("lab_b")), (F.col("s_lab_l"), F.col("s_lab_a"), F.col("s_lab_b")))
    best = source.filter(F.col("chroma") > least).crossJoin(out).groupBy("key").agg(F.sqrt(F.min(d2)).alias("distance"))
    return best.select("key", "distance", (F.col("distance") <= near).alias("survived"))
