"""Ramps of colours: chromatic and grey, their stops, shared ends and the budget of stops."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.functions import colour as C
from rasterloom.operators.palette import circular_mean, nearest_rank
from rasterloom.sources.scratch import settled

# fixed values
DARK, MOST, DARK_BELL, GREY_STOPS = 0.15, 16, 0.25, 5
#: The light end and the least chroma of light stops, with and without contrast preserved.
LIGHT, LIGHT_BELL = {True: 0.86, False: 0.92}, {True: 0.45, False: 0.25}


@dataclass(frozen=True)
class Style:
    """How ramps are made. strength: from 0, as in the source, to 1, all of the shift. Attractors are hues in degrees."""

    strength: float = 0.5
    preserve_contrast: bool = True
    warm: float = 70.0
    cool: float = 250.0
    highlight_pull: float = 0.25
    shadow_pull: float = 0.35
    ceiling: float = 0.30
    shared_shadow: bool = True
    shared_highlight: bool = False

    @property
    def amount(self) -> float:
        return min(max(self.strength, 0.0), 1.0)

    @property
    def light_end(self) -> bool:
        """Whether ramps share their last stop: never with contrast preserved."""
        return self.shared_highlight and not self.preserve_contrast




def _spread(low: Column, high: Column, by: float) -> tuple[Column, Column]:
    thin = high - low < 0.05
    return F.when(thin, F.greatest(F.lit(0.0), low - by)).otherwise(low), F.when(thin, F.least(F.lit(1.0), high + by)).otherwise(high)


def chromatic(clustered: DataFrame, stops: DataFrame | None = None, style: Style = Style()) -> DataFrame:
    """ramp, stop (from 1), base_hue, weight, lightness, chroma, hue and r, g, b. clustered: entries with cluster.

    stops: cluster and n, the stops it gets; without it they follow the cluster's range of lightness.
    """
    many = F.count("*") >= 8
    ramps = clustered.groupBy("cluster").agg(
        nearest_rank("lab_l", 0.05).alias("p5"), nearest_rank("lab_l", 0.95).alias("p95"), F.when(many, nearest_rank("chroma", 0.90)).otherwise(nearest_rank("chroma", 0.75)).alias("vivid"),
        circular_mean("hue", "w").alias("base_hue"), F.sum("w").alias("weight"))
    low, high = _spread(F.col("p5"), F.col("p95"), 0.08)
    ramps = ramps.withColumn("low", C.lerp(low, F.lit(DARK), F.lit(style.amount))).withColumn("high", C.lerp(high, F.lit(LIGHT[style.preserve_contrast]), F.lit(style.amount))).withColumn("vivid", C.clamp(F.col("vivid"), 0.01, style.ceiling))
    span = F.col("high") - F.col("low")
    own = F.when(span >= 0.5, 5).when(span >= 0.3, 4).when(span >= 0.15, 3).otherwise(2)
    ramps = ramps.join(stops, "cluster", "left").withColumn("n", F.least(F.greatest(F.coalesce(F.when(F.col("n") > 0, F.col("n")), own), F.lit(2)), F.lit(MOST))) if stops is not None else ramps.withColumn("n", own)
    rows = ramps.withColumn("stop", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("t", (F.col("stop") - 1) / (F.col("n") - 1))
    t = F.col("t")
    bell = F.greatest(F.when(t >= 0.5, LIGHT_BELL[style.preserve_contrast]).otherwise(DARK_BELL), F.lit(1.0) - 4 * (t - 0.5) * (t - 0.5))
    pulled = F.when(t < 0.5, C.lerp_hue(F.col("base_hue"), F.lit(style.cool), style.shadow_pull * style.amount * (0.5 - t) * 2)).when(t > 0.5, C.lerp_hue(F.col("base_hue"), F.lit(style.warm), style.highlight_pull * style.amount * (t - 0.5) * 2)).otherwise(F.col("base_hue"))
    rows = rows.select(F.col("cluster").alias("ramp"), "stop", "n", "base_hue", "weight", C.lerp(F.col("low"), F.col("high"), C.smoothstep(t)).alias("lightness"), (F.col("vivid") * bell).alias("wanted"), pulled.alias("hue"))
    rows = settled(rows)  # a few rows; without it each use of a column repeats its whole expression
    return settled(rendered(settled(rows.withColumn("chroma", C.gamut_chroma(F.col("lightness"), F.col("wanted"), F.col("hue"))).drop("wanted"))))


def rendered(stops: DataFrame) -> DataFrame:
    """stops with r, g, b of their lightness, chroma and hue."""
    a, b = F.col("chroma") * F.cos(F.radians("hue")), F.col("chroma") * F.sin(F.radians("hue"))
    return stops.withColumns(dict(zip("rgb", map(C.channel, C.linear_rgb(F.col("lightness"), a, b)))))


def shared_end(stops: DataFrame, light: bool = False) -> DataFrame:
    """stops with the first (or last) stop of all ramps replaced by their weighted mean colour, where there are two ramps or more."""
    end = F.col("stop") == (F.col("n") if light else 1)
    first = stops.filter(end)
    labs = first.select(*[c.alias(n) for c, n in zip(C.oklab(F.col("r"), F.col("g"), F.col("b")), ("lab_l", "lab_a", "lab_b"))], F.when(F.col("weight") > 0, F.col("weight")).otherwise(1).alias("w"))
    mean = labs.agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in ("lab_l", "lab_a", "lab_b")], F.count("*").alias("ramps"))
    polar = settled(mean.select("ramps", F.col("lab_l").alias("m_l"), C.chroma(F.col("lab_a"), F.col("lab_b")).alias("m_c"), C.hue(F.col("lab_a"), F.col("lab_b")).alias("m_h")))
    polar = settled(polar.withColumn("m_c", C.gamut_chroma(F.col("m_l"), F.col("m_c"), F.col("m_h"))))
    taken = (F.col("ramps") >= 2) & end
    rows = stops.crossJoin(F.broadcast(polar))  # one row
    new = rows.withColumn("lightness", F.when(taken, F.col("m_l")).otherwise(F.col("lightness"))).withColumn("chroma", F.when(taken, F.col("m_c")).otherwise(F.col("chroma"))).withColumn("hue", F.when(taken, F.col("m_h")).otherwise(F.col("hue")))
    return settled(rendered(settled(new.drop("m_l", "m_c", "m_h", "ramps", "r", "g", "b"))))


def grey(neutral: DataFrame, n: int | None = None) -> DataFrame:
    """stop, lightness and r, g, b of the grey ramp of neutral entries (lab_l); no rows without entries."""
    ends = neutral.agg(nearest_rank("lab_l", 0.05).alias("p5"), nearest_rank("lab_l", 0.95).alias("p95")).filter("p5 is not null")
    low, high = _spread(F.col("p5"), F.col("p95"), 0.05)
    own = F.floor((F.col("high") - F.col("low")) / 0.18) + 2
    rows = ends.select(low.alias("low"), high.alias("high")).withColumn("n", C.clamp(F.lit(n) if n else own, 2, GREY_STOPS).cast("int"))
    rows = rows.withColumn("stop", F.explode(F.sequence(F.lit(1), "n")))
    light = C.lerp(F.col("low"), F.col("high"), C.smoothstep((F.col("stop") - 1) / (F.col("n") - 1)))
    # settled in between: in one projection with the explode above, colours were sometimes those of the row before
    return settled(rendered(settled(rows.select("stop", light.alias("lightness"), F.lit(0.0).alias("chroma"), F.lit(0.0).alias("hue")))))


def stop_budget(target: int, spans: list[float], grey_stops: int, alpha: bool, dark: bool, light: bool) -> list[int]:
    """Stops of each ramp so that the palette comes to target; what is left goes to the ramps with the widest range, in turn."""
    n = len(spans)
    if not n:
        return []
    saved = (int(dark) + int(light)) * (n - 1) if n >= 2 else 0
    fixed = grey_stops + int(alpha) - saved
    stops = [min(max(math.floor((target - fixed) / n + 0.5), 2), MOST)] * n
    order = sorted(range(n), key=lambda i: (-spans[i], i))
    while sum(stops) + fixed < target and any(s < MOST for s in stops):
        for i in order:
            if stops[i] < MOST and sum(stops) + fixed < target:
                stops[i] += 1
    return stops


def merged_accents(held: list[dict], accents: list[dict], tolerance: float = 0.04) -> tuple[list[dict], dict[int, dict]]:
    """(accents that need an entry of their own, the entry that stands for each accent's key).

    In order: an accent with the colour of an entry in `held` takes that; one that isn't verbatim takes the nearest entry
    within the tolerance, accents before it included. Both lists hold r, g, b, lab_l, lab_a, lab_b; both are a few rows.
    """
    lab = ("lab_l", "lab_a", "lab_b")
    exact: dict[tuple, dict] = {}
    for e in held:
        exact.setdefault((e["r"], e["g"], e["b"]), e)
    entries, new, found = list(held), [], {}
    for a in accents:
        match = exact.get((a["r"], a["g"], a["b"]))
        if match is None and not a["verbatim"] and entries:
            near = min(entries, key=lambda e: sum((e[c] - a[c]) ** 2 for c in lab))
            if sum((near[c] - a[c]) ** 2 for c in lab) <= tolerance**2:
                match = near
        if match is None:
            match = a
            entries.append(a)
            new.append(a)
        found[a["key"]] = match
    return new, found


def palette(stops: DataFrame, grey_stops: DataFrame, accents: DataFrame, alpha: bool, shared: bool = True, light: bool = False) -> DataFrame:
    """idx, kind, ramp, stop, r, g, b, a in the palette's order: transparent, shared dark, ramps by hue, shared light, accents, greys.

    accents: r, g, b and rank, those that merged_accents gave an entry of their own.
    """
    spark = stops.sparkSession
    part = lambda df, block, kind, hue, ramp, stop: df.select(F.lit(block).alias("block"), F.lit(kind).alias("kind"), hue.cast("double").alias("o1"), ramp.cast("int").alias("ramp"), stop.cast("int").alias("stop"), *[F.col(c).cast("int").alias(c) for c in "rgb"], F.lit(255).alias("a"))
    none = F.lit(None)
    own = stops.filter("stop > 1") if shared else stops
    rows = part(own.filter("stop < n") if light else own, 2, "ramp", F.col("base_hue"), F.col("ramp"), F.col("stop"))
    if light:
        rows = rows.unionByName(part(stops.filter("stop = n").orderBy("ramp").limit(1), 3, "shared", F.lit(0), none, none))
    if shared:
        rows = rows.unionByName(part(stops.filter("stop = 1").orderBy("ramp").limit(1), 1, "shared", F.lit(0), none, none))
    greys = part(grey_stops, 5, "grey", F.lit(0), none, F.col("stop"))
    rows = rows.unionByName(part(accents, 4, "accent", F.col("rank"), none, F.col("rank"))).unionByName(greys)
    if alpha:
        clear = spark.range(1).select(F.lit(0).alias("block"), F.lit("transparent").alias("kind"), F.lit(0.0).alias("o1"), none.cast("int").alias("ramp"), none.cast("int").alias("stop"), *[F.lit(0).alias(c) for c in "rgb"], F.lit(0).alias("a"))
        rows = rows.unionByName(clear)
    order = Window.orderBy("block", "o1", "ramp", "stop")
    return rows.select((F.row_number().over(order) - 1).alias("idx"), "kind", "ramp", "stop", *"rgba")
