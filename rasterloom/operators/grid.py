"""Cells of a grid over frames: cuts, votes, block counts, transitions and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.operators.histogram import opaque

# fixed values
SAMPLE_ALPHA, REGULAR_ALPHA = 0.16, 0.30
DRIFT_PITCH, LARGE, UPPER, LARGE_UPPER, LOWER = 5, 48, 0.5, 0.7, 0
PEAK_LOW, PEAK_HIGH, TAIL, COVER = 0.35, 0.8, 0.25, 1.6
COLUMN_SHARE, OFFSET_X, OFFSET_Y = 0.58, 0.0, 0.25


def sanitised(cuts: Column, limit: Column) -> Column:
    """Clamped, distinct, sorted, with 0 and the limit."""
    held = F.transform(cuts, lambda c: F.least(F.greatest(c, F.lit(0)), limit).cast("int"))
    return F.array_sort(F.array_distinct(F.concat(held, F.array(F.lit(0), limit.cast("int")))))


def uniform_cuts(limit: Column, cells: Column) -> Column:
    n = F.least(F.greatest(cells, F.lit(1)), F.greatest(limit, F.lit(1)))
    return F.when(limit == 0, F.array(F.lit(0))).otherwise(sanitised(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.floor(limit * i / n)), limit))


def key_text() -> Column:
    """Votes that tie go to the smallest colour as text, so 10,... comes before 9,..."""
    return F.concat_ws(",", "r", "g", "b", "a")


def vote(cells: DataFrame, keys: list[str], share: float | None = None) -> DataFrame:
    """The most frequent colour of each cell: keys, r, g, b, a, for rows (keys, r, g, b, a).

    With share only opaque pixels vote, and a cell with fewer than that share of them is transparent. Counts are
    made map-side, so a cell's pixels never meet as rows.
    """
    counts = cells.groupBy(*keys, "r", "g", "b", "a").agg(F.count("*").alias("n"))
    votes = F.col("a") > 0 if share is not None else F.lit(True)
    best = F.min(F.when(votes, F.struct((-F.col("n")).alias("m"), key_text().alias("t"), "r", "g", "b", "a")))
    voted = counts.groupBy(*keys).agg(best.alias("best"), F.sum("n").alias("area"), F.coalesce(F.sum(F.when(F.col("a") > 0, F.col("n"))), F.lit(0)).alias("opaque"))
    enough = F.col("opaque") >= F.greatest(F.round(F.col("area") * share), F.lit(1)) if share is not None else F.lit(True)
    return voted.select(*keys, *[F.when(enough, F.col(f"best.{c}")).otherwise(0).cast("int").alias(c) for c in "rgba"])


def cells(pixels: DataFrame, pitch: int) -> DataFrame:
    """pixels with ty, tx: their cell of a grid of this pitch."""
    return pixels.withColumn("ty", F.expr(f"y div {pitch}").cast("int")).withColumn("tx", F.expr(f"x div {pitch}").cast("int"))


def by_cuts(pixels: DataFrame, cuts: DataFrame) -> DataFrame:
    """pixels with ty, tx by cut lists: frame, axis, cuts. Each axis is spread to places first, so these are equi-joins."""
    spans = cuts.select("frame", "axis", F.posexplode("cuts").alias("i", "start")).withColumn("end", F.lead("start").over(Window.partitionBy("frame", "axis").orderBy("i")))
    places = spans.filter("end > start").select("frame", "axis", "i", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at"))
    axis = lambda name, cell: places.filter(F.col("axis") == name).select("frame", F.col("at").alias(name), F.col("i").alias(cell))
    return pixels.join(axis("x", "tx"), ["frame", "x"]).join(axis("y", "ty"), ["frame", "y"])


def first_seen_vote(cells: DataFrame, keys: list[str], share: float = 0.3) -> DataFrame:
    """keys, r, g, b, a: the most frequent opaque colour of each cell, of equals the one seen first in reading order; a cell
    with less than that share of opaque pixels, unrounded, is transparent. cells: keys, y, x, r, g, b, a."""
    counts = cells.groupBy(*keys, *"rgba").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("first"))
    best = F.min(F.when(F.col("a") > 0, F.struct((-F.col("n")).alias("m"), "first", "r", "g", "b", "a")))
    voted = counts.groupBy(*keys).agg(best.alias("best"), F.sum("n").alias("area"), F.coalesce(F.sum(F.when(F.col("a") > 0, F.col("n"))), F.lit(0)).alias("opaque"))
    enough = (F.col("opaque") > 0) & (F.col("opaque") >= F.col("area") * share)
    return voted.select(*keys, *[F.when(enough, F.col(f"best.{c}")).otherwise(0).cast("int").alias(c) for c in "rgba"])


def spread_widths(span: Column, cells: Column) -> Column:
    """The widths of so many cells over a span: the pixels left over go to cells spread evenly, not to the first ones."""
    base, rest = F.floor(span / cells), F.pmod(span, cells)
    wider = F.transform(F.sequence(F.lit(0), F.greatest(rest - 1, F.lit(0)).cast("int")), lambda i: F.floor(i * (cells / rest)))
    one = lambda i: (base + F.when((rest > 0) & F.array_contains(wider, i.cast("long")), 1).otherwise(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), (cells - 1).cast("int")), one)


def boundaries(start: Column, widths: Column) -> Column:
    """(start, end) of cells of these widths one after the other."""
    upto = lambda i: F.aggregate(F.slice(widths, F.lit(1), i), start.cast("int"), lambda s, w: s + w)
    return F.transform(widths, lambda w, i: F.struct(upto(i).alias("start"), (upto(i) + w).alias("end")))


def transitions(pixels: DataFrame, tolerance: int = 0) -> DataFrame:
    """frame, axis, boundary: where some pair across it is opaque on both sides and differs by more than the tolerance in
    some channel."""

    def axis(name: str, along: str, across: str) -> DataFrame:
        w = Window.partitionBy("frame", across).orderBy(along)
        after = F.lead(F.struct("r", "g", "b", "a")).over(w)
        changed = (F.col("a") > 0) & (after["a"] > 0) & (F.greatest(*[F.abs(F.col(c) - after[c]) for c in "rgb"]) > tolerance)
        return pixels.select("frame", F.lit(name).alias("axis"), (F.col(along) + 1).alias("boundary"), changed.alias("changed")).filter("changed").select("frame", "axis", "boundary").distinct()

    return axis("x", "x", "y").unionByName(axis("y", "y", "x"))


def bounds(pixels: DataFrame) -> DataFrame:
    """The box of opaque pixels of each frame that has any."""
    return opaque(pixels).groupBy("frame").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def block_counts(pixels: DataFrame, pitch: int, along: str = "y") -> DataFrame:
    """frame, block, cnt: opaque pixels of each row (or column) of blocks, 0 included."""
    size = pixels.groupBy("frame", F.expr(f"{along} div {pitch}").cast("int").alias("block"))
    return size.agg(F.sum((F.col("a") > 0).cast("long")).alias("cnt"))


def trailing_empty(counts: DataFrame) -> DataFrame:
    """frame, trailing, anchored: empty block rows at the bottom; anchored when there are none."""
    last = counts.groupBy("frame").agg((F.max("block") + 1).alias("n"), F.max(F.when(F.col("cnt") > 0, F.col("block"))).alias("last"))
    trailing = F.col("n") - 1 - F.coalesce("last", F.lit(-1))
    return last.select("frame", trailing.cast("int").alias("trailing"), (trailing == 0).alias("anchored"))


def _peaks(counts: DataFrame, last: bool) -> DataFrame:
    place = F.col("block") if last else -F.col("block")
    return counts.groupBy("frame").agg(F.max(F.struct("cnt", place.alias("p"), "block")).alias("top"), (F.max("block") + 1).alias("n")).select("frame", "n", F.col("top.cnt").alias("peak_cnt"), F.col("top.block").alias("peak"))


def _tailed(counts: DataFrame, peaks: DataFrame) -> DataFrame:
    """peaks with `tapers`: the peak stands well above the mean of the rows at the bottom."""
    start = F.greatest(F.col("n") - F.greatest(F.floor(F.col("n") * TAIL), F.lit(4)), F.col("peak") + 1)
    tail = counts.join(peaks, "frame").filter(F.col("block") >= start).groupBy("frame").agg(F.avg("cnt").alias("tail"))
    return peaks.join(tail, "frame", "left").withColumn("tapers", (F.col("peak_cnt") > 0) & (F.coalesce("tail", F.lit(0.0)) > 0) & (F.col("peak_cnt") >= F.col("tail") * COVER))


def row_offsets(pixels: DataFrame, pitch: int) -> DataFrame:
    """frame, block, offset, used_drift: the place in each block row that is sampled."""
    default = min(max(int(pitch * OFFSET_Y), 0), max(pitch - 1, 0))
    counts = block_counts(pixels, pitch)
    if pitch < DRIFT_PITCH:
        return counts.select("frame", "block", F.lit(default).alias("offset"), F.lit(False).alias("used_drift"))
    peaks = _tailed(counts, _peaks(counts, True))
    first = opaque(pixels).groupBy("frame").agg(F.expr(f"min(y) div {pitch}").alias("first"))
    cuts = transitions(pixels).filter("axis = 'y'").groupBy("frame").agg(F.array_sort(F.collect_list("boundary")).alias("cuts"))
    rows = peaks.join(first, "frame", "left").join(cuts, "frame", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    half = F.floor((F.col("first") + F.col("peak")) / 2) - F.col("first")
    drifts = (F.size("cuts") > half) & (half > 0)
    drift = F.get("cuts", half.cast("int")) - F.get("cuts", F.lit(0)) - half * pitch
    share = F.when(F.col("n") >= LARGE, F.round(F.lit(pitch * LARGE_UPPER))).otherwise(F.round(F.lit(pitch * UPPER)))
    upper = F.least(F.greatest(F.when(drifts, F.pmod(-drift, F.lit(pitch))).otherwise(share), F.lit(0)), F.lit(pitch - 1)).cast("int")
    moved = F.col("tapers") & (F.col("n") >= 8) & (F.col("peak") >= F.floor(F.col("n") * PEAK_LOW)) & (F.col("peak") <= F.ceil(F.col("n") * PEAK_HIGH))
    rows = rows.select("frame", "peak", F.coalesce(moved, F.lit(False)).alias("moved"), upper.alias("upper"), drifts.alias("drifts"))
    offset = F.when(~F.col("moved"), default).when(F.col("block") <= F.col("peak"), F.col("upper")).otherwise(LOWER)
    return counts.join(rows, "frame").select("frame", "block", offset.cast("int").alias("offset"), (F.col("moved") & F.coalesce("drifts", F.lit(False))).alias("used_drift"))


def row_phases(pixels: DataFrame, pitch: int) -> DataFrame:
    """frame, block, phase: pitch - 1 above the first rebound after the peak in large frames, else 0."""
    counts = block_counts(pixels, pitch)
    peaks = _tailed(counts, _peaks(counts, True))
    before = F.lag("cnt").over(Window.partitionBy("frame").orderBy("block"))
    risen = counts.withColumn("before", before).join(peaks, "frame").filter("block > peak and cnt > before").groupBy("frame").agg(F.min("block").alias("rebound"))
    rows = peaks.join(risen, "frame", "left")
    on = F.col("tapers") & (F.col("n") >= LARGE) & (F.col("block") < F.col("rebound"))
    return counts.join(rows, "frame").select("frame", "block", F.when(on, pitch - 1).otherwise(0).cast("int").alias("phase"))


def column_offsets(pixels: DataFrame, pitch: int) -> DataFrame:
    """frame, block, offset: pitch - 1 left of the last thin column before the peak in large frames, else the default."""
    default = min(max(int(pitch * OFFSET_X), 0), max(pitch - 1, 0))
    counts = block_counts(pixels, pitch, "x")
    peaks = _peaks(counts, False)
    thin = counts.join(peaks, "frame").filter(F.col("block") <= F.col("peak")).filter(F.col("cnt") < F.col("peak_cnt") * COLUMN_SHARE).groupBy("frame").agg((F.max("block") + 1).alias("split"))
    on = (F.col("n") >= LARGE) & (F.col("peak_cnt") > 0) & (F.col("split") < F.col("n")) & (F.col("block") < F.col("split")) if pitch >= DRIFT_PITCH else F.lit(False)
    return counts.join(peaks.join(thin, "frame", "left"), "frame").select("frame", "block", F.when(on, pitch - 1).otherwise(default).cast("int").alias("offset"))


def point_sample(pixels: DataFrame, pitch: int) -> DataFrame:
    """Each cell's pixel at its offsets; the most frequent opaque one where that is transparent; nothing where the cell is.

    frame, ty, tx, r, g, b, a.
    """
    from rasterloom.sources.pixels import with_frame_size

    rows = row_offsets(pixels, pitch).withColumnRenamed("offset", "oy")
    phases = row_phases(pixels, pitch)
    rows = rows.join(phases, ["frame", "block"]).select("frame", F.col("block").alias("ty"), "oy", F.when(F.col("used_drift"), 0).otherwise(F.col("phase")).alias("phase"))
    columns = column_offsets(pixels, pitch).select("frame", F.col("block").alias("tx"), F.col("offset").alias("ox"))
    sized = with_frame_size(pixels)
    # a row's phase shifts its cell down, so a pixel may lie in two rows' cells or in none
    spans = rows.join(sized.select("frame", "height").distinct(), "frame").select("frame", "ty", "oy", (F.col("ty") * pitch + F.col("phase")).alias("ys"), F.least(F.col("ty") * pitch + F.col("phase") + pitch, F.col("height")).alias("ye"))
    spans = spans.filter("ye > ys").select("frame", "ty", "ys", "ye", "oy", F.explode(F.sequence(F.col("ys"), F.col("ye") - 1)).alias("y"))
    at = sized.withColumn("tx", F.expr(f"x div {pitch}").cast("int")).filter(F.col("tx") < F.expr(f"width div {pitch}")).join(spans, ["frame", "y"]).join(columns, ["frame", "tx"])
    at = at.filter(F.col("ty") < F.expr(f"height div {pitch}"))
    counts = at.groupBy("frame", "ty", "tx").agg(
        F.sum((F.col("a") > 0).cast("int")).alias("opaque"),
        F.max(F.when((F.col("x") == F.least(F.col("tx") * pitch + F.col("ox"), F.col("width") - 1)) & (F.col("y") == F.least(F.col("ys") + F.col("oy"), F.col("ye") - 1)), F.struct("r", "g", "b", "a"))).alias("p"))
    voted = vote(at.select("frame", "ty", "tx", "r", "g", "b", "a"), ["frame", "ty", "tx"], 0.0)
    least = max(int(pitch * pitch * SAMPLE_ALPHA + 0.5), 1)
    pick = lambda c: F.when(F.col("opaque") < least, 0).when(F.col("p.a") > 0, F.col(f"p.{c}")).otherwise(F.col(f"v_{c}")).cast("int").alias(c)
    return counts.join(voted.select("frame", "ty", "tx", *[F.col(c).alias(f"v_{c}") for c in "rgba"]), ["frame", "ty", "tx"]).select("frame", "ty", "tx", *[pick(c) for c in "rgba"])
