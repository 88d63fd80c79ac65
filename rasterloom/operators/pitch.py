"""The size of the source's pixels: from run lengths, from profiles, and both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values
LEAST, TOLERANCE_SHARE, TOLERANCE = 2, 0.35, 1.0
SUPPORT, UNIT_RUNS, MARGIN, TIE = 0.55, 0.45, 1.15, 0.0001
PROFILE_MOST, PROFILE_SCORE, HARMONIC, REFINE = 32, 0.35, 0.97, 0.5
MOST_RATIO = 1.8


def _multiple(length: Column, unit: Column) -> Column:
    return F.greatest(F.round(length / unit), F.lit(1))


def _tolerance(unit: Column) -> Column:
    return F.greatest(unit * TOLERANCE_SHARE, F.lit(TOLERANCE))


def scores(runs: DataFrame) -> DataFrame:
    """frame, candidate, score, support for candidates from 2 to the longest run of the frame.

    Both sides of the range join are a frame's few distinct lengths; it is an equi-join on frame.
    """
    most = runs.groupBy("frame").agg(F.max("len").alias("most"))
    candidates = most.filter(f"most >= {LEAST}").select("frame", F.explode(F.sequence(F.lit(LEAST).cast("long"), "most")).alias("candidate"))
    pairs = candidates.join(runs, "frame").filter("len >= candidate")
    multiple = _multiple(F.col("len"), F.col("candidate"))
    error, tolerance = F.abs(F.col("len") - F.col("candidate") * multiple), _tolerance(F.col("candidate"))
    found = pairs.select("frame", "candidate", "cnt", multiple.alias("multiple"), error.alias("error"), tolerance.alias("tolerance")).filter("error <= tolerance")
    part = F.col("cnt") * F.col("candidate") * (1.0 - F.col("error") / F.col("tolerance")) / F.col("multiple")
    return found.groupBy("frame", "candidate").agg(F.sum(part).alias("score"), F.sum("cnt").alias("support"))


def from_runs(runs: DataFrame) -> DataFrame:
    """One row per frame: base_pitch, pitch, clear, support_ratio, score_margin, unit_run_ratio.

    The best two candidates come from a fold in the order of candidates, as a near tie depends on that order.
    """
    total = runs.groupBy("frame").agg(F.sum("cnt").alias("total"), F.coalesce(F.sum(F.when(F.col("len") == 1, F.col("cnt"))), F.lit(0)).alias("units"))
    listed = scores(runs).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("candidate", "score", "support"))).alias("all"))

    def keep(state: Column, c: Column) -> Column:
        wins = state["candidate"].isNull() | (c["score"] > state["score"]) | ((F.abs(c["score"] - state["score"]) < TIE) & (c["candidate"] > state["candidate"]))
        pick = lambda name: F.when(wins, c[name]).otherwise(state[name]).alias(name)
        second = F.when(wins, state["score"]).otherwise(F.greatest(state["second"], c["score"]))
        return F.struct(pick("candidate"), pick("score"), pick("support"), second.alias("second"))

    start = F.struct(F.lit(None).cast("long").alias("candidate"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("support"), F.lit(0.0).alias("second"))
    best = total.join(listed, "frame", "left").select("frame", "total", "units", F.aggregate(F.coalesce("all", F.array().cast("array<struct<candidate:long,score:double,support:long>>")), start, keep).alias("b"))
    flat = best.select("frame", "total", "units", F.coalesce(F.col("b.candidate").cast("double"), F.lit(1.0)).alias("base_pitch"), F.col("b.candidate").isNotNull().alias("any"), F.col("b.score").alias("score"), F.col("b.support").alias("support"), F.col("b.second").alias("second"))
    refined = refine(flat.select("frame", "base_pitch"), runs)
    ratio = F.when(F.col("any"), F.col("support") / F.col("total")).otherwise(0.0)
    margin = F.when(~F.col("any"), 0.0).when(F.col("second") <= 0, float("inf")).otherwise(F.col("score") / F.nullif(F.col("second"), F.lit(0.0)))
    unit = F.col("units") / F.col("total")
    rows = flat.join(refined, "frame").select("frame", "base_pitch", F.when(F.col("any"), F.col("refined")).otherwise(1.0).alias("pitch"), ratio.alias("support_ratio"), margin.alias("score_margin"), unit.alias("unit_run_ratio"), "any")
    return rows.withColumn("clear", F.col("any") & (F.col("support_ratio") >= SUPPORT) & (F.col("unit_run_ratio") <= UNIT_RUNS) & (F.col("score_margin") >= MARGIN)).drop("any")


def refine(bases: DataFrame, runs: DataFrame) -> DataFrame:
    """frame, refined: the weighted mean of len / multiple over the runs near a multiple of the base; else the base."""
    unit = F.col("len") / _multiple(F.col("len"), F.col("base_pitch"))
    near = bases.join(runs, "frame", "left").withColumn("unit", unit).withColumn("w", F.when(F.abs(F.col("unit") - F.col("base_pitch")) <= _tolerance(F.col("base_pitch")), F.col("cnt")))
    mean = F.sum(F.col("unit") * F.col("w")) / F.sum("w")
    return near.groupBy("frame", "base_pitch").agg(mean.alias("mean")).select("frame", F.coalesce("mean", "base_pitch").alias("refined"))


def autocorrelation(series: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, period, r for series (keys, values array<double>): correlation with itself shifted; 0 if a side is constant."""
    periods = series.select(*keys, "values", F.explode(F.sequence(F.lit(LEAST), F.least(F.lit(most), F.greatest(F.size("values") - 2, F.lit(LEAST))))).alias("period"))
    n = F.size("values") - F.col("period")
    sides = periods.withColumn("n", n).filter("n >= 2").withColumn("p", F.slice("values", F.lit(1), F.col("n"))).withColumn("q", F.slice("values", F.col("period") + 1, F.col("n")))
    add = lambda column: F.aggregate(column, F.lit(0.0), lambda s, v: s + v)
    means = sides.withColumn("mp", add("p") / F.col("n")).withColumn("mq", add("q") / F.col("n"))
    centred = means.withColumn("p", F.transform("p", lambda v: v - F.col("mp"))).withColumn("q", F.transform("q", lambda v: v - F.col("mq")))
    dot = lambda a, b: add(F.zip_with(a, b, lambda v, w: v * w))
    sums = centred.select(*keys, "period", dot("p", "q").alias("pq"), dot("p", "p").alias("pp"), dot("q", "q").alias("qq"))
    return sums.select(*keys, "period", F.when((F.col("pp") <= 0) | (F.col("qq") <= 0), 0.0).otherwise(F.col("pq") / F.sqrt(F.nullif(F.col("pp") * F.col("qq"), F.lit(0.0)))).alias("r"))


def best_period(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, base_pitch, clear, score: the period of highest score (the smaller of near ties), or the smallest that divides it
    and scores nearly as much. correlations: keys, period, r (a mean over axes)."""
    listed = correlations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("period", "r"))).alias("all"))

    def keep(state: Column, c: Column) -> Column:
        wins = state["period"].isNull() | (c["r"] > state["r"]) | ((F.abs(c["r"] - state["r"]) < TIE) & (c["period"] < state["period"]))
        return F.struct(F.when(wins, c["period"]).otherwise(state["period"]).alias("period"), F.when(wins, c["r"]).otherwise(state["r"]).alias("r"))

    best = F.aggregate("all", F.struct(F.lit(None).cast("int").alias("period"), F.lit(None).cast("double").alias("r")), keep)
    rows = listed.select(*keys, "all", best.alias("best"))
    ratio = lambda c: F.col("best.period") / c["period"]
    divides = F.filter("all", lambda c: (c["period"] < F.col("best.period")) & (c["r"] >= F.col("best.r") * HARMONIC) & (F.abs(ratio(c) - F.round(ratio(c))) <= 0.1))
    clear = F.col("best.r") >= PROFILE_SCORE
    chosen = F.when(F.size(divides) > 0, F.get(divides, F.lit(0))["period"]).otherwise(F.col("best.period"))
    return rows.select(*keys, F.when(clear, chosen).otherwise(1).cast("int").alias("base_pitch"), clear.alias("clear"), F.col("best.r").alias("score"))


def from_profiles(profiles: DataFrame) -> DataFrame:
    """best_period of frames, from the mean correlation of both axes; profiles: frame, axis, pos, value."""
    series = profiles.groupBy("frame", "axis").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("values"))
    limits = series.groupBy("frame").agg(F.least(F.floor(F.min(F.size("values")) / 2), F.lit(PROFILE_MOST)).alias("limit"))
    both = autocorrelation(series, ["frame", "axis"], PROFILE_MOST).join(limits, "frame").filter("period <= limit")
    return best_period(both.groupBy("frame", "period").agg((F.sum("r") / 2.0).alias("r")), ["frame"])


def combine(by_runs: DataFrame, by_profiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """frame, rule, base_pitch, pitch, clear: which signal is believed; sizes: frame, width, height."""
    p = by_profiles.select("frame", F.col("base_pitch").cast("double").alias("p_base"), F.col("clear").alias("p_clear"), F.col("score").alias("p_score"))
    rows = by_runs.join(p, "frame").join(sizes, "frame")
    divides = lambda unit: (F.pmod("width", F.col(unit)) == 0) & (F.pmod("height", F.col(unit)) == 0)
    ratio = F.col("p_base") / F.col("base_pitch")
    rule = (
        F.when(~F.col("p_clear"), "runs")
        .when(F.col("clear") & divides("base_pitch") & (~divides("p_base") | (F.col("base_pitch") < F.col("p_base"))), "runs divide")
        .when(F.col("clear") & (F.abs(F.col("base_pitch") - F.col("p_base")) <= 1.0), "agree")
        .when(~F.col("clear") & divides("p_base"), "profile divides")
        .when(F.col("clear") & (F.abs(ratio - F.round(ratio)) <= 0.15) & (ratio >= 1.5), "harmonic")
        .otherwise("profile"))
    rows = rows.withColumn("rule", rule).withColumn("fits", divides("p_base"))
    by_rule = lambda runs, divided, agree, other: F.when(F.col("rule").isin("runs", "harmonic"), runs).when(F.col("rule") == "runs divide", divided).when(F.col("rule") == "agree", agree).otherwise(other)
    held = F.least(F.greatest("pitch", F.col("p_base") - REFINE), F.col("p_base") + REFINE)
    return rows.select(
        "frame", "rule", by_rule(F.col("base_pitch"), F.col("base_pitch"), F.col("p_base"), F.col("p_base")).alias("base_pitch"), by_rule(F.col("pitch"), F.col("base_pitch"), held, F.col("p_base")).alias("pitch"),
        F.when(F.col("rule") == "runs", F.col("clear")).when(F.col("rule") == "profile", F.col("fits")).otherwise(True).alias("clear"), F.col("p_clear").alias("profile_clear"), F.col("p_score").alias("profile_score"))


def lower_median(column: str) -> Column:
    """An aggregate: of n values in order, the one in place floor((n + 1) / 2)."""
    values = F.array_sort(F.collect_list(column))
    return F.get(values, F.floor((F.size(values) + 1) / 2).cast("int") - 1)


def common(pitches: DataFrame) -> DataFrame:
    """One row: base_pitch, pitch and status over all frames with a clear pitch.

    The median is found by counting distinct values first, so no list of frames is gathered.
    """
    clear = pitches.filter("clear").filter(f"base_pitch >= {LEAST}")

    def median(column: str) -> DataFrame:
        counts = clear.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
        upto = counts.select("v", F.sum("n").over(Window.orderBy("v")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
        return upto.filter("upto >= (all + 1) div 2").agg(F.min("v").alias(column))

    middle = median("base_pitch").crossJoin(median("pitch"))
    spread = pitches.filter("clear").agg(F.max("pitch").alias("most"), F.min("pitch").alias("least"))
    rows = middle.crossJoin(spread)  # one row each
    apart = (F.col("most") / F.col("pitch") > MOST_RATIO) | (F.col("pitch") / F.col("least") > MOST_RATIO)
    return rows.select("base_pitch", "pitch", F.when(F.col("pitch").isNull(), "no clear pitch").when(apart, "frames disagree").otherwise("ok").alias("status"))
