"""Cut lists that depend on their previous cut: snapped, regularised, elastic and anchored to the content.

They take a frame's profiles or transitions (a few hundred numbers) in one grouped function, never its pixels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values
WINDOW_SHARE, WINDOW, STRENGTH, LEAST_CUTS = 0.35, 2.0, 0.5, 4
RADIUS_SHARE, RADIUS, EDGE, WIDTH_COST, TARGET_COST, NARROW, WIDE = 0.7, 2, 1.0, 0.75, 0.25, 0.4, 1.6


def half_up(x: float) -> int:
    return int(math.floor(x + 0.5)) if x >= 0 else -int(math.floor(-x + 0.5))


def uniform(limit: int, cells: int) -> list[int]:
    cells = min(max(cells, 1), max(limit, 1))
    return sorted({limit * i // cells for i in range(cells + 1)}) if limit else [0]


def snapped(profile: np.ndarray, step: float, least_cuts: int = LEAST_CUTS) -> list[int]:
    """Each even cut moved to the strongest place nearby and after the last cut; weak places leave it where it is."""
    limit = len(profile)
    if limit < 2:
        return list(range(limit + 1))
    wanted = half_up(limit / step) if step > 0 and math.isfinite(step) else 0
    cells = min(max(wanted, least_cuts - 1, 1), limit)
    width = limit / cells
    reach = max(width * WINDOW_SHARE, WINDOW)
    mean, cuts = float(profile.mean()), [0]
    for i in range(1, cells):
        after = cuts[-1] + 1
        if after >= limit:
            break
        low, high = max(math.floor(width * i - reach), after), min(math.ceil(width * i + reach), limit - 1)
        if high < low:
            low = high = after
        window = profile[low : high + 1]
        at = low + int(window.argmax())
        if window.max() < mean * STRENGTH:
            at = max(half_up(width * i), after)
            if at >= limit:
                at = max(limit - 1, after)
        cuts.append(at)
    return sorted({min(c, limit) for c in [*cuts, limit]})


def regularised(profile: np.ndarray, cells: int, pitch: float) -> list[int]:
    """The cuts of best total: strength of places less deviations of widths and of places; the smallest earlier place of
    equals. Even cuts where widths can't be kept."""
    limit = len(profile)
    cells = min(max(cells, 1), max(limit, 1))
    if cells <= 1:
        return [0, limit] if limit else [0]
    reach = max(half_up(pitch * RADIUS_SHARE), RADIUS)
    narrow = max(half_up(pitch * NARROW), 1)
    wide = max(half_up(pitch * WIDE), narrow)
    if cells * narrow > limit or cells * wide < limit:
        return uniform(limit, cells)
    mean = max(float(profile.mean()), 0.0001)
    layers: list[dict[int, tuple[float, int]]] = [{0: (0.0, -1)}]
    for i in range(1, cells):
        ideal, left = half_up(pitch * i), cells - i
        layer = {}
        for at in range(max(i * narrow, ideal - reach), min(limit - left * narrow, ideal + reach) + 1):
            if not left * narrow <= limit - at <= left * wide:
                continue
            gain = EDGE * (profile[at] if at < limit else 0.0) / mean - TARGET_COST * abs(at - ideal)
            best = max(((score + gain - WIDTH_COST * abs(at - p - pitch), -p) for p, (score, _) in layers[-1].items() if narrow <= at - p <= wide), default=None)
            if best:
                layer[at] = (best[0], -best[1])
        if not layer:
            return uniform(limit, cells)
        layers.append(layer)
    ends = [(score - WIDTH_COST * abs(limit - at - pitch), -at) for at, (score, _) in layers[-1].items() if narrow <= limit - at <= wide]
    if not ends:
        return uniform(limit, cells)
    cuts, at = [limit], -max(ends)[1]
    for layer in reversed(layers[1:]):
        cuts.append(at)
        at = layer[at][1]
    return [0, *cuts[::-1]]


def elastic(found: list[int], spans: int, size: int, pitch: float) -> list[int]:
    """Found transitions kept at their place in the grid; even steps before the first and after the last."""
    if not found:
        return [half_up(i * size / spans) for i in range(spans + 1)]
    start = int(found[0] // pitch)
    last = min(start + len(found) - 1, spans - 1)
    cuts = [0] * spans + [size]
    for i, c in enumerate(found):
        if 1 <= start + i <= spans - 1:
            cuts[start + i] = c
    for i in range(1, start):
        if i <= spans - 1:
            cuts[i] = half_up(i * found[0] / start)
    rest = spans - last
    base = cuts[last]
    for i in range(1, rest):
        cuts[last + i] = base + half_up(i * (size - base) / rest)
    return cuts


def elastic_fits(rows: list[int], columns: list[int], box: tuple[int, int, int, int], pitch: int, width: int, height: int) -> tuple[list[int], list[int]] | None:
    """(column cuts, row cuts), or nothing where transitions are too many, too few or too uneven. box: x0, x1, y0, y1."""
    x0, x1, y0, y1 = box
    if max(abs(len(rows) - ((y1 - y0 + 1) // pitch - 1)), abs(len(columns) - ((x1 - x0 + 1) // pitch - 1))) > 2:
        return None
    ys, xs = elastic(rows, height // pitch, height, pitch), elastic(columns, width // pitch, width, pitch)
    sizes = np.concatenate([np.diff(ys), np.diff(xs)])
    return (xs, ys) if sizes.min() >= math.floor(pitch * NARROW) and sizes.max() <= math.ceil(pitch * WIDE) else None


def segments(first: int, last: int, cuts: list[int], unit: float) -> list[tuple[int, int]]:
    """Ranges between cuts over first..last; one of more than one and a half units is divided evenly."""
    out, edges = [], [first, *cuts, last + 1]
    for a, b in zip(edges, edges[1:]):
        if b - a > unit * 1.5:
            n = max(1, half_up((b - a) / unit))
            out += [(math.floor(a + k * (b - a) / n), math.floor(a + (k + 1) * (b - a) / n)) for k in range(n)]
        else:
            out.append((a, b))
    return out


def _levelled(parts: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Merges the first smallest range with the next one, or halves the first largest, until there are n."""
    parts = list(parts)
    while len(parts) > n and len(parts) > 1:
        i = min(range(len(parts)), key=lambda k: parts[k][1] - parts[k][0])
        i = min(i, len(parts) - 2)
        parts[i : i + 2] = [(parts[i][0], parts[i + 1][1])]
    while len(parts) < n:
        i = max(range(len(parts)), key=lambda k: (parts[k][1] - parts[k][0], -k))
        a, b = parts[i]
        parts[i : i + 1] = [(a, (a + b) // 2), ((a + b) // 2, b)]
    return parts


def anchored(rows: list[int], columns: list[int], box: tuple[int, int, int, int], width: int, height: int, out_width: int, out_height: int):
    """Row and column ranges of the content with the place of the first in the output, or nothing where it can't fit."""
    x0, x1, y0, y1 = box
    if not rows:
        return None
    row_span, column_span = y1 - y0 + 1, x1 - x0 + 1
    row_parts = segments(y0, y1, rows, row_span / (len(rows) + 1))
    unit = row_span / len(row_parts)
    n = half_up(column_span / unit)
    if len(row_parts) < 2 or n < 2 or len(row_parts) > out_height or n > out_width:
        return None
    pitch = height / out_height
    top = out_height - len(row_parts) if y1 >= height - unit * 1.5 else half_up((y0 + y1) / 2 / pitch - len(row_parts) / 2)
    left = half_up((x0 + x1) / 2 / pitch - (n - 1) / 2)
    inside = [c for c in columns if x0 < c <= x1]
    if len(inside) >= n // 2:
        column_parts = _levelled(segments(x0, x1, inside, unit), n)
    else:
        base, more = divmod(column_span, n)
        edges = np.cumsum([x0, *[base + (i < more) for i in range(n)]])
        column_parts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return row_parts, column_parts, top, left


def frame_cuts(profiles: DataFrame, method: str, pitch: float) -> DataFrame:
    """frame, axis, cuts by `snapped`, `regularised` or `uniform` from profiles (frame, axis, pos, value)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("pos")["value"].to_numpy(float)
        if method == "uniform":
            cuts = uniform(len(p), max(half_up(len(p) / pitch), 1))
        else:
            cuts = snapped(p, pitch) if method == "snapped" else regularised(p, max(int(len(p) // pitch), 1), pitch)
        return pd.DataFrame({"frame": [pdf["frame"].iloc[0]], "axis": [pdf["axis"].iloc[0]], "cuts": [[int(c) for c in cuts]]})

    return profiles.groupBy("frame", "axis").applyInPandas(run, "frame int, axis string, cuts array<int>")


def content_spans(transitions: DataFrame, bounds: DataFrame, sizes: DataFrame, pitch: float, method: str) -> DataFrame:
    """frame, axis, cell, start, end: source ranges of output cells by `anchored` or `elastic`; no rows for a frame where
    that doesn't apply. sizes: frame, width, height."""
    lists = transitions.groupBy("frame").agg(*[F.array_sort(F.collect_list(F.when(F.col("axis") == a, F.col("boundary")))).alias(f"c{a}") for a in "xy"])
    rows = bounds.join(sizes, "frame").join(lists, "frame", "left").select("frame", "width", "height", "x0", "x1", "y0", "y1", *[F.coalesce(f"c{a}", F.array().cast("array<int>")).alias(f"c{a}") for a in "xy"])

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                box, ys, xs = (r.x0, r.x1, r.y0, r.y1), [int(c) for c in r.cy], [int(c) for c in r.cx]
                wide, high = max(half_up(r.width / pitch), 1), max(half_up(r.height / pitch), 1)
                if method == "anchored":
                    if found := anchored(ys, xs, box, r.width, r.height, wide, high):
                        row_parts, column_parts, top, left = found
                        out += [(r.frame, "y", top + i, a, b) for i, (a, b) in enumerate(row_parts) if 0 <= top + i < high]
                        out += [(r.frame, "x", left + i, a, b) for i, (a, b) in enumerate(column_parts) if 0 <= left + i < wide]
                elif fits := elastic_fits(ys, xs, box, int(pitch), r.width, r.height):
                    for axis, cuts in zip("xy", fits):
                        out += [(r.frame, axis, i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pd.DataFrame(out, columns=["frame", "axis", "cell", "start", "end"])

    return rows.mapInPandas(run, "frame int, axis string, cell int, start int, end int")


def in_spans(pixels: DataFrame, spans: DataFrame) -> DataFrame:
    """pixels with ty, tx by spans (frame, axis, cell, start, end): equi-joins on places."""
    places = spans.filter("end > start").select("frame", "axis", "cell", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at"))
    axis = lambda name, cell: places.filter(F.col("axis") == name).select("frame", F.col("at").alias(name), F.col("cell").alias(cell))
    return pixels.join(axis("x", "tx"), ["frame", "x"]).join(axis("y", "ty"), ["frame", "y"])
