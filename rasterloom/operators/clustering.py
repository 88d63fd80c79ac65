"""k-means of colours, in red-green-blue and by hue. Each runs on a frame's distinct colours in one grouped function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# fixed values
SEED, ROUNDS, MOVED = 42, 15, 0.01
MULTIPLIER, MODULUS = 16807, 2147483647


class Minstd:
    """The multiplicative generator of Park and Miller: the same numbers on every machine."""

    def __init__(self, seed: int = 1):
        state = int(seed) % MODULUS
        self.state = state if state > 0 else state + MODULUS - 1

    def fraction(self) -> float:
        self.state = self.state * MULTIPLIER % MODULUS
        return (self.state - 1) / (MODULUS - 1)

    def below(self, n: int) -> int:
        return int(self.fraction() * n) if n > 0 else 0

    def weighted(self, weights: np.ndarray) -> int:
        """An index with chances in proportion to weights; any index if all are 0."""
        total = float(weights.sum())
        if total <= 0:
            return self.below(len(weights))
        return int(min(np.searchsorted(np.cumsum(weights), self.fraction() * total, side="right"), len(weights) - 1))


def states(seeds: DataFrame, steps: int) -> DataFrame:
    """seed, state: the generator's state after some steps from each seed."""

    def run(frames):
        for pdf in frames:
            out = []
            for seed in pdf["seed"]:
                rng = Minstd(seed)
                for _ in range(steps):
                    rng.fraction()
                out.append(rng.state)
            yield pd.DataFrame({"seed": pdf["seed"], "state": out})

    return seeds.select("seed").mapInPandas(run, "seed long, state long")


def drawn(histogram: DataFrame) -> DataFrame:
    """frame, r, g, b: one colour of each frame, by chances in proportion to counts; the generator starts at the frame's
    number plus one. histogram: frame, r, g, b, n, first_pos."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_pos")
        at = Minstd(int(pdf["frame"].iloc[0]) + 1).weighted(pdf["n"].to_numpy(float))
        return pdf.iloc[[at]][["frame", "r", "g", "b"]]

    return histogram.groupBy("frame").applyInPandas(run, "frame int, r int, g int, b int")


def kmeans(points: np.ndarray, weights: np.ndarray, k: int, seed: int = SEED, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centres, nearest centre of each point): seeds far apart by weight, ties to the first centre."""
    k = min(k, len(points))
    rng = Minstd(seed)
    centres = [points[rng.weighted(weights)]]
    apart = np.full(len(points), np.inf)
    while len(centres) < k:
        apart = np.minimum(apart, ((points - centres[-1]) ** 2).sum(axis=1))
        centres.append(points[rng.weighted(apart * weights)])
    centres = np.array(centres, float)
    for turn in range(rounds):
        near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        before = centres.copy()
        mass = np.bincount(near, weights, k)
        for j in np.flatnonzero(mass):
            centres[j] = (points[near == j] * weights[near == j, None]).sum(axis=0) / mass[j]
        if turn and ((centres - before) ** 2).sum(axis=1).max() < MOVED:
            break
    return centres, ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def quantised(histogram: DataFrame, colours: int) -> DataFrame:
    """frame, key, r, g, b: each opaque colour's replacement. histogram: frame, r, g, b, n, first_pos."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_pos")
        points = pdf[["r", "g", "b"]].to_numpy(float)
        centres, near = kmeans(points, pdf["n"].to_numpy(float), colours)
        new = np.floor(np.clip(centres, 0, 255) + 0.5).astype(int)[near]
        return pd.DataFrame({"frame": pdf["frame"], "key": pdf["r"] * 65536 + pdf["g"] * 256 + pdf["b"], "r": new[:, 0], "g": new[:, 1], "b": new[:, 2]})

    return histogram.groupBy("frame").applyInPandas(run, "frame int, key int, r int, g int, b int")


def hue_distance(a: np.ndarray, b: float) -> np.ndarray:
    d = np.mod(a - b, 360.0)
    return np.minimum(d, 360.0 - d)


def kmeans_hue(hues: np.ndarray, weights: np.ndarray, k: int, rounds: int = 40, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cluster of each hue) on the circle of degrees; entries are taken in the order given, so results repeat."""
    k = min(k, len(hues))
    rng = Minstd(seed)
    centres = [hues[rng.below(len(hues))]]
    while len(centres) < k:
        apart = np.min([hue_distance(hues, c) for c in centres], axis=0)
        centres.append(hues[rng.weighted(apart**2 * weights)])
    centres, near = np.array(centres), None
    for _ in range(rounds):
        now = np.stack([hue_distance(hues, c) for c in centres]).argmin(axis=0)
        if near is not None and (now == near).all():
            break
        near = now
        for j in range(k):
            mine = near == j
            if mine.any():
                x, y = (weights[mine] * np.cos(np.radians(hues[mine]))).sum(), (weights[mine] * np.sin(np.radians(hues[mine]))).sum()
                centres[j] = np.degrees(np.arctan2(y, x)) % 360.0
    return centres, near


def elbow(hues: np.ndarray, weights: np.ndarray, most: int = 8) -> int:
    """The number of clusters where the fall of the spread bends most; the smaller of equals."""
    if len(hues) <= 2:
        return min(len(hues), 1)
    spread = []
    for k in range(1, min(most, len(hues)) + 1):
        centres, near = kmeans_hue(hues, weights, k, 25)
        spread.append(float((hue_distance(hues, 0)[:0].sum()) + sum((hue_distance(hues[near == j], centres[j]) ** 2 * weights[near == j]).sum() for j in range(k))))
    bends = [spread[k - 1] - 2 * spread[k] + spread[k + 1] for k in range(1, len(spread) - 1)]
    if not bends or max(bends) <= -1:
        return 2
    return int(np.argmax(bends)) + 2


def hue_clusters(entries: DataFrame, k: int | None = None, group: str = "sprite", least: int = 1) -> DataFrame:
    """group, key, cluster of the colours (group, key, hue, w) of each group; k: clusters, or found by the elbow, `least` of
    them where there are so many colours."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        hues, weights = pdf["hue"].to_numpy(float), pdf["w"].to_numpy(float)
        _, near = kmeans_hue(hues, weights, k or max(elbow(hues, weights), least))
        return pd.DataFrame({group: pdf[group], "key": pdf["key"], "cluster": near})

    return entries.select(group, "key", "hue", "w").groupBy(group).applyInPandas(run, f"{group} string, key int, cluster int")
