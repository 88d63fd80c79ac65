"""Connected components of an edge table: forests of blocks of edges, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common

#: Edges that a task turns into a forest at once.
EDGES = 1_000_000


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges stored, and their number and the sum of their hashes."""
    seen = Observation()
    out = common.stored(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    found = seen.get
    return out, (found["n"], found["h"])


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """For every node of some edges the smallest node that they lead to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components: in every block of EDGES, each node and the smallest that the block leads it to."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []

        def flushed() -> pa.RecordBatch:
            links = [(x, y) for x, y in forest(iter(held)).items() if x != y]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["u", "v"])

        for batch in batches:
            held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            if len(held) >= EDGES:
                yield flushed()
        if held:
            yield flushed()

    return edges.mapInArrow(contract, "u long, v long")


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Links each node's neighbours to the smallest of them: the larger neighbours (both=True) or the smaller ones."""
    seen = edges.union(edges.select("v", "u")) if both else edges
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if both:
        out = seen.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = seen.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of an edge (a, b) the smallest node that it reaches.

    Forests of blocks shorten most chains at once. Then only minima are gathered for a node, by map-side aggregation, never
    its neighbours. Each round is written to the shared folder, and the number of rounds is logarithmic in the nodes.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, mark = _kept(_contracted(links))
    while mark[0]:
        edges, now = _kept(_star(_star(edges, True), False))
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v"))).distinct()
