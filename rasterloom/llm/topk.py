"""Exact top-k inner-product search by distributed histogram selection.

All pairs of a query block and a data block are scored. For every query an interval of score values is kept that holds
its kth highest score; each pass counts the scores in equal bins of the interval over all blocks and narrows the
interval to the bin with the kth, until it is one value wide. A last pass emits the scores above that value and the
smallest ids at it, and ranks them.

Counts stay small: a block reports the bins of its own best k scores in the interval only, since the kth score of all
blocks lies no lower than the kth of one. Data and query blocks have a fixed number of rows; the grid of block pairs and
the intervals are dealt by both block numbers, so no task gathers more than its pairs. Rows equal in id and vector are held once,
with their number; at most k rows at the kth value leave a block.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id; rows
that share a vec_id are each a candidate, and each a query of their own with k ranks, and a row never finds itself; shorter vectors are filled up
with zeros; products are exact whatever the components, and a score beyond MOST either way is given as MOST; with fewer than k
candidates all are returned; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

K = 20
SCALE = 64
#: Scores are held to -MOST..MOST, so that differences of two fit in 64 bits.
MOST = (1 << 62) - 1
BINS = 1 << 20
DATA_BLOCK, QUERY_BLOCK = 4096, 2048
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of whole doubles), n (rows equal in both) and a hash that tells vectors of one id apart."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    # beyond 2^53 a double is whole already, and scaling by a power of two keeps it so
    scaled = F.transform(x, lambda c: F.when(F.abs(c) < float(2**52 // scale), F.floor(c * scale).cast("double")).otherwise(F.greatest(F.least(c * scale, F.lit(1.7e308)), F.lit(-1.7e308))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole).select("vec_id", scaled.alias("v"))
    return rows.groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("v"))


def _blocks(rows: DataFrame, name: str, size: int, dim: int, kind: np.dtype) -> tuple[DataFrame, int]:
    """One row for each block: its number, the ids, hashes and numbers of its rows, and the matrix."""
    n = max(1, -(-rows.count() // size))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "h"])
        m = np.zeros((len(pdf), dim), kind)
        for i, v in enumerate(pdf["v"]):
            m[i, : len(v)] = v
        row = {c: [pdf[c].to_numpy(np.int64).tobytes()] for c in ("vec_id", "h", "n")}
        return pd.DataFrame({name: [int(pdf["b"].iloc[0])], f"{name}_ids": row["vec_id"], f"{name}_h": row["h"], f"{name}_n": row["n"], f"{name}_m": [m.tobytes()]})

    numbered = rows.withColumn("b", _block(n))
    schema = f"{name} int, {name}_ids binary, {name}_h binary, {name}_n binary, {name}_m binary"
    return common.stored(numbered.repartition(common.tasks(n), "b").groupBy("b").applyInPandas(block, schema), f"blocks-{name}"), n


def _block(n: int):
    return F.pmod(F.xxhash64("vec_id", "h"), F.lit(n)).cast("int")


class _Pair:
    """A pair of blocks: ids, hashes and numbers of both, and the scores; a query's own row counts once less."""

    def __init__(self, row, dim: int, kind: np.dtype):
        self.q, self.q_h = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_h, np.int64)
        self.d, self.n = np.frombuffer(row.d_ids, np.int64), np.frombuffer(row.d_n, np.int64)
        d_h = np.frombuffer(row.d_h, np.int64)
        self.s = products(np.frombuffer(row.q_m, kind).reshape(-1, dim), np.frombuffer(row.d_m, kind).reshape(-1, dim))
        place = {key: j for j, key in enumerate(zip(self.d.tolist(), d_h.tolist()))}
        self.own = [(i, place[key]) for i, key in enumerate(zip(self.q.tolist(), self.q_h.tolist())) if key in place]
        for i, j in self.own:
            if self.n[j] == 1:
                self.s[i, j] = _NONE

    def times(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many candidates stand behind each place of the score matrix."""
        out = self.n[j].copy()
        if len(self.own):
            own = dict(self.own)
            out -= np.fromiter((own.get(a) == b for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers, exact, held to -MOST..MOST."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    with np.errstate(over="ignore"):
        bound = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(a.shape[1], 1)
    if bound < 2**53:
        return (x @ y.T).astype(np.int64)
    if bound < 2**62 and max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < 2**62:
        return x.astype(np.int64) @ y.astype(np.int64).T
    left, right = ([list(map(int, row)) for row in m] for m in (x, y))
    return np.array([[max(-MOST, min(MOST, sum(map(int.__mul__, r, c)))) for c in right] for r in left], np.int64).reshape(len(left), len(right))


def _state(row) -> tuple[np.ndarray, ...]:
    rows = sorted((x["query_id"], x["h"], x["lo"], x["top"], x["width"], x["need"]) for x in row.state)
    return tuple(np.array(c, np.int64) for c in zip(*rows))[2:]


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores of each row."""
    return np.argpartition(s, s.shape[1] - k, axis=1)[:, -k:] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """The k highest inner products of each query row (is_query, a condition on vec_id) with all other rows."""
    rows = common.stored(quantised(vectors), "quantised")
    shape = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    dim, most = max(shape["dim"] or 0, 1), shape["most"] or 0.0
    kind = np.dtype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)
    data, n_data = _blocks(rows, "d", DATA_BLOCK, dim, kind)
    asked, n_asked = _blocks(rows.filter(is_query), "q", QUERY_BLOCK, dim, kind)
    # no score lies beyond the sum of the components by the largest one
    reach = F.least(F.aggregate(F.transform("v", F.abs), F.lit(0.0), lambda x, y: x + y) * F.lit(most) * 1.001 + 1, F.lit(float(1 << 61))) if dim * float(most) * float(most) < 2**60 else F.lit(float(1 << 62))
    lo, top = F.greatest(-reach.cast("long"), F.lit(-MOST)), F.least(reach.cast("long"), F.lit(MOST)) + 1
    width = F.ceil((top / 2.0 - lo / 2.0) * 2.0 / BINS + 1).cast("long")
    state = rows.filter(is_query).select(
        _block(n_asked).alias("q"), F.col("vec_id").alias("query_id"), "h", F.col("n").alias("copies"), lo.alias("lo"), top.alias("top"), width.alias("width"), F.lit(k).cast("long").alias("need"))
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    grid = asked.select("*", every("d", n_data)).join(data.select("*", every("q", n_asked)).hint("merge"), ["q", "d"])

    def with_state(state: DataFrame) -> DataFrame:
        packed = state.groupBy("q").agg(F.collect_list(F.struct("query_id", "h", "lo", "top", "width", "need")).alias("state"))
        return grid.join(packed.select("*", every("d", n_data)).hint("merge"), ["q", "d"])

    def count(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                lo, top, width, need = _state(row)
                pair = _Pair(row, dim, kind)
                s = pair.s
                s[s >= top[:, None]] = _NONE
                j = _best(s, int(need.max()))
                i = np.broadcast_to(np.arange(len(s))[:, None], j.shape)
                at = s[i, j] >= lo[:, None]
                i, j = i[at], j[at]
                bins = (s[i, j] - lo[i]) // width[i]
                found = pd.DataFrame({"query_id": pair.q[i], "h": pair.q_h[i], "bin": bins, "n": pair.times(i, j)})
                yield found.groupby(["query_id", "h", "bin"])["n"].sum().reset_index()

    down = Window.partitionBy("query_id", "h").orderBy(F.desc("bin"))
    state, widest = common.stored(state, "state"), 2
    while widest > 1:  # until all intervals are one value wide
        counted = with_state(state).mapInPandas(count, "query_id long, h long, bin long, n long").groupBy("query_id", "h", "bin").agg(F.sum("n").alias("n"))
        found = (
            counted.withColumn("upto", F.sum("n").over(down)).join(state, ["query_id", "h"]).filter("upto >= need")
            .groupBy("query_id", "h").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("f"))
        )
        # a query with too few candidates gets an interval that lets everything through, one value wide
        low = F.when(F.col("f").isNull(), F.lit(-MOST - 1)).otherwise(F.col("lo") + F.col("f.bin") * F.col("width"))
        narrow = F.when(F.col("f").isNull(), F.lit(1)).otherwise(F.ceil(F.col("width") / F.lit(float(BINS)))).cast("long")
        state = state.join(found, ["query_id", "h"], "left").select(
            "q", "query_id", "h", "copies", low.alias("lo"), F.when(F.col("f").isNull(), low + 1).otherwise(F.least(low + F.col("width"), F.col("top"))).alias("top"),
            narrow.alias("next"), F.col("width").alias("last"), F.when(F.col("f").isNull(), F.col("need")).otherwise(F.col("need") - F.col("f.above")).alias("need"), F.col("f").isNull().alias("few"))
        state = common.stored(state.withColumn("width", F.col("next")), "state")
        widest = state.filter("not few").agg(F.max("last")).first()[0] or 1

    def select(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                lo, *_ = _state(row)
                pair = _Pair(row, dim, kind)
                s = pair.s
                i, j = np.nonzero((s > lo[:, None]) & (s != _NONE))
                ti, tj = np.nonzero((s == lo[:, None]) & (s != _NONE))  # by query, then by id: d is sorted
                nth = np.arange(len(ti)) - np.searchsorted(ti, ti)
                ti, tj = ti[nth < k], tj[nth < k]
                i, j = np.concatenate([i, ti]), np.concatenate([j, tj])
                yield pd.DataFrame({"query_id": pair.q[i], "h": pair.q_h[i], "vec_id": pair.d[j], "score": s[i, j], "n": np.minimum(pair.times(i, j), k)})

    ranked = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    hits = with_state(state).mapInPandas(select, "query_id long, h long, vec_id long, score long, n long")
    hits = hits.select("query_id", "h", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    best = hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    again = state.filter("copies > 1").select("query_id", "h", F.explode(F.sequence(F.lit(2).cast("long"), F.col("copies")))).drop("col")
    # rows that are queries more than once have their ranks as often
    more = best.join(again, ["query_id", "h"])
    return best.unionByName(more).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2]))::bigint as score
  from e q join e on e.vec_id <> q.vec_id where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""
