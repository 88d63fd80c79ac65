"""Exact dedup through a minimal perfect hash over historical distinct digests.

A history is a table of shards. Each shard holds a minimal perfect hash (hash and displace) over its distinct
digests; slot i holds the full 32-byte digest, the locator (doc_id) of the row that stays and the number of rows.
Where digests can't be placed under one seed (few digests, or two of a bucket with equal residues) the whole shard is hashed
anew under the next; the index keeps the seed.
A lookup computes one slot and compares all 32 bytes there, so a digest that isn't in the history is never taken
for one that is. Members attach to their slot; nonmembers are grouped on their own.

Skew: rows are reduced to distinct digests by map-side aggregation before they are dealt to shards, and digests are
uniform, so shards are even whatever the size of a group of copies. The join that carries the decision back to each
row is a plain equi-join that adaptive execution may split.

Defined cases: null text counts as empty; empty texts are equal to each other; a null doc_id never wins against
another id and stays null where a group has no other; rows that share doc_id and text are one document and share
the decision; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct digests in one shard, on average: about 1 MB of slots.
SHARD_DIGESTS = 20_000
#: Keys for each displacement.
BUCKET = 3

INDEX = "shard int, n int, seed long, displacement binary, digests binary, winner binary, rows binary"
CLASSES = "digest binary, keep_id long, group_size long, member boolean"
#: Displacement steps tried for a bucket before the shard takes another seed.
_STEPS = 256
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(digests: np.ndarray, seed: int) -> list[np.ndarray]:
    """Three numbers of each digest that depend on all its bytes and on the seed."""
    w = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    out = []
    for j in range(1, 4):
        with np.errstate(over="ignore"):
            x = np.full(len(w), np.uint64(4 * seed + j)) * _M1
            for k in range(4):
                x = (x ^ w[:, k]) * _M2
                x ^= x >> np.uint64(29)
        out.append(x)
    return out


def build_mphf(digests: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacements, slot of each digest) for distinct digests, an array of n rows of 32 bytes."""
    if len(np.unique(digests, axis=0)) < len(digests):
        raise ValueError("a perfect hash needs distinct digests")
    seed = 0
    while (placed := _place(digests, seed)) is None:
        seed += 1
    return seed, *placed


def _place(digests: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The displacements and slots under a seed; None if some bucket fits nowhere."""
    n = len(digests)
    buckets = max(1, n // BUCKET)
    w1, w2, w3 = _words(digests, seed)
    bucket = (w1 % np.uint64(buckets)).astype(np.int64)
    a, b = (w2 % np.uint64(n)).astype(np.int64), (w3 % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    size = np.diff(starts)
    free, slots = np.ones(n, bool), np.empty(n, np.int64)
    shift = np.zeros((buckets, 2), np.int64)
    steps = np.arange(64)
    for k in np.argsort(-size, kind="stable"):
        keys = order[starts[k] : starts[k + 1]]
        if len(keys) < 2:
            break
        found = False
        for d0 in range(min(n, _STEPS)):
            at = (a[keys] + d0 * b[keys]) % n
            if len(np.unique(at)) < len(keys):
                continue
            for base in range(0, n, len(steps)):
                ok = free[(at[:, None] + (base + steps)[None, :]) % n].all(axis=0)
                if ok.any():
                    d1 = (base + int(ok.argmax())) % n
                    shift[k], found = (d0, d1), True
                    slots[keys] = (at + d1) % n
                    free[slots[keys]] = False
                    break
            if found:
                break
        if not found:
            return None
    left = np.flatnonzero(free)
    single = np.flatnonzero(size == 1)
    keys = order[starts[single]]
    slots[keys] = left
    shift[single, 1] = (left - a[keys]) % n
    return shift, slots


def mphf_slots(seed: int, shift: np.ndarray, n: int, digests: np.ndarray) -> np.ndarray:
    w1, w2, w3 = _words(digests, seed)
    d = shift[(w1 % np.uint64(len(shift))).astype(np.int64)]
    return ((w2 % np.uint64(n)).astype(np.int64) + d[:, 0] * (w3 % np.uint64(n)).astype(np.int64) + d[:, 1]) % n


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


NONE = np.iinfo(np.int64).min


def _shard_index(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    seed, shift, slots = build_mphf(digests)
    back = np.argsort(slots)
    winner = pdf["keep_id"].to_numpy(np.int64)[back]
    return pd.DataFrame({
        "shard": [int(pdf["shard"].iloc[0])], "n": [len(digests)], "seed": [seed], "displacement": [shift.tobytes()],
        "digests": [digests[back].tobytes()], "winner": [winner.tobytes()], "rows": [pdf["group_size"].to_numpy(np.int64)[back].tobytes()],
    })


def _probe(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The classes of one shard after the new distinct digests have been looked up in its history."""
    if len(index):
        row = index.iloc[0]
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winner, rows = np.frombuffer(row["winner"], np.int64).copy(), np.frombuffer(row["rows"], np.int64).copy()
        shift = np.frombuffer(row["displacement"], np.int64).reshape(-1, 2)
    else:
        held, winner, rows = np.empty((0, 32), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    out = []
    if len(new):
        digests, ids, sizes = _matrix(new["digest"]), new["keep_id"].to_numpy(np.int64), new["group_size"].to_numpy(np.int64)
        if len(held):
            slot = mphf_slots(int(row["seed"]), shift, len(held), digests)
            member = (held[slot] == digests).all(axis=1)
            np.maximum.at(winner, slot[member], ids[member])
            np.add.at(rows, slot[member], sizes[member])
        else:
            member = np.zeros(len(digests), bool)
        out.append(pd.DataFrame({"digest": [x.tobytes() for x in digests[~member]], "keep_id": ids[~member], "group_size": sizes[~member], "member": False}))
    if len(held):
        out.append(pd.DataFrame({"digest": [x.tobytes() for x in held], "keep_id": winner, "group_size": rows, "member": True}))
    return pd.concat(out)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the folded text, one row per document."""
    return docs.select("doc_id", F.unhex(F.sha2(common.folded("text").cast("binary"), 256)).alias("digest"))


def _distinct(keys: DataFrame) -> DataFrame:
    """Distinct digests with their winner and size; only a null doc_id gives NONE."""
    return keys.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NONE)).alias("keep_id"), F.count("*").alias("group_size"))


def _sharded(distinct: DataFrame, shards: int) -> DataFrame:
    number = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    return distinct.withColumn("shard", (number % shards).cast("int"))


def build_history(keys: DataFrame, shards: int) -> DataFrame:
    """The index over the distinct digests of keys (doc_id, digest)."""
    return _sharded(_distinct(keys), shards).repartition(common.tasks(shards), "shard").groupBy("shard").applyInPandas(_shard_index, INDEX)


def probe(keys: DataFrame, history: DataFrame, shards: int) -> DataFrame:
    """The classes of history and keys together: digest, keep_id, group_size, and whether the history had the digest."""
    new = _sharded(_distinct(keys), shards).repartition(common.tasks(shards), "shard")
    history = history.repartition(common.tasks(shards), "shard")
    classes = new.groupBy("shard").cogroup(history.groupBy("shard")).applyInPandas(_probe, CLASSES)
    return classes.withColumn("keep_id", F.nullif(F.col("keep_id"), F.lit(NONE)))


def exact_dedup(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs.

    The table is taken as a history and arrivals: rows whose hashed id is even are indexed as the history, the others
    arrive and are looked up in it. Every row takes part in one of the two roles and gets its decision.
    """
    keys = common.stored(digests(docs), "digests")
    if shards is None:
        shards = max(1, -(-keys.count() // (2 * SHARD_DIGESTS)))
    arrives = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    history = common.stored(build_history(keys.filter(~arrives), shards), "history")
    classes = probe(keys.filter(arrives), history, shards)
    return keys.join(classes, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history")
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    decided = exact_dedup(docs)
    key = common.fresh(docs, "kept_id")
    return docs.join(decided.filter("kept").select(F.col("doc_id").alias(key)).distinct(), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def query(spark, sf_dir):
    return exact_dedup(common.documents(spark, sf_dir)).drop("in_history")


ORACLE_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""
