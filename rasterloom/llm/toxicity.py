"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their beginnings (so compounds share weight), hashed into BUCKETS. The score is
sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) over the terms present: the pair terms let two words weigh more together
than apart. The machine is fitted on about 2 * SAMPLE labelled documents, chosen by hashed id, as many of either label where
there are; rows of a thinned label weigh more in return. Terms are screened first: only those whose frequency
differs between the labels by Z standard errors or more, and by a factor of LIFT, take part (at most TERMS, the most
telling ones), and the terms of pairs that tell more than their terms do: among the PAIRED most varying and telling terms, those
whose covariance and joint frequency differ between the labels by PAIR_Z standard errors, and their joint frequency and odds ratio
by a factor of LIFT (at most ADDED terms, of the most telling pairs). So thousands of neutral words in a long text, or words that
only mark a language, add nothing.

Learning is distributed up to the screen: tasks turn the sampled texts into sets of hashed terms, terms are counted by a
shuffle, and the chosen ones are looked for in the sets again. One task, which gets these bounded rows alone, fits the machine;
the driver sees neither texts nor sets.

The model is bounded by TERMS + ADDED and broadcast. Scoring is one pass over whole texts without a shuffle.

Defined cases: null and empty texts get the score of no terms; null labels and labels of unknown documents aren't learned from;
a document with several labels counts as toxic if one says so; of several texts under one doc_id the smallest is learned from;
without labels of both kinds every score is 0; further columns are ignored, a score of the caller's is replaced; repeated rows are scored each.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 22
#: Z and LIFT: the best of twelve pairs by three-fold cross-validation inside the training rows of sf0.1.
SAMPLE, TERMS, Z, LIFT, RANK = 4000, 4096, 2.5, 1.5, 4
#: Documents that must hold a term before it is looked at.
LEAST = 4
#: Terms among which pairs are looked for, and the standard errors of a pair: chance alone passes one of their 2 million pairs in 250 fits.
PAIRED, PAIR_Z = 2048, 6.0
#: Terms at most that pairs add, the most telling ones.
ADDED = 128
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6, 7)
#: Lower-cases A-Z and blanks every other ASCII character.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(word: bytes) -> list[int]:
    """The hashed terms of a word: itself and its beginnings."""
    parts = [b"=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts]


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_WORDS).split())


class Machine:
    """b, w and v over the screened terms; index gives a term's row."""

    def __init__(self, index: dict[int, int], b: float, w: np.ndarray, v: np.ndarray):
        self.index, self.b, self.w, self.v = index, b, w, v
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.index, self.b, self.w, self.v

    def __setstate__(self, state):
        self.__init__(*state)

    def rows_of(self, text: str | None) -> list[int]:
        if len(self.cache) > 400_000:
            self.cache.clear()
        found: set[int] = set()
        for word in words_of(text):
            rows = self.cache.get(word)
            if rows is None:
                rows = self.cache[word] = tuple(self.index[t] for t in terms_of(word) if t in self.index)
            if rows:
                found.update(rows)
        return sorted(found)

    def score(self, text: str | None) -> float:
        rows = self.rows_of(text)
        y = self.b
        if rows:
            v = self.v[rows]
            y += self.w[rows].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + math.exp(-max(-60.0, min(60.0, y)))))


def term_set(text: str | None) -> np.ndarray:
    return np.unique(np.array([t for word in words_of(text) for t in terms_of(word)], np.int32))


def paired(sets: list[np.ndarray], y: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Those of terms that are in a pair whose joint frequency differs between the labels by more than its terms' own frequencies say."""
    place = np.full(BUCKETS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    n, both, one = [], [], []
    for label in (0, 1):
        chosen = [place[s][place[s] >= 0] for s, own in zip(sets, y) if own == label]
        there = np.zeros((len(chosen), len(terms)), np.float32)
        for i, h in enumerate(chosen):
            there[i, h] = 1
        n.append(len(chosen))
        both.append(there.T @ there)
        one.append(there.sum(axis=0, dtype=np.float64))
    strength = np.zeros(len(terms))
    for at in range(0, len(terms), 256):
        rows = slice(at, at + 256)
        joint, least = sum(b[rows] for b in both), np.minimum(sum(one)[rows, None], sum(one)[None, :])
        cov, var, odds, share = [], 0.0, [], []
        for size, b, o in zip(n, both, one):
            n11 = b[rows].astype(np.float64)
            n10, n01 = o[rows, None] - n11, o[None, :] - n11
            n00 = size - n11 - n10 - n01
            p, q = (o[rows, None] + 0.5) / (size + 1), (o[None, :] + 0.5) / (size + 1)
            # of (a - p) (b - q) over the documents of a label: mean and variance
            mean = (n11 * (1 - p) * (1 - q) - n10 * (1 - p) * q - n01 * p * (1 - q) + n00 * p * q) / size
            square = (n11 * ((1 - p) * (1 - q)) ** 2 + n10 * ((1 - p) * q) ** 2 + n01 * (p * (1 - q)) ** 2 + n00 * (p * q) ** 2) / size
            cov.append(mean)
            var = var + np.maximum(square - mean**2, 0) / size + 1e-9
            share.append((n11 + 0.5) / (size + 1))
            odds.append(np.log((n11 + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5))))
        z = np.abs(cov[1] - cov[0]) / np.sqrt(var)
        joint_z = np.abs(share[1] - share[0]) / np.sqrt(sum(x * (1 - x) / size for x, size in zip(share, n)))
        # a word and its beginning, or words never apart, are no pair
        telling = (np.maximum(*share) >= LIFT * np.minimum(*share)) & (np.abs(odds[1] - odds[0]) >= math.log(LIFT)) & (joint >= 4) & (joint < 0.95 * least)
        strength[rows] = np.where(telling, np.minimum(z, joint_z), 0).max(axis=1)
    order = np.lexsort((terms, -strength))
    return terms[order[: np.count_nonzero(strength >= PAIR_Z)]]


def screened(terms: np.ndarray, counts: np.ndarray, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(the terms that tell, most telling first; those among which pairs are looked for) of terms with their documents of
    either label (two rows). sizes: documents of either label."""
    order = np.argsort(terms, kind="stable")
    terms, counts = terms[order], counts[:, order]
    p = (counts + 0.5) / np.array([[sizes[0] + 1], [sizes[1] + 1]])
    z = np.abs(p[1] - p[0]) / np.sqrt(p[0] * (1 - p[0]) / sizes[0] + p[1] * (1 - p[1]) / sizes[1])
    z[p.max(axis=0) < LIFT * p.min(axis=0)] = 0
    best = terms[np.lexsort((terms, -z))[:TERMS][: np.count_nonzero(z >= Z)]]
    mean = p.mean(axis=0)
    varying = terms[np.lexsort((terms, -mean * (1 - mean)))[:PAIRED]]
    pool = np.concatenate([best[: PAIRED // 2], varying])
    return best, pool[np.sort(np.unique(pool, return_index=True)[1])][:PAIRED]


def counted(sets: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of LEAST sets or more, and how many sets of either label hold each."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for s, label in zip(sets, y):
        counts[label, s] += 1
    seen = np.flatnonzero(counts.sum(axis=0) >= LEAST)
    return seen, counts[:, seen]


def fit(texts: list[str | None], labels: list[int], weights: dict[int, float], steps: int = 300) -> Machine:
    """The machine of labelled texts; weights: of a row with each label."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return blank()
    sets = [term_set(t) for t in texts]
    return machine(sets, y, *screened(*counted(sets, y), (int((y == 0).sum()), int(y.sum()))), weights, steps)


def blank() -> Machine:
    """The machine that scores 0."""
    return Machine({}, -60.0, np.zeros(0), np.zeros((0, RANK)))


def machine(sets: list[np.ndarray], y: np.ndarray, best: np.ndarray, pool: np.ndarray, weights: dict[int, float], steps: int = 300) -> Machine:
    """The machine over the terms `best` and those of telling pairs in `pool`; sets may leave out all other terms."""
    more = paired(sets, y, pool)
    best = np.concatenate([best, more[~np.isin(more, best)][:ADDED]])
    place = np.full(BUCKETS, -1, np.int32)
    place[best] = np.arange(len(best))
    index = {int(t): i for i, t in enumerate(best)}
    n, m = len(sets), len(index)
    held = [place[s][place[s] >= 0] for s in sets]
    row = np.repeat(np.arange(n), [len(h) for h in held])
    col = np.concatenate(held).astype(np.int64)
    weight = np.where(y == 1, weights[1], weights[0])
    weight /= weight.sum()
    rng = np.random.default_rng(11)
    params = [np.array([math.log((weight @ y) / (1 - weight @ y))]), np.zeros(m), rng.normal(0, 0.05, (m, RANK))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]

    def by_row(x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(row, x[:, f], n) for f in range(x.shape[1])], axis=1)

    for step in range(1, steps + 1):
        b, w, v = params
        vs = by_row(v[col])
        z = b[0] + np.bincount(row, w[col], n) + 0.5 * (vs**2 - by_row(v[col] ** 2)).sum(axis=1)
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight
        gw = np.bincount(col, g[row], m)
        gv = np.stack([np.bincount(col, g[row] * (vs[row, f] - v[col, f]), m) for f in range(RANK)], axis=1)
        grads = [np.array([g.sum()]), gw + 1e-6 * w, gv + 1e-5 * v]
        for p, d, (m1, m2) in zip(params, grads, moments):
            m1 += 0.1 * (d - m1)
            m2 += 0.001 * (d * d - m2)
            p -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    b, w, v = params
    return Machine(index, float(b[0]), w, v)


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine of labels (doc_id, toxic) over docs (doc_id, text), from a bounded sample."""
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return blank()
    size = F.when(F.col("y") == 1, F.lit(int(sizes[1]))).otherwise(F.lit(int(sizes[0])))
    # about SAMPLE ids of either label, whatever the size of the tables
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), size) < SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([term_set(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())], names=["doc_id", "y", "terms"])

    sets = common.stored(rows.mapInArrow(as_sets, "doc_id long, y int, terms binary"), "terms")
    got = {r["y"]: r["n"] for r in sets.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(got) < 2:
        return blank()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for y, terms in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[y, np.frombuffer(terms.as_py(), np.int32)] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(seen), 1 << 16):
            part = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(c[part].astype(np.int64)) for c in counts]], names=["term", "c0", "c1"])

    counts = sets.select("y", "terms").mapInArrow(count, "term int, c0 long, c1 long").groupBy("term").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    counts = common.stored(counts.filter(F.col("c0") + F.col("c1") >= LEAST), "counts")
    # the same sizes as in `screened`, by which the driver need only see the terms that may pass
    p0, p1 = ((F.col(f"c{y}") + 0.5) / (got[y] + 1) for y in (0, 1))
    z = F.abs(p1 - p0) / F.sqrt(p0 * (1 - p0) / got[0] + p1 * (1 - p1) / got[1])
    telling = counts.filter(F.greatest(p0, p1) >= LIFT * F.least(p0, p1) * 0.999999).orderBy(F.desc(z), "term").limit(TERMS)
    varying = counts.orderBy(F.desc((p0 + p1) * (2 - p0 - p1)), "term").limit(PAIRED)
    found = telling.union(varying).distinct().collect()  # at most TERMS + PAIRED rows
    best, pool = screened(np.array([r["term"] for r in found], np.int64), np.array([[r["c0"] for r in found], [r["c1"] for r in found]], np.int64).reshape(2, -1), (got[0], got[1]))
    wanted = np.unique(np.concatenate([best, pool])).astype(np.int32)
    weights = {y: sizes[y] / got[y] for y in (0, 1)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.intersect1d(np.frombuffer(t.as_py(), np.int32), wanted, assume_unique=True).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array([0] * batch.num_rows, pa.int32()), batch.column(0), batch.column(1), pa.array(kept, pa.binary())], names=["all", "doc_id", "y", "terms"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        fitted = machine([np.frombuffer(t, np.int32) for t in pdf["terms"]], pdf["y"].to_numpy(np.int64), best, pool, weights)
        return pd.DataFrame({"machine": [pickle.dumps(fitted)]})

    # about 2 * SAMPLE rows of at most TERMS + PAIRED terms
    fitted = sets.mapInArrow(held, "all int, doc_id long, y int, terms binary").groupBy("all").applyInPandas(run, "machine binary")
    return pickle.loads(bytes(fitted.first()["machine"]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score in place of text; other columns are carried through."""
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            others = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[c for _, c in others], pa.array(scores, pa.float64())], names=[*[n for n, _ in others], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{schema}, score double")


def query(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    held_out = common.doc_remainder("doc_id", 4) == 2
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), machine).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
