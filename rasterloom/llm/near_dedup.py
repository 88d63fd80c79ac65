"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles gives POSITIONS min-hashes of BITS bits each. Two signatures differ in some number of
positions; that is their distance. The signature is split into chunks of CHUNK positions; by the pigeonhole principle
two signatures at a distance of at most DISTANCE = (ERRORS + 1) * chunks - 1 have a chunk with at most ERRORS (one) differing
positions. All places of that error are enumerated: each chunk gives one key for every position left out, so such a
pair shares a key for certain. A pair with Jaccard similarity 0.8 differs in 24 of 120 positions on average, with a
standard deviation of 4.4; 47 is five of those away. Links are confirmed on the full sets.

Work stays linear in groups of copies. Equal sets are one class, joined through their smallest doc_id. In a bucket (the
classes that share a key) each class is first held against the bucket's smallest only. The components of the confirmed
links then settle most buckets: pairs within one component need no test. In buckets with several components, each class of
a smaller component is held against the whole larger one, block by block. What is left out is connected already, so
no link between components is lost. Hot keys are reduced by map-side minima; the joins on keys are plain equi-joins that
adaptive execution can split.

Defined cases: a document of fewer words than a shingle has one shingle, the whole sequence; without words (or with null
text) it has none and is linked with nothing. Rows that share doc_id are one document. A null doc_id is linked with
nothing and has a null component. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

POSITIONS, CHUNK, ERRORS = 120, 5, 1
DISTANCE = (ERRORS + 1) * (POSITIONS // CHUNK) - 1
#: Shingles and sets in a block of sets, about; classes of a component whose signatures are compared first.
BLOCK, SETS, FEW = 200_000, 2000, 16
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**31, POSITIONS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, POSITIONS, dtype=np.uint32)[:, None]
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """Hashes of words, worked out once each; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, n: int, words: Words) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-word shingles of a text."""
    tokens = (text or "").encode().translate(common.FOLD).split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    m = max(1, len(h) - n + 1)
    out = np.full(m, np.uint64(min(n, len(h))))
    for j in range(min(n, len(h))):
        out = _mix(out * _M1 + h[j : j + m])
    return np.unique(out)


def signature(shingles: np.ndarray) -> bytes:
    low = np.full(POSITIONS, 2**32 - 1, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, (h[at : at + 2048] * _A + _B).min(axis=1))
    return (low & np.uint32(0xFFFF)).astype(">u2").tobytes()


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest and its signature, one row per document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sizes, prints, signs = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), n, words)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "print", "sign"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, n_shingles long, print binary, sign binary")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, node, slot) for every slot: a chunk of the signature and the position left out of it."""

    def enumerate_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                s = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u2").astype(np.uint64).reshape(-1, POSITIONS // CHUNK, CHUNK)
                keys = np.empty((*s.shape[:2], CHUNK), np.uint64)
                for e in range(CHUNK):
                    four = [s[:, :, j] for j in range(CHUNK) if j != e]
                    packed = four[0] << np.uint64(48) | four[1] << np.uint64(32) | four[2] << np.uint64(16) | four[3]
                    keys[:, :, e] = _mix(packed + (np.arange(s.shape[1], dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(e))[None, :] * _M1)
                nodes = np.repeat(part.column(0).to_numpy(), POSITIONS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes), pa.array(np.tile(np.arange(POSITIONS, dtype=np.int8), part.num_rows))], names=["key", "node", "slot"])

    return classes.select("node", "sign").mapInArrow(enumerate_errors, "key long, node long, slot byte")


def _spread(step: int):
    return lambda x: x.bitwiseOR(F.shiftrightunsigned(x, step))


def _chunks(sign: str) -> F.Column:
    """A signature's chunks, each as x (its first four positions in one number) and y (the fifth)."""
    number = lambda at, n: F.conv(F.hex(F.substring(sign, at, n)), 16, -10).cast("long")
    return F.array(*[F.struct(number(10 * i + 1, 8).alias("x"), number(10 * i + 9, 2).alias("y")) for i in range(POSITIONS // CHUNK)])


def _differences(a: F.Column, b: F.Column) -> F.Column:
    """For each chunk of two signatures a bit in every 16 of a number where the first four positions differ, and whether
    the fifth does."""
    pairs = F.zip_with(a, b, lambda p, q: F.struct(p["x"].bitwiseXOR(q["x"]).alias("x"), (p["y"] != q["y"]).cast("int").alias("y")))
    for step in (8, 4, 2, 1):
        spread = _spread(step)
        pairs = F.transform(pairs, lambda p: F.struct(spread(p["x"]).alias("x"), p["y"].alias("y")))
    return F.transform(pairs, lambda p: F.struct(p["x"].bitwiseAND(F.lit(0x0001000100010001)).alias("x"), p["y"].alias("y")))


def _errors(p: F.Column) -> F.Column:
    return F.bit_count(p["x"]) + p["y"]


def _distance(a: F.Column, b: F.Column) -> F.Column:
    return F.aggregate(_differences(a, b), F.lit(0), lambda n, p: n + _errors(p))


def _first_slot(a: F.Column, b: F.Column) -> F.Column:
    """The first slot (chunk and position left out) in which two signatures have the same key."""
    left_out = lambda p: F.when(_errors(p) == 0, 0).when(p["y"] == 1, 4).when(p["x"] == 1 << 48, 0).when(p["x"] == 1 << 32, 1).when(p["x"] == 1 << 16, 2).otherwise(3)
    shared = F.transform(_differences(a, b), lambda p, i: F.when(_errors(p) <= ERRORS, i * CHUNK + left_out(p)))
    return F.array_min(shared)


def _close(similarity: int, n_a: F.Column, s_a: F.Column, n_b: F.Column, s_b: F.Column) -> F.Column:
    """What the sizes and signatures of a pair must meet."""
    return (100 * F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b)) & (_distance(s_a, s_b) <= DISTANCE)


def _confirm(pairs: DataFrame, docs: DataFrame, n: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, right = Words(), object(), np.empty(0, np.uint64)
        for batch in batches:
            a, b, left, other = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            good = []
            for i in range(len(a)):
                if b[i] != last:
                    last, right = b[i], shingle_set(other[i].as_py(), n, words)
                mine = shingle_set(left[i].as_py(), n, words)
                both = len(np.intersect1d(mine, right, assume_unique=True))
                if 100 * both >= similarity * (len(mine) + len(right) - both) and both:
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])

    return joined.mapInArrow(compare, "a long, b long")


def _mixed(members: DataFrame, joined: DataFrame, sides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, groups, rows): each class's component; each component's size and volume; and the members of the buckets
    that several components share, with whether their component is below the bucket's largest."""
    nodes = common.stored(members.select("node").distinct().join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "nodes")
    groups = common.stored(nodes.join(sides, "node").groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("volume")), "groups")
    placed = common.stored(members.select("key", "node", "slot").join(nodes, "node").join(groups.select("component", "size"), "component"), "placed")
    order = F.struct("size", "component")
    several = placed.groupBy("key").agg(F.min(order).alias("least"), F.max(order).alias("top")).filter("least < top").select("key", "top")
    rows = common.stored(placed.join(several, "key").select("key", "node", "slot", "component", "size", (order < F.col("top")).alias("below")), "mixed")
    return nodes, groups, rows


def _across(members: DataFrame, joined: DataFrame, sides: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links (a, b) between the components of the first links: for a class and another component that it shares a bucket
    with, one link if there is any.

    The class of the smaller component is held against all classes of the larger one, in blocks of sets: the sizes of
    all intersections of two blocks are one matrix product, so no pair is ever a row.
    """
    nodes, groups, across = _mixed(members, joined, sides)
    few = nodes.join(groups.filter(F.col("size") <= FEW).select("component"), "component").join(sides, "node").groupBy("component").agg(F.collect_list(F.struct("n", "s")).alias("classes"))
    order = F.struct("size", "component")
    small = across.filter("below").join(sides, "node").select(F.col("key").alias("key_a"), F.col("slot").alias("slot"), F.col("node").alias("a"), F.struct("size", "component").alias("order_a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    large = across.select("key", "component", "size").distinct().join(few, "component", "left").select("key", "component", "classes", order.alias("order_b"))
    # a component of few classes shows by their signatures whether a pair can be close enough, and counts in the first
    # bucket that the pair shares
    close = F.exists("classes", lambda c: _close(similarity, F.col("n_a"), F.col("s_a"), c["n"], c["s"]) & (_first_slot(F.col("s_a"), c["s"]) == F.col("slot")))
    met = small.join(large.hint("merge"), (F.col("key_a") == F.col("key")) & (F.col("order_a") < F.col("order_b")) & (F.col("classes").isNull() | close))
    tests = common.stored(met.select("a", "component").distinct(), "tests")

    wanted = nodes.join(tests.select("component").distinct(), "component", "left_semi")
    needed = wanted.select("node").union(tests.select(F.col("a"))).distinct()
    sets = common.stored(_sets(needed.join(texts.withColumnRenamed("doc_id", "node"), "node").select("node", "text"), words), "sets")

    number = F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / SETS)).cast("int")
    left = tests.select("component", F.col("a").alias("node"))
    n_left = common.stored(left.join(sides, "node").groupBy("component").agg(number.alias("n_left")), "volumes")
    n_right = groups.select("component", F.ceil(F.greatest(F.col("volume") / BLOCK, F.col("size") / SETS)).cast("int").alias("n_right"))
    both = n_left.join(n_right, "component")

    def blocks(rows: DataFrame, name: str, mine: str, other: str) -> DataFrame:
        """The sets of rows in blocks, each as often as the other side has blocks: (component, left, right, sets)."""
        dealt = rows.join(both, "component").withColumn(name, F.pmod(F.xxhash64("node"), F.col(f"n_{name}")).cast("int"))
        made = dealt.join(sets, "node").groupBy("component", name).agg(F.collect_list(F.struct("node", "set")).alias(mine), F.first(f"n_{other}").alias("n"))
        return made.select("component", name, mine, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias(other))

    # a pair of blocks has a key of its own, so a large component is spread over its pairs of blocks
    pairs = blocks(left, "left", "a", "right").join(blocks(wanted, "right", "b", "left").hint("merge"), ["component", "left", "right"]).select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                a, b = block_links(left.as_py(), right.as_py(), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """(node, set): the hashes of the shingles of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), n, words).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "set"])

    return rows.mapInArrow(run, "node long, set binary")


def block_links(left: list[dict], right: list[dict], similarity: int) -> tuple[list[int], list[int]]:
    """For each set of left the first set of right that is similar enough, if any."""
    a, b = ([np.frombuffer(x["set"], np.uint64) for x in side] for side in (left, right))
    n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    shared = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]
        shared += _incidence(a, part) @ _incidence(b, part).T
    good = (100 * shared >= similarity * (n_a[:, None] + n_b[None, :] - shared)) & (shared > 0)
    rows = np.flatnonzero(good.any(axis=1))
    return [left[i]["node"] for i in rows], [right[j]["node"] for j in good[rows].argmax(axis=1)]


def _incidence(sets: list[np.ndarray], universe: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(universe)), np.float32)
    for row, s in zip(out, sets):
        s = s[np.searchsorted(s, universe[0]) : np.searchsorted(s, universe[-1], side="right")]
        at = np.searchsorted(universe, s)
        row[at[universe[at] == s]] = 1
    return out


def near_dedup(docs: DataFrame, words: int = 2, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; similarity in hundredths, 80 or more."""
    common.small_batches(docs.sparkSession)
    signed = common.stored(signatures(docs, words), "signatures")
    least = F.min(F.struct("doc_id", "n_shingles", "sign"))
    classes = common.stored(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("print").agg(least.alias("c")).select("print", F.col("c.doc_id").alias("node"), F.col("c.n_shingles").alias("n"), F.col("c.sign").alias("sign")), "classes")
    # a bucket is a key with two different classes at least; its smallest class leads
    buckets = common.stored(_keys(classes).groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last").select("key", "lead"), "buckets")
    members = common.stored(_keys(classes).join(buckets.hint("merge"), "key"), "members")

    sides = classes.select("node", "n", _chunks("sign").alias("s"))
    side = lambda x: sides.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"))
    wanted = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = common.stored(wanted, "texts")

    stars = members.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    near = stars.join(side("a"), "a").join(side("b"), "b").filter(_close(similarity, *map(F.col, ("n_a", "s_a", "n_b", "s_b")))).select("a", "b")
    links = common.stored(_confirm(common.stored(near, "pairs"), texts, words, similarity), "links")
    joined = common.stored(components(links), "components")
    more = common.stored(_across(members, joined, sides, texts, words, similarity), "links")
    final = common.stored(components(links.union(more)) if more.head(1) else joined, "components")

    named = classes.select("print", "node").join(final, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    named = common.stored(named, "named")
    # documents without words have no class: they pass by the join
    placed = signed.filter("print is not null").join(named, "print", "left").unionByName(signed.filter("print is null").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def survivors(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns."""
    decided = near_dedup(docs, words, similarity)
    key = common.fresh(docs, "kept_id")
    return docs.join(decided.filter("kept").select(F.col("doc_id").alias(key)).distinct(), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def query(spark, sf_dir):
    return near_dedup(common.documents(spark, sf_dir))
