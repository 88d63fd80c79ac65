"""Language-model scoring over a sharded Elias-Fano n-gram trie of order three.

Model: tokens are words of the folded text, then one end; two start marks come before. A token w after u and v has probability
(c(u,v,w) + MU3 * p(w|v)) / (c(u,v) + MU3), with p(w|v) = (c(v,w) + MU2 * p(w)) / (c(v) + MU2) and p(w) = (c(w) + 1) / (N + V + 1).
The log splits into a numerator of (u,v,w) and a denominator of (u,v); the latter is settled where (u,v) itself is the last
pair of a trigram. So all that concerns a pair can be worked out in the shard of that pair, and a text's score is the sum of
its shards' parts.

Trie: level 1 holds a shard's words (their numbers, sorted). For each word, pointers lead to its successors (level 2) and to
its predecessors; for each pair (v,w), pointers lead to the words seen before it (level 3), each written by its number
among the predecessors of v, its context. Numbers of siblings grow, and each list goes on from where the last one ended, so levels and
pointers are monotone and stored as Elias-Fano sequences, in a file that is mapped into memory; each node has 16-bit codes of its
smoothed log values. A lookup walks down: pointers give a node's range, and a successor search finds the number in it.
The trie holds what training texts say; the n-grams of all texts are then looked up in it.

Distribution: a task turns about CHUNK bytes of documents into a row of token numbers and the words behind them. The counts of
words over all chunks, and a number for each word (the place where it stands first), come back to each chunk (one shuffle of a
chunk's distinct words, one back). Then a chunk gives one block of trigrams, with the documents they occur in, to each shard. Shards follow the corpus (SHARD_TOKENS each), so a shard's memory
doesn't grow; where there are more than common.FAN of them, blocks pass through groups of shards and are put together there, so the
number of blocks follows the input. A trigram is dealt by v; by v and w where v is frequent (more than 1/HOT of all tokens, so
fewer than HOT words), and by all three where the pair is (counted beforehand, fewer than HOT pairs). All counts cover all training
documents; words are told apart by 64-bit hashes, and by their numbers from then on.

Defined cases: null text counts as empty, one end; a null doc_id counts as the empty text in crc32; rows that share
doc_id are scored each; without training documents no token is known; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Chosen by texts held out of the training rows of sf0.01.
MU2, MU3 = 200.0, 2.0
#: Bytes and documents of a chunk, tokens of a shard, bytes of blocks put together on the way.
CHUNK, CHUNK_DOCS, SHARD_TOKENS, MERGED = 12_000_000, 60_000, 1_500_000, 8_000_000
HOT = 1000
#: The hash of the end among words; the numbers of the end and of the start, above those of all words.
END_HASH = 0x6C62272E07BB0142
END, START = (1 << 62) + 1, (1 << 62) + 2
#: Bits of a chunk's serial in its task, and of a word's place in its chunk.
_SERIAL, _PLACE = 12, 30
#: Codes are steps of STEP above LEAST.
LEAST, STEP = -24.0, 1 / 2048
BLOCK = 1 << 13
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class EliasFano:
    """A sorted array of 64-bit numbers: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        places = np.arange(self.low_bits, dtype=np.uint64)
        packed = [np.empty(0, np.uint8)]
        for at in range(0, self.n, BLOCK):  # a block's low bits fill whole bytes
            packed.append(np.packbits((values[at : at + BLOCK, None] >> places).astype(np.uint8) & np.uint8(1)))
        self.low = np.concatenate(packed)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        unary = np.zeros(int(high[-1]) + 1 if self.n else 0, np.uint8)
        unary[high] = 1
        self.high = np.packbits(unary)
        self.first = values[::BLOCK].copy()  # skip pointers: the first value of each block
        self.at = high[::BLOCK].copy()

    def block(self, b: int) -> np.ndarray:
        start, end = b * BLOCK, min(self.n, (b + 1) * BLOCK)
        k = end - start
        begin = int(self.at[b])
        stop = int(self.at[b + 1]) if b + 1 < len(self.at) else len(self.high) * 8
        unary = np.unpackbits(np.asarray(self.high[begin // 8 : stop // 8 + 1]))[begin % 8 :]
        high = (np.flatnonzero(unary)[:k] + begin - np.arange(start, end)).astype(np.uint64)
        if not self.low_bits:
            return high
        bit0 = start * self.low_bits
        packed = np.unpackbits(np.asarray(self.low[bit0 // 8 : (end * self.low_bits + 7) // 8]))[bit0 % 8 :][: k * self.low_bits]
        low = packed.reshape(k, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return high << np.uint64(self.low_bits) | low

    def values(self, places: np.ndarray) -> np.ndarray:
        """The values at some places, which rise."""
        out = np.zeros(len(places), np.uint64)
        of = places // BLOCK
        first = _edges(of)
        for lo, hi in zip(first, np.append(first[1:], len(places))):
            b = int(of[lo])
            out[lo:hi] = self.block(b)[places[lo:hi] - b * BLOCK]
        return out

    def successors(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted numbers: the place of the first value not below each (n if none), and whether it is equal."""
        place, equal = np.full(len(wanted), self.n), np.zeros(len(wanted), bool)
        of = np.maximum(np.searchsorted(self.first, wanted, side="right") - 1, 0)
        edges = np.searchsorted(of, np.arange(len(self.first) + 1))
        for b in range(len(self.first)):
            lo, hi = edges[b], edges[b + 1]
            if lo < hi:
                values = self.block(b)
                at = np.searchsorted(values, wanted[lo:hi])
                place[lo:hi] = at + b * BLOCK
                equal[lo:hi] = values[np.minimum(at, len(values) - 1)] == wanted[lo:hi]
        return place, equal


def coded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((x - LEAST) / STEP), 0, 65535).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return LEAST + codes.astype(np.float64) * STEP


class Lists:
    """The numbers under each node of a level, rising within a node: pointers, and one rising sequence of all."""

    def __init__(self, begin: np.ndarray, numbers: np.ndarray):
        """begin: for each node its first place, and the end; numbers: from 0, rising inside each node's range."""
        last = np.flatnonzero(np.diff(begin))  # nodes with numbers
        steps = np.zeros(len(numbers) + 1, np.uint64)
        steps[begin[last + 1]] = numbers[begin[last + 1] - 1].astype(np.uint64) + np.uint64(1)
        self.pointers = EliasFano(begin.astype(np.uint64))
        self.numbers = EliasFano(numbers.astype(np.uint64) + np.uint64(1) + np.cumsum(steps)[:-1])

    def find(self, nodes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The place of each number under its node, -1 where it isn't; rows sorted by node and number."""
        out = np.full(len(nodes), -1, np.int64)
        if not len(nodes) or not self.numbers.n:
            return out
        first = _edges(nodes)
        distinct, back = nodes[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(nodes))))
        lo, hi = self.pointers.values(distinct).astype(np.int64), self.pointers.values(distinct + 1).astype(np.int64)
        before = np.where(lo > 0, self.numbers.values(np.maximum(lo - 1, 0)), np.uint64(0))
        end = np.where(hi > 0, self.numbers.values(np.maximum(hi - 1, 0)), np.uint64(0))
        rows = np.flatnonzero((hi > lo)[back])
        of = back[rows]
        # beyond a node's last number the search stops just there, so what is asked for rises over all nodes
        goal = np.minimum(before[of] + wanted[rows].astype(np.uint64) + np.uint64(1), end[of] + np.uint64(1))
        place, equal = self.numbers.successors(goal)
        good = equal & (place < hi[of])
        out[rows[good]] = place[good]
        return out

    def parts(self) -> list[EliasFano]:
        return [self.pointers, self.numbers]


def _sorted(x: np.ndarray) -> np.ndarray:
    """The distinct values, rising."""
    x = np.sort(x)
    return x[_edges(x)]


def _order(v: np.ndarray, w: np.ndarray, u: np.ndarray, n: int) -> np.ndarray:
    """The order of rows by (v, w, u), numbers below n; equal rows stay in their order."""
    bits = max(1, int(n).bit_length())
    if 3 * bits > 64:
        return np.lexsort((u, w, v))
    key = (v.astype(np.uint64) << np.uint64(2 * bits)) | (w.astype(np.uint64) << np.uint64(bits)) | u.astype(np.uint64)
    return np.argsort(key, kind="stable")


def _begins(parents: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(parents, np.arange(n + 1))


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


class Trie:
    """Three levels and their codes; the large arrays are mapped from a file that goes with the object."""

    def __init__(self, words: np.ndarray, p: np.ndarray, contexts: np.ndarray, v: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray, pairs: dict[tuple[int, int], int]):
        """words: rising numbers with their probability p and their count as a context. v, w, u: ranks of words, sorted, and the
        trigrams' counts c. pairs: counts of the pairs of ranks that are spread over several shards."""
        n = len(words)
        rows = v.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)
        spread = np.array([a << 32 | b for a, b in pairs], np.uint64)
        both = _sorted(np.concatenate([rows[_edges(rows)], spread]))  # a pair that is spread may have no training trigram here
        v2, w2 = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        pair = np.searchsorted(both, rows)
        c2 = np.bincount(pair, c, len(both)).astype(np.int64)
        c2[np.searchsorted(both, spread)] = list(pairs.values())
        q2 = np.log10((c2 + MU2 * p[w2]) / (contexts[v2] + MU2))
        own = _sorted(v.astype(np.uint64) << np.uint64(32) | u.astype(np.uint64))
        v_of = (own >> np.uint64(32)).astype(np.int64)
        begin = _begins(v_of, n)
        number = np.searchsorted(own, v.astype(np.uint64) << np.uint64(32) | u.astype(np.uint64)) - begin[v]
        self.words = EliasFano(words)
        self.successors = Lists(_begins(v2, n), w2)
        self.predecessors = Lists(begin, (own & np.uint64(0xFFFFFFFF)).astype(np.int64))
        self.trigrams = Lists(np.append(np.searchsorted(rows, both), len(v)), number)
        codes = [np.log10(p), np.log10(MU2 / (contexts + MU2)), q2, -np.log10(c2 + MU3), np.log10(c + MU3 * 10 ** q2[pair])]
        sequences = [self.words, *(e for x in (self.successors, self.predecessors, self.trigrams) for e in x.parts())]
        arrays = [a for e in sequences for a in (e.low, e.high)] + [coded(x) for x in codes]
        handle, path = tempfile.mkstemp(suffix=".trie")
        with os.fdopen(handle, "wb") as f:
            for a in arrays:
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
            f.write(b"\0" * 8)
        mapped = np.memmap(path, np.uint8, "r")
        os.unlink(path)  # the mapping stays until it is dropped
        at, out = 0, []
        for a in arrays:
            out.append(mapped[at : at + a.nbytes].view(a.dtype))
            at += a.nbytes + -a.nbytes % 8
        for e in sequences:
            e.low, e.high = out.pop(0), out.pop(0)
        self.p, self.back, self.q2, self.d2, self.q3 = out

    def rank(self, words: np.ndarray) -> np.ndarray:
        """The ranks of rising numbers, -1 for words that aren't there."""
        place, seen = self.words.successors(words)
        return np.where(seen, place, -1)

    def score(self, v: np.ndarray, w: np.ndarray, u: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
        """For trigrams of ranks, sorted by (v, w, u): the log numerator, and minus the log denominator of (v, w) as the next
        token's context. unknown: log10 probability of a word that isn't known."""
        numerator = np.where(w >= 0, decoded(self.p[np.maximum(w, 0)]) if len(self.p) else 0.0, unknown)
        numerator += np.where(v >= 0, decoded(self.back[np.maximum(v, 0)]) if len(self.back) else 0.0, 0.0) + np.log10(MU3)
        denominator = np.full(len(v), -np.log10(MU3))
        rows = np.flatnonzero((v >= 0) & (w >= 0))
        first = _edges(v[rows], w[rows])
        pair = self.successors.find(v[rows[first]], w[rows[first]])[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))]
        rows, pair = rows[pair >= 0], pair[pair >= 0]
        numerator[rows] = decoded(self.q2[pair]) + np.log10(MU3)
        denominator[rows] = decoded(self.d2[pair])
        known = u[rows] >= 0
        rows, pair = rows[known], pair[known]
        key = v[rows].astype(np.uint64) << np.uint64(32) | u[rows].astype(np.uint64)
        own = _sorted(key)
        back = np.searchsorted(own, key)
        node = (own >> np.uint64(32)).astype(np.int64)
        number = self.predecessors.find(node, (own & np.uint64(0xFFFFFFFF)).astype(np.int64))
        start = self.predecessors.pointers.values(node).astype(np.int64)
        number = np.where(number >= 0, number - start, -1)[back]
        rows, pair, number = rows[number >= 0], pair[number >= 0], number[number >= 0]
        place = self.trigrams.find(pair, number)
        numerator[rows[place >= 0]] = decoded(self.q3[place[place >= 0]])
        return numerator, denominator


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(common.FOLD).split()


_CHUNKS = "chunk long, ids binary, train binary, sizes binary, tokens binary, words array<long>, c array<long>, n long, learnt long"


def chunks(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, train) in rows: ids, training flags, numbers of tokens, token numbers, and for each number (the
    more frequent the smaller, then the end) the word's hash and its count in the chunk's training documents."""
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("train", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("words", pa.list_(pa.int64())), ("c", pa.list_(pa.int64())), ("n", pa.int64()), ("learnt", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        numbers: dict[bytes, int] = {}
        ids, train, rows, size = [], [], [], 0

        def flushed() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            sizes = np.array([len(r) for r in rows], np.int64)
            tokens = np.concatenate(rows) if sizes.sum() else np.empty(0, np.uint32)
            order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")
            to = np.empty(len(order), np.uint32)
            to[order] = np.arange(len(order), dtype=np.uint32)
            hashes, tokens = np.append(hashes[order], np.uint64(END_HASH)), to[tokens]
            flags = np.array(train, bool)
            counts = np.bincount(tokens[np.repeat(flags, sizes)], minlength=len(hashes))
            counts[-1] += flags.sum()
            values = [part << _SERIAL | serial, pickle.dumps(ids), np.packbits(flags).tobytes(), common.squeezed(sizes.astype(np.uint32)), common.squeezed(tokens), hashes.view(np.int64), counts, int(counts.sum()), int(flags.sum())]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)

        for batch in batches:
            for doc_id, text, learns in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = _tokens(text.as_py())
                ids.append(doc_id)
                train.append(bool(learns))
                rows.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
                size += sum(map(len, words)) + len(words) + 1
                if size >= CHUNK or len(ids) >= CHUNK_DOCS:
                    yield flushed()
                    numbers, ids, train, rows, size, serial = {}, [], [], [], 0, serial + 1
        if ids:
            yield flushed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "train").mapInArrow(make, _CHUNKS)


def word_counts(made: DataFrame, n: int) -> DataFrame:
    """For every chunk its words' numbers and counts over all chunks; `kinds`, the learned words that it is the first to hold; and of these the hot ones."""
    listed = made.select("chunk", F.posexplode(F.arrays_zip("words", "c")).alias("pos", "x")).select("chunk", "pos", F.col("x.words").alias("word"), F.col("x.c").alias("c"))
    same = Window.partitionBy("word")  # one row for each chunk
    at = F.shiftleft("chunk", _PLACE) + F.col("pos")
    total = listed.select("chunk", "pos", "word", F.sum("c").over(same).alias("c"), F.min(at).over(same).alias("number")).withColumn("first", F.col("number") == at)
    rows = F.sort_array(F.collect_list(F.struct("pos", "c", "number")))
    return total.groupBy("chunk").agg(
        rows.alias("rows"), F.sum((F.col("first") & (F.col("c") > 0)).cast("long")).alias("kinds"),
        F.collect_list(F.when(F.col("first") & (F.col("c") * HOT > n), F.struct("word", "number"))).alias("hot")
    ).select("chunk", F.col("rows.c").alias("counts"), F.col("rows.number").alias("numbers"), "kinds", "hot")


class _Chunk:
    """A row of `chunks`: for every token of its documents, ends included, the places of u, v and w among the chunk's words
    (the last is the end, the start comes after it), and of the document."""

    def __init__(self, ids: bytes, train: bytes, sizes: bytes, tokens: bytes, words: int):
        self.ids = pickle.loads(ids)
        n = common.expanded(sizes, np.uint32).astype(np.int64)
        self.train = np.unpackbits(np.frombuffer(train, np.uint8))[: len(n)].astype(bool)
        long = np.full(int((n + 3).sum()), words, np.uint32)  # two starts, the tokens and an end for each document
        at = np.concatenate([[0], np.cumsum(n + 3)[:-1]])
        self.doc = np.repeat(np.arange(len(n), dtype=np.uint32), n + 1)
        place = np.arange(len(self.doc)) + 2 * self.doc.astype(np.int64) + 2
        is_end = np.zeros(len(long), bool)
        is_end[at + n + 2] = True
        long[place[~is_end[place]]] = common.expanded(tokens, np.uint32)
        long[at + n + 2] = words - 1
        self.w, self.v, self.u = (long[place - k] for k in (0, 1, 2))
        self.n = n + 1


def _hash(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c) * _M2
        out ^= out >> np.uint64(31)
    return out


class Block:
    """Trigrams of some texts: v, w and u as places in `words` (rising numbers, with their counts, 1 at most where only u is meant), places in `docs` (rising
    handles of documents), how often, and whether that document is learned from."""

    FIELDS = ("words", "counts", "docs", "v", "w", "u", "doc", "times", "learn")

    def __init__(self, *arrays: np.ndarray):
        for name, a in zip(self.FIELDS, arrays):
            setattr(self, name, a)

    def packed(self) -> bytes:
        v, w = (np.diff(x.astype(np.int32), prepend=np.int32(0)) for x in (self.v, self.w))  # rows are sorted, so most steps are small
        arrays = [np.diff(self.words, prepend=np.uint64(0)), self.counts, np.diff(self.docs, prepend=0), v, w, *(x.astype(np.uint32) for x in (self.u, self.doc, self.times)), np.packbits(self.learn)]
        return pickle.dumps((len(self.v), [common.squeezed(a) for a in arrays]), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> Block:
        n, raw = pickle.loads(data)
        kinds = [np.uint64, np.int64, np.int64, *[np.int32] * 2, *[np.uint32] * 3, np.uint8]
        words, counts, docs, v, w, u, doc, times, learn = (common.expanded(r, k) for r, k in zip(raw, kinds))
        v, w = (np.cumsum(x, dtype=np.int32).astype(np.uint32) for x in (v, w))
        return cls(np.cumsum(words), counts, np.cumsum(docs), v, w, u, doc, times, np.unpackbits(learn)[:n].astype(bool))

    @classmethod
    def merged(cls, blocks: list[Block]) -> Block:
        words = np.concatenate([b.words for b in blocks])
        order = np.argsort(words, kind="stable")
        words = words[order]
        first = _edges(words)
        words, counts = words[first], np.maximum.reduceat(np.concatenate([b.counts for b in blocks])[order], first)
        docs = _sorted(np.concatenate([b.docs for b in blocks]))
        maps = [np.searchsorted(words, b.words).astype(np.uint32) for b in blocks]
        spread = [np.concatenate([m[getattr(b, x)] for m, b in zip(maps, blocks)]) for x in "vwu"]
        doc = np.concatenate([np.searchsorted(docs, b.docs).astype(np.uint32)[b.doc] for b in blocks])
        return cls(words, counts, docs, *spread, doc, np.concatenate([b.times for b in blocks]), np.concatenate([b.learn for b in blocks]))

    def some(self, rows: np.ndarray) -> Block:
        v, w, u, doc = self.v[rows], self.w[rows], self.u[rows], self.doc[rows]
        used = np.zeros(len(self.words), np.int8)
        used[u] = 1
        for x in (v, w):
            used[x] = 2
        # of a word that only stands before others it matters whether it is known, not how often it occurs
        counts = np.where(used == 2, self.counts, np.minimum(self.counts, 1))
        used = used > 0
        to = (np.cumsum(used) - 1).astype(np.uint32)
        docs = np.unique(doc)
        return Block(self.words[used], counts[used], self.docs[docs], to[v], to[w], to[u], np.searchsorted(docs, doc), self.times[rows], self.learn[rows])

    def dealt(self, shards: int, width: int, hot: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, Block]]:
        """This block's parts for groups of `width` shards."""
        part = (_hash(self.words) % np.uint64(shards)).astype(np.int32)[self.v]
        rows = np.flatnonzero(np.isin(self.words, hot)[self.v])
        key = _hash(self.words[self.v[rows]], self.words[self.w[rows]])
        part[rows] = key % np.uint64(shards)
        rows, key = rows[known := np.isin(key, pairs)], key[known]
        part[rows] = _hash(key, self.words[self.u[rows]]) % np.uint64(shards)
        part //= width
        order = np.argsort(part, kind="stable")
        edges = _edges(part[order])
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            yield int(part[order[a]]), self.some(order[a:b])


def hot_pairs(made: DataFrame, words: dict[int, int], n: int) -> dict[tuple[int, int], int]:
    """Numbers (v, w) and count of the pairs of hot words that are more than 1/HOT of all training tokens; END and START
    are among them. words: the hot words' numbers by their hashes."""
    hot = np.array(sorted(words), np.uint64)
    numbers = [*(words[int(h)] for h in hot), END, START]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = len(hot) + 2
        counts = np.zeros(kinds**2, np.int64)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                *fields, words = row
                chunk, hashes = _Chunk(*fields, len(words)), np.append(np.array(words, np.int64).view(np.uint64), np.uint64(0))
                place = np.where(np.isin(hashes, hot), np.searchsorted(hot, hashes), -1)
                place[-2:] = len(hot), len(hot) + 1
                v, w = place[chunk.v], place[chunk.w]
                good = (v >= 0) & (w >= 0) & chunk.train[chunk.doc]
                counts += np.bincount(v[good] * kinds + w[good], minlength=len(counts))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["pair", "c"])

    rows = made.select("ids", "train", "sizes", "tokens", "words").mapInArrow(count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).filter(F.col("c") * HOT > n)
    return {(numbers[r["pair"] // len(numbers)], numbers[r["pair"] % len(numbers)]): r["c"] for r in rows.collect()}  # fewer than HOT rows


_BLOCKS = "part int, block binary"
_SCORED = "doc_id long, n_tokens long, n_known long, base double, model double"


def blocks(made: DataFrame, shards: int, hot: np.ndarray, pairs: np.ndarray, n: int, kinds: int, learnt: int) -> GroupedData:
    """(part, block), grouped by part, of chunks with their words' counts; a part below 0 holds documents with their base scores."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (number, *fields) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
                counts, numbers = (c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns[5:])
                chunk = _Chunk(*fields, len(counts))
                of = np.append(counts, learnt)
                words = np.append(numbers, START).astype(np.uint64)
                words[-2] = END
                base, known = np.log10((of + 1) / (n + kinds + 1))[chunk.w], (of > 0)[chunk.w]
                docs = (number << 16) + np.arange(len(chunk.ids))
                sums = [np.bincount(chunk.doc, x, len(docs)) for x in (known, base)]
                yield _rows([-1 - int(_part(docs[:1], shards)[0])], [pickle.dumps((docs, chunk.ids, chunk.n, *sums), protocol=5)])
                rank = np.argsort(words)
                to = np.empty(len(rank), np.uint32)
                to[rank] = np.arange(len(rank), dtype=np.uint32)
                v, w, u, doc = to[chunk.v], to[chunk.w], to[chunk.u], chunk.doc
                order = _order(v, w, u, len(rank))  # documents stay in their order
                v, w, u, doc = (x[order] for x in (v, w, u, doc))
                first = _edges(v, w, u, doc)
                times = np.diff(np.append(first, len(v)))
                whole = Block(words[rank], of[rank], docs, v[first], w[first], u[first], doc[first], times, chunk.train[doc[first]])
                for part, block in whole.dealt(shards, common.width_of(shards), hot, pairs):
                    yield _rows([part], [block.packed()])

    out = made.select("chunk", "ids", "train", "sizes", "tokens", "counts", "numbers").mapInArrow(make, _BLOCKS)
    return common.dealt_on(out, "part", shards, lambda held, width: [(p, b.packed()) for p, b in Block.merged(list(map(Block.unpacked, held))).dealt(shards, width, hot, pairs)], MERGED)


def _rows(parts: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["part", "block"])


def _trained(block: Block, n: int, kinds: int, pairs: dict[tuple[int, int], int]) -> tuple[Trie, np.ndarray]:
    """The trie of a shard's training texts, and the rank in it of each of the block's words. Its rows are sorted by (v, w, u)."""
    known = np.flatnonzero((block.counts > 0) | (block.words == np.uint64(START)))
    words = block.words[known]
    to = np.full(len(block.words), -1, np.int64)
    to[known] = np.arange(len(known))
    rows = np.flatnonzero(block.learn)
    v, w, u = (to[getattr(block, x)[rows]] for x in "vwu")
    first = _edges(v, w, u)
    c = np.add.reduceat(block.times[rows], first) if len(rows) else np.empty(0, np.int64)
    place = {int(x): i for i, x in enumerate(words) if pairs}
    spread = {(place[a], place[b]): count for (a, b), count in pairs.items() if a in place and b in place}
    p = (block.counts[known] + 1) / (n + kinds + 1)
    trie = Trie(words, p, block.counts[known], v[first], w[first], u[first], c, spread)
    return trie, trie.rank(block.words)


def _part(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part of documents by their handles: that of their chunk."""
    return (_hash((docs >> 16).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _sums(docs: np.ndarray, sums: np.ndarray, parts: int, width: int) -> list[tuple[int, bytes]]:
    """Sums by handles of documents (rising), in one block for each group of `width` parts."""
    part = _part(docs, parts) // width
    order = np.argsort(part, kind="stable")
    first = _edges(part[order])
    return [(int(part[order[a]]), pickle.dumps((docs[order[a:b]], sums[order[a:b]]), protocol=5)) for a, b in zip(first, np.append(first[1:], len(order)))]


def _added(blocks: list[bytes], parts: int, width: int) -> list[tuple[int, bytes]]:
    """Blocks of sums put together and dealt to groups of `width` parts; blocks of documents go with them."""
    held = [pickle.loads(b) for b in blocks]
    out = [(int(_part(h[0][:1], parts)[0]) // width, b) for h, b in zip(held, blocks) if len(h) > 2]
    if sums := [h for h in held if len(h) == 2]:
        docs, values = (np.concatenate(x) for x in zip(*sums))
        every = _sorted(docs)
        out += _sums(every, np.bincount(np.searchsorted(every, docs), values, len(every)), parts, width)
    return out


def _answer(n: int, kinds: int, pairs: dict[tuple[int, int], int], shards: int):
    unknown = float(-np.log10(n + kinds + 1))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """Builds a shard's trie from its training texts and looks up all its texts' trigrams: sums for each document, in
        blocks for the parts of the documents."""
        if pdf["part"].iloc[0] < 0:
            return pd.DataFrame({"part": (-1 - pdf["part"]) // common.width_of(shards), "block": pdf["block"]})
        block = Block.merged([Block.unpacked(b) for b in pdf["block"]])
        order = _order(block.v, block.w, block.u, len(block.words))
        for x in ("v", "w", "u", "doc", "times", "learn"):
            setattr(block, x, getattr(block, x)[order])
        trie, rank = _trained(block, n, kinds, pairs)
        first = _edges(block.v, block.w, block.u)  # each distinct trigram is looked up once
        numerator, denominator = trie.score(*(rank[getattr(block, x)[first]] for x in "vwu"), unknown)
        value = numerator + np.where(block.words[block.w[first]] == np.uint64(END), 0.0, denominator)
        sums = np.bincount(block.doc, block.times * np.repeat(value, np.diff(np.append(first, len(block.v)))), len(block.docs))
        return pd.DataFrame(_sums(block.docs, sums, shards, common.width_of(shards)), columns=["part", "block"])

    return answer


def _documents(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of a part with the sums of all shards. Sums are pairs; documents have ids and base scores as well."""
    held = [pickle.loads(b) for b in pdf["block"]]
    infos, sums = [h for h in held if len(h) > 2], [h for h in held if len(h) == 2]
    handles, n_tokens, known, base = (np.concatenate([h[k] for h in infos]) for k in (0, 2, 3, 4))
    order = np.argsort(handles)
    place = order[np.searchsorted(handles[order], np.concatenate([h[0] for h in sums]))]
    model = np.bincount(place, np.concatenate([h[1] for h in sums]), len(handles))
    ids = pd.array([i for h in infos for i in h[1]], "Int64")
    return pd.DataFrame({"doc_id": ids, "n_tokens": n_tokens, "n_known": known.astype(np.int64), "base": base, "model": model})


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text, train)."""
    common.small_batches(docs.sparkSession)
    made = common.stored(chunks(docs), "chunks")
    total = made.agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt")).first()
    n, learnt = int(total["n"] or 0), int(total["learnt"] or 0)
    counts = common.stored(word_counts(made.select("chunk", "words", "c"), n), "words")
    kinds = int(counts.agg(F.sum("kinds")).first()[0] or 0)
    words = {r["word"] % 2**64: r["number"] for r in counts.select(F.explode("hot").alias("h")).select("h.*").collect()}  # fewer than HOT rows
    words.pop(END_HASH, None)
    hot = np.array(sorted([*words.values(), END, START]), np.uint64)
    pairs = hot_pairs(made, words, n)
    common.tidy(docs.sparkSession)  # the shuffles of words aren't needed any more
    keys = _hash(*(np.array(x, np.uint64) for x in zip(*pairs))) if pairs else np.empty(0, np.uint64)
    shards = max(common.partitions(docs.sparkSession), -(-n // SHARD_TOKENS))
    dealt = blocks(made.drop("words", "c").join(counts.select("chunk", "counts", "numbers"), "chunk"), shards, hot, keys, n, kinds, learnt)
    parts = dealt.applyInPandas(_answer(n, kinds, pairs, shards), _BLOCKS)
    parts = common.dealt_on(parts, "part", shards, lambda held, width: _added(held, shards, width), MERGED)
    summed = parts.applyInPandas(_documents, _SCORED)
    begin = float(-np.log10(learnt + MU3))  # the first token's context
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("model") + F.lit(begin)).alias("score"))


def query(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    held_out = common.doc_remainder("doc_id", 7) == 2
    scored = score(docs.select("doc_id", "text", (~held_out).alias("train")))
    return scored.withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
