"""Removal of repeated passages by prefix-free parsing.

A byte is removed if a LENGTH-byte string that covers it also starts earlier (in a document with a smaller doc_id, or
earlier in the same one). Parsing: a rolling hash of GRAM bytes has its triggers where it is least among REACH consecutive
places; triggers cut the text into phrases. The trigger of a LENGTH-byte string is the least of its first REACH places, so
it depends on the string alone, and equal strings have equal triggers at equal distances. All strings with one trigger
start in one phrase and end in the phrases after it; the bytes they cover are the trigger's context.

Dictionary: the distinct contexts, each with its first place in the corpus. Wherever a context appears again, all its strings
do, and they are removed without looking at them singly. Parse order: contexts are sorted by the hash of the bytes that all
strings of a trigger share, which brings suffixes of the parse with equal beginnings together, then by context, then by
place in the corpus. Only where one beginning has several contexts can single strings be repeated. Those contexts are cut into
pieces, of the strings whose distances from the trigger have one quotient by PIECE, and pieces go the same way, by the bytes
that all strings of a full piece share; where these have several pieces, single strings are hashed and sorted in the same way. The order is by hashes (128 bits), not alphabetical: of the corpus order only
equality over LENGTH bytes and the first place matter here, so no suffix is ever compared beyond that.

Distribution: a task turns about CHUNK bytes of documents into sorted blocks for the shards of the hash space, removing
repeats inside the chunk first; so a passage that a third of all documents share sends one record per chunk. A beginning with more than
FREQUENT contexts in one chunk (a very common line) isn't gathered either: its strings go on to be hashed, and a mark
tells its shard; pieces likewise. Nothing is dropped. The number of shards follows the input. Where there are more than common.FAN of them, blocks go
to groups of shards first, are put together there and dealt on, and so do results on their way to parts of the documents: the
number of blocks follows the input, not its square. What is dealt twice lies on disk twice, so blocks hold all but the hashes
compressed, and a single string, 25 bytes for one byte of text, is made only inside pieces that need it.

Defined cases: null text counts as empty; texts shorter than LENGTH lose nothing; a null doc_id comes after all others; rows
that share doc_id but not text are ordered by a hash of the text; rows equal in both are one document and get the same
result; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM, REACH = 100, 8, 64
SHARED = LENGTH - REACH + 1
#: Bytes of documents in a chunk, bytes hashed at a time, records of a shard.
CHUNK, SEGMENT, SHARD_RECORDS = 8_000_000, 1 << 20, 1_000_000
FREQUENT = 64
#: Strings of a full piece of a context.
PIECE = 8
#: Bytes of blocks put together on the way.
MERGED = 32_000_000
LAST = np.iinfo(np.int64).max
_RNG = np.random.default_rng(5)
_T = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_M = np.uint64(0xC2B2AE3D27D4EB4F)
_MARK = np.uint32(2**32 - 1)


def _table(base: int) -> np.ndarray:
    steps = np.full(SEGMENT + LENGTH + 1, np.uint64(base))
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    if not _POWERS:
        _POWERS.extend((_table(b), _table(pow(b, -1, 2**64))) for b in _BASE)
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of all substrings of at most SEGMENT + LENGTH bytes, from two rolling sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = []
        for k, (up, _) in enumerate(_powers()):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_T[k][data] * up[:n], out=total[1:])
            self.sums.append(total)

    def of(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[k][end] - self.sums[k][start]) * _powers()[k][1][start])


def segments(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of string starts of a text of n bytes."""
    for s in range(0, n - LENGTH + 1, SEGMENT):
        yield s, min(s + SEGMENT, n - LENGTH + 1)


def contexts(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """beginning, context, first start and last start of each trigger of a text."""
    out = []
    for s0, s1 in segments(len(data)):
        h = Hashes(data[s0 : s1 + LENGTH - 1])
        n = s1 - s0
        places = np.arange(n + REACH - 1)
        least = h.of(0, places, places + GRAM) >> np.uint64(24) << np.uint64(24) | places.astype(np.uint64)
        step = 1
        while step < REACH:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        trigger = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        hi = np.append(lo[1:], n) - 1
        at = trigger[lo]
        shape = (hi - lo).astype(np.uint64) << np.uint64(8) | (at - lo).astype(np.uint64)
        context = h.of(0, lo, hi + LENGTH) + _mix(h.of(1, lo, hi + LENGTH) + shape)
        out.append((h.of(1, at, at + SHARED) ^ h.of(0, at, at + SHARED) >> np.uint64(1), context, (lo + s0).astype(np.uint32), (hi + s0).astype(np.uint32)))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.uint32),) * 2


def pieces(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for the pieces of the contexts with starts lo..hi, as `contexts` gave them."""
    lo, once = np.unique(lo.astype(np.int64), return_index=True)
    hi = hi.astype(np.int64)[once]
    out = []
    for s0, s1 in segments(len(data)):
        mine = (lo >= s0) & (lo < s1)
        if mine.any():
            h = Hashes(data[s0 : s1 + LENGTH - 1])
            a, b = lo[mine] - s0, hi[mine] - s0
            places = a[:, None] + np.arange(REACH)
            at = a + (h.of(0, places, places + GRAM) >> np.uint64(24)).argmin(axis=1)
            near = (at - b) // PIECE
            size = (at - a) // PIECE - near + 1
            a, b, at = (np.repeat(x, size) for x in (a, b, at))
            piece = np.repeat(near - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            last = at - piece * PIECE
            a, b = np.maximum(a, last - PIECE + 1), np.minimum(b, last)
            shape = (b - a).astype(np.uint64) << np.uint64(8) | (at - a).astype(np.uint64)
            context = h.of(0, a, b + LENGTH) + _mix(h.of(1, a, b + LENGTH) + shape)
            end = last + LENGTH - PIECE + 1
            key = (h.of(1, last, end) ^ h.of(0, last, end) >> np.uint64(1)) + _mix(piece.astype(np.uint64))
            out.append((key, context, (a + s0).astype(np.uint32), (b + s0).astype(np.uint32)))
    return tuple(map(np.concatenate, zip(*out)))


def strings(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for the single strings that start in the ranges lo..hi."""
    size = (hi.astype(np.int64) - lo + 1)
    start = np.unique(np.repeat(lo.astype(np.int64) - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()))
    out = []
    for s0, s1 in segments(len(data)):
        mine = start[(start >= s0) & (start < s1)]
        if len(mine):
            h = Hashes(data[s0 : s1 + LENGTH - 1])
            at = mine - s0
            out.append((h.of(0, at, at + LENGTH), h.of(1, at, at + LENGTH), mine.astype(np.uint32), mine.astype(np.uint32)))
    return tuple(map(np.concatenate, zip(*out)))


_RECORDS = "shard int, block binary"
_FOUND = "doc long, print long, single boolean, ranges binary"


def _doc_ranks(docs: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The place of each document in the corpus order; equal documents share one."""
    order = np.lexsort((prints, docs))
    new = np.concatenate([[False], (docs[order][1:] != docs[order][:-1]) | (prints[order][1:] != prints[order][:-1])]) if len(docs) else np.empty(0, bool)
    rank = np.empty(len(docs), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class Ranges:
    """Ranges of starts in documents: of each its document, whether it is to be looked at more closely, first start and how many follow."""

    FIELDS = ("doc", "print", "single", "lo", "span")

    def __init__(self, *arrays: np.ndarray):
        for name, a in zip(self.FIELDS, arrays):
            setattr(self, name, a)

    @classmethod
    def of(cls, docs: np.ndarray, prints: np.ndarray, of: np.ndarray, lo: np.ndarray, span: np.ndarray, single: bool) -> Ranges:
        return cls(docs[of], prints[of], np.full(len(of), single), lo.astype(np.uint32), span.astype(np.uint8))

    @classmethod
    def merged(cls, parts: list[Ranges]) -> Ranges:
        return cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in cls.FIELDS))

    def sorted(self) -> tuple[Ranges, np.ndarray]:
        """By document and kind, and where each of these begins."""
        order = np.lexsort((self.lo, self.single, self.print, self.doc))
        out = Ranges(*(getattr(self, f)[order] for f in self.FIELDS))
        new = np.any([x[1:] != x[:-1] for x in (out.doc, out.print, out.single)], axis=0)
        return out, np.flatnonzero(np.concatenate([[True], new])) if len(order) else np.empty(0, np.int64)

    def packed(self) -> bytes:
        r, edges = self.sorted()
        small = (_delta(r.doc[edges].astype(np.uint64)), r.single[edges], np.diff(np.append(edges, len(r.lo))).astype(np.uint32), r.lo, r.span)
        return pickle.dumps((list(map(common.squeezed, small)), r.print[edges].tobytes()), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> Ranges:
        small, print_ = pickle.loads(data)
        doc, single, size, lo, span = (common.expanded(x, kind) for x, kind in zip(small, (np.uint64, np.bool_, np.uint32, np.uint32, np.uint8)))
        return cls(*(np.repeat(x, size) for x in (np.cumsum(doc, dtype=np.uint64).astype(np.int64), np.frombuffer(print_, np.int64), single)), lo, span)

    def dealt(self, parts: int, width: int) -> Iterator[tuple[int, bytes]]:
        """Blocks for groups of `width` parts of the documents."""
        group = (_mix(self.doc.astype(np.uint64) ^ _mix(self.print.astype(np.uint64))) % np.uint64(parts)).astype(np.int64) // width
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0])) if len(order) else np.empty(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            yield int(group[order[a]]), Ranges(*(getattr(self, f)[order[a:b]] for f in self.FIELDS)).packed()


def _chunk(docs: list[int], prints: list[int], found: list[tuple], shards: int, serial: int, whole: bool) -> list[tuple[int, bytes]]:
    """Blocks of a chunk: for every shard its records, and what is settled in the chunk (under -1 - shard)."""
    docs_, prints_ = np.array(docs, np.int64), np.array(prints, np.int64)
    rank = _doc_ranks(docs_, prints_)
    of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    key, context, lo, hi = (np.concatenate(c) for c in zip(*found))
    place = rank[of].astype(np.uint64) << np.uint64(32) | lo
    order = np.lexsort((place, context, key))
    key, context, lo, hi, of, place = (x[order] for x in (key, context, lo, hi, of, place))
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])])
    group = np.cumsum(first) - 1
    again = place > place[first][group]
    settled = [Ranges.of(docs_, prints_, of[again], lo[again], hi[again] - lo[again], False)]
    key, context, lo, hi, of = (x[first] for x in (key, context, lo, hi, of))
    if whole:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        frequent = np.repeat(size > FREQUENT, size)
        settled.append(Ranges.of(docs_, prints_, of[frequent], lo[frequent], hi[frequent] - lo[frequent], True))
        marks = key[edge[size > FREQUENT]]
        keep = ~frequent
        key, context = np.concatenate([key[keep], marks]), np.concatenate([context[keep], marks])
        lo, hi, of = (np.concatenate([x[keep], np.full(len(marks), f)]) for x, f in ((lo, 0), (hi, 0), (of, _MARK)))
    ranges = Ranges.merged(settled)
    out = [(-1 - serial % shards, ranges.packed())] if len(ranges.lo) else []
    order = np.lexsort((lo, of))  # which blocks keep, for their small numbers
    key, context, lo, hi, of = (x[order] for x in (key, context, lo, hi, of))
    records = Records(docs_, prints_, of.astype(np.uint32), key, context, lo.astype(np.uint32), (hi - lo).astype(np.uint8))
    return out + [(s, r.packed()) for s, r in records.dealt(shards, common.width_of(shards))]


class Records:
    """Contexts or strings: documents, and for each record its place among them (_MARK for a mark), key, context, first start
    and how many starts follow."""

    FIELDS = ("docs", "prints", "of", "key", "context", "lo", "span")

    def __init__(self, *arrays: np.ndarray):
        for name, a in zip(self.FIELDS, arrays):
            setattr(self, name, a)

    def packed(self) -> bytes:
        """Hashes as they are, the rest compressed."""
        small = (_delta(self.docs.astype(np.uint64)), _delta(self.of), self.lo, self.span)
        return pickle.dumps((list(map(common.squeezed, small)), self.prints.tobytes(), self.key.tobytes(), self.context.tobytes()), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> Records:
        small, *hashes = pickle.loads(data)
        docs, of, lo, span = (common.expanded(x, kind) for x, kind in zip(small, (np.uint64, np.uint32, np.uint32, np.uint8)))
        prints, key, context = (np.frombuffer(x, kind) for x, kind in zip(hashes, (np.int64, np.uint64, np.uint64)))
        return cls(np.cumsum(docs, dtype=np.uint64).astype(np.int64), prints, np.cumsum(of, dtype=np.uint32), key, context, lo, span)

    @classmethod
    def merged(cls, parts: list[Records]) -> Records:
        shift = np.cumsum([0] + [len(p.docs) for p in parts[:-1]])
        of = np.concatenate([np.where(p.of == _MARK, _MARK, p.of + np.uint32(s)) for p, s in zip(parts, shift)]).astype(np.uint32)
        docs, prints, key, context, lo, span = (np.concatenate([getattr(p, f) for p in parts]) for f in ("docs", "prints", "key", "context", "lo", "span"))
        return cls(docs, prints, of, key, context, lo, span)

    def dealt(self, shards: int, width: int) -> Iterator[tuple[int, Records]]:
        """The records' parts for groups of `width` shards."""
        group = (self.key % np.uint64(shards)).astype(np.int64) // width
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0])) if len(order) else np.empty(0, np.int64)
        for a, b in zip(first, np.append(first[1:], len(order))):
            mine = order[a:b]
            used, back = np.unique(self.of[mine], return_inverse=True)
            real = used[used != _MARK]
            of = np.where(self.of[mine] == _MARK, _MARK, back).astype(np.uint32)
            yield int(group[order[a]]), Records(self.docs[real], self.prints[real], of, *(getattr(self, f)[mine] for f in ("key", "context", "lo", "span")))


def _records(docs: DataFrame, shards: int, make_of: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """Blocks of docs (doc, print, text): of `contexts`, or of the `pieces` or single `strings` in `ranges`."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, size = TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = ([], [], [])

        def flushed() -> Iterator[pa.RecordBatch]:
            for s, block in _chunk(*held, shards, serial, make_of is not strings):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([block], pa.binary())], schema=schema)
            for x in held:
                x.clear()

        for batch in batches:
            for i, (doc, print_, text) in enumerate(zip(batch.column(0), batch.column(1), batch.column(2))):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                if len(data) < LENGTH:
                    continue
                if make_of is contexts:
                    found = contexts(data)
                else:
                    ranges = np.frombuffer(batch.column(3)[i].as_py(), np.uint32).reshape(-1, 2)
                    found = make_of(data, ranges[:, 0], ranges[:, 1])
                for x, y in zip(held, (doc.as_py(), print_.as_py(), found)):
                    x.append(y)
                size += len(data) if make_of is contexts else 32 * len(found[0])
                if size >= CHUNK:
                    yield from flushed()
                    size = 0
        if held[0]:
            yield from flushed()

    return docs.mapInArrow(make, _RECORDS)


_PARTS = "part int, block binary"


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for each document and kind, with all its ranges as pairs of 32-bit numbers."""
    r, edges = Ranges.merged(list(map(Ranges.unpacked, pdf["block"]))).sorted()
    pairs = np.stack([r.lo, r.lo + r.span], axis=1).astype(np.uint32)
    ends = np.append(edges[1:], len(r.lo))
    return pd.DataFrame({"doc": r.doc[edges], "print": r.print[edges], "single": r.single[edges], "ranges": [pairs[a:b].tobytes() for a, b in zip(edges, ends)]})


def _settle(whole: bool, shards: int):
    def given(found: list[Ranges]) -> pd.DataFrame:
        return pd.DataFrame(Ranges.merged(found).dealt(shards, common.width_of(shards)), columns=["part", "block"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sorts a shard's records and gives the ranges that are repeats, and those to be looked at more closely."""
        if pdf["shard"].iloc[0] < 0:
            return given(list(map(Ranges.unpacked, pdf["block"])))
        all_ = Records.merged([Records.unpacked(b) for b in pdf["block"]])
        docs, prints, key, context, lo, span = all_.docs, all_.prints, all_.key, all_.context, all_.lo, all_.span
        of = np.where(all_.of == _MARK, -1, all_.of.astype(np.int64))
        del all_
        rank = np.append(_doc_ranks(docs, prints), 0)
        mark = of < 0
        place = rank[of].astype(np.uint64) << np.uint64(32) | lo
        order = np.lexsort((place, context, key))
        key, context, lo, span, of, place, mark = (x[order] for x in (key, context, lo, span, of, place, mark))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        first = new_key | np.concatenate([[True], context[1:] != context[:-1]])
        group = np.cumsum(first) - 1
        again = (place > place[first][group]) & ~mark
        found = [Ranges.of(docs, prints, of[again], lo[again], span[again], False)]
        if whole:
            of_key = np.cumsum(new_key) - 1
            several = np.bincount(of_key, first) + np.bincount(of_key, mark) > 1
            single = ~again & ~mark & several[of_key]
            found.append(Ranges.of(docs, prints, of[single], lo[single], span[single], True))
        return given(found)

    return settle


def _settled(blocks: DataFrame, whole: bool, shards: int) -> DataFrame:
    records = common.dealt_on(blocks, "shard", shards, lambda held, width: [(s, r.packed()) for s, r in Records.merged(list(map(Records.unpacked, held))).dealt(shards, width)], MERGED)
    parts = records.applyInPandas(_settle(whole, shards), _PARTS)
    parts = common.dealt_on(parts, "part", shards, lambda held, width: Ranges.merged(list(map(Ranges.unpacked, held))).dealt(shards, width), MERGED)
    return parts.applyInPandas(_by_document, _FOUND)


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("print"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text and `spans`, the removed byte ranges of every row of docs, as pairs of 32-bit numbers (start, end)."""
    common.small_batches(docs.sparkSession)
    rows = _identified(docs)
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(common.partitions(docs.sparkSession), -(-volume // (REACH // 2 * SHARD_RECORDS)))
    blocks = _records(rows.select("doc", "print", "text"), shards, contexts)
    found = [common.stored(_settled(blocks, True, shards), "contexts")]
    common.tidy(docs.sparkSession)
    for make_of in (pieces, strings):
        looked = rows.join(found[-1].filter("single").drop("single"), ["doc", "print"]).select("doc", "print", "text", "ranges")
        blocks = _records(looked, shards, make_of)
        found.append(common.stored(_settled(blocks, make_of is not strings, shards), make_of.__name__))
        del looked, blocks
        common.tidy(docs.sparkSession)

    gone = functools.reduce(DataFrame.union, found).filter("not single").groupBy("doc", "print").agg(F.collect_list("ranges").alias("ranges"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for ranges in batch.column(2):
                pairs = np.frombuffer(b"".join(ranges.as_py() or []), np.uint32).reshape(-1, 2).astype(np.int64)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                end = np.maximum.accumulate(pairs[:, 1] + LENGTH)
                start = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > end[:-1]])) if len(pairs) else np.empty(0, np.int64)
                last = np.append(start[1:], len(pairs)) - 1 if len(pairs) else start
                spans.append(np.stack([pairs[start, 0], end[last]], axis=1).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.binary())], names=["doc_id", "text", "spans"])

    return rows.join(gone, ["doc", "print"], "left").select("doc_id", "text", "ranges").mapInArrow(cover, "doc_id long, text string, spans binary")


def digest(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data, at, kept = text.as_py().encode(), 0, hashlib.sha256()
                pairs = np.frombuffer(spans.as_py(), np.uint32).reshape(-1, 2).tolist()
                for a, b in pairs:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((len(data), sum(b - a for a, b in pairs), len(pairs), kept.hexdigest()))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir):
    return digest(repeated(common.documents(spark, sf_dir)))
