"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order, 0 to ORDER, with frozen counts. A byte costs -log2 of its
probability in the longest context of that language that has been seen with the byte; each longer seen context adds the
cost of its escape (method C: escape d/(n+d), symbol c/(n+d), for n occurrences and d distinct symbols). Below order 0
all 256 bytes are equally likely. A text's code length under a language is the exact sum over all its bytes; the
shortest wins, ties go to the smaller name.

Every language that has a text is learned, from about SAMPLE documents chosen by hashed id, whole texts up to an equal share
of BYTES for each language; the text that fills the share is cut there. That bounds the trees; the more languages, the less
text of each. A language's tree is counted in a task of its own. The driver gathers and broadcasts packed trees only, and
workers unpack them. Scoring is one pass over whole texts without a shuffle. Costs of the most frequent byte strings seen in
learning lie in one table probed by hash; others are worked out from the trees once for each batch.

Defined cases: null text or text without a letter is `und` with score 0; without anything to learn from, all is
`und`; null lang is never learned from; further columns are ignored; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER = 4
#: Bounds of what is learned from: documents of a language, bytes of all languages.
SAMPLE, BYTES = 400, 8_000_000
UNKNOWN = "und"
_PAD = b"\n" * ORDER
_LETTER = re.compile("[A-Za-z]")
_SLICE = 1 << 19
#: Costs (strings times languages) worked on at once, and held in the table.
_CELLS, _TABLE = 1 << 22, 1 << 24


def grams(buffer: np.ndarray) -> np.ndarray:
    """For each byte from ORDER on: it and the ORDER bytes before it, as one number, the byte itself lowest."""
    n = len(buffer) - ORDER
    out = np.zeros(n, np.uint64)
    for j in range(ORDER, -1, -1):
        out = (out << np.uint64(8)) | buffer[ORDER - j : ORDER - j + n].astype(np.uint64)
    return out


class Tree:
    """Context tree of one language: for each order, contexts with their counts and followers with theirs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys: the distinct strings of ORDER + 1 bytes, sorted, as `grams` gives them; counts: how often each occurs."""
        self.strings, self.counts = keys, counts
        self.levels = []
        for k in range(ORDER, -1, -1):
            if k < ORDER:
                short = keys & np.uint64((1 << 8 * (k + 1)) - 1)
                order = np.argsort(short, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(short[order]) > 0]))
                keys, counts = short[order][first], np.add.reduceat(counts[order], first)
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            ends = np.append(first[1:], len(keys))
            total = np.add.reduceat(counts, first)
            self.levels.insert(0, (keys, counts.astype(np.float64), contexts, total.astype(np.float64), (ends - first).astype(np.float64)))

    @classmethod
    def of(cls, texts: list[str]) -> Tree:
        parts = [grams(np.frombuffer(_PAD + t.encode().translate(common.FOLD), np.uint8)) for t in texts]
        return cls(*np.unique(np.concatenate(parts), return_counts=True))

    def packed(self) -> bytes:
        """The strings, as differences, and their counts."""
        return zlib.compress(np.diff(self.strings, prepend=np.uint64(0)).tobytes() + self.counts.astype("<u4").tobytes(), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        raw = zlib.decompress(data)
        n = len(raw) // 12
        return cls(np.cumsum(np.frombuffer(raw, np.uint64, n)), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64))

    def cost(self, strings: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each string after the others."""
        bits = np.zeros(len(strings))
        todo = np.arange(len(strings))
        for k in range(ORDER, -1, -1):
            keys, counts, contexts, total, distinct = self.levels[k]
            s = strings[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, s >> np.uint64(8)), len(contexts) - 1)
            seen = contexts[at] == s >> np.uint64(8)
            here = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
            known = seen & (keys[here] == s)
            bits[todo[known]] -= np.log2(counts[here[known]] / (total[at[known]] + distinct[at[known]]))
            out = seen & ~known
            bits[todo[out]] -= np.log2(distinct[at[out]] / (total[at[out]] + distinct[at[out]]))
            todo = todo[~known]
        bits[todo] += 8
        return bits


class Model:
    """Trees by language. Where it is sent, packed trees travel; trees and the table of costs are made there when first asked for."""

    def __init__(self, packed: dict[str, bytes]):
        self.packed = packed
        self.languages = sorted(packed)
        self.trees: list[Tree] = []

    def __getstate__(self):
        return self.packed

    def __setstate__(self, state):
        self.__init__(state)

    @classmethod
    def of(cls, texts: dict[str, list[str]]) -> Model:
        return cls({name: Tree.of(t).packed() for name, t in texts.items()})

    def _unpack(self) -> None:
        self.trees = [Tree.unpacked(self.packed[name]) for name in self.languages]
        every = np.concatenate([t.strings for t in self.trees])
        counts = np.concatenate([t.counts for t in self.trees])
        room = max(10, (_TABLE // len(self.languages)).bit_length() - 1)
        self.shift = np.uint64(64 - min(room, max(10, int(len(every) * 4).bit_length())))
        self.slice = max(1024, min(_SLICE, _CELLS // len(self.languages)))
        order = np.lexsort((every, counts))  # of strings that share a slot the most frequent stays
        self.keys = np.full(1 << (64 - int(self.shift)), np.uint64(2**64 - 1))
        self.keys[self._slot(every[order])] = every[order]
        del every, counts, order
        self.costs = np.zeros((len(self.keys), len(self.languages)), np.float32)
        there = np.flatnonzero(self.keys != np.uint64(2**64 - 1))
        for at in range(0, len(there), self.slice):
            part = there[at : at + self.slice]
            self.costs[part] = self._exact(self.keys[part])

    def _slot(self, strings: np.ndarray) -> np.ndarray:
        return (strings * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _exact(self, strings: np.ndarray) -> np.ndarray:
        return np.stack([t.cost(strings) for t in self.trees], axis=1).astype(np.float32)

    def _costs(self, strings: np.ndarray) -> np.ndarray:
        slot = self._slot(strings)
        costs = self.costs[slot]
        other = np.flatnonzero(self.keys[slot] != strings)
        if len(other):
            distinct, back = np.unique(strings[other], return_inverse=True)
            costs[other] = self._exact(distinct)[back]
        return costs

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (a row) under each language (a column)."""
        if not self.trees:
            self._unpack()
        out = np.zeros((len(texts), len(self.languages)))
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) >= self.slice:
                buffer = np.frombuffer(_PAD + t, np.uint8)
                for at in range(0, len(t), self.slice):
                    out[i] += self._costs(grams(buffer[at : at + self.slice + ORDER])).sum(axis=0, dtype=np.float64)
            elif t:
                group.append(i)
                size += len(t)
            if group and (size >= self.slice or i == len(texts) - 1):
                self._group(texts, group, out)
                group, size = [], 0
        if group:
            self._group(texts, group, out)
        return out

    def _group(self, texts: list[bytes], group: list[int], out: np.ndarray) -> None:
        costs = self._costs(grams(np.frombuffer(_PAD + _PAD.join(texts[i] for i in group), np.uint8)))
        sizes = np.array([len(texts[i]) for i in group])
        start = np.concatenate([[0], np.cumsum(sizes[:-1] + ORDER)])
        edges = np.stack([start, start + sizes], axis=1).ravel()
        out[group] = np.add.reduceat(np.vstack([costs, np.zeros((1, costs.shape[1]), np.float32)]), edges, axis=0, dtype=np.float64)[::2]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        use = [i for i, t in enumerate(texts) if t and self.languages and (_LETTER.search(t) or any(map(str.isalpha, t)))]
        at_once = max(1, _CELLS // max(1, len(self.languages)))
        for at in range(0, len(use), at_once):
            part = use[at : at + at_once]
            bits = self.code_lengths([texts[i].encode().translate(common.FOLD) for i in part])
            for i, row in zip(part, bits):
                best = int(row.argmin())
                names[i] = self.languages[best]
                scores[i] = float(1 / np.exp2(-np.minimum(row - row[best], 1000.0)).sum())
        return names, scores


def _shared(texts: list[str], share: int) -> list[str]:
    """Of texts, in an order of hashes, as many as fit in so many bytes of UTF-8, the last one cut to fit."""
    out, left = [], share
    for t in sorted(texts, key=lambda t: (zlib.crc32(t.encode()), t)):
        out.append(t.encode()[:left].decode(errors="ignore") or t[0])
        left -= len(t.encode())
        if left <= 0:
            break
    return out


def learn(rows: DataFrame) -> Model:
    """The model of rows (doc_id, text, lang): all their languages, from a bounded sample."""
    rows = rows.filter("lang is not null and text != ''")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not sizes:
        return Model({})
    share = max(64, BYTES // len(sizes))
    # documents of a language: twice its share of bytes, but 32 at least, so that none is left out by chance
    wanted = [(r["lang"], int(r["n"]), min(SAMPLE, max(32, 2 * share * r["n"] // r["bytes"]))) for r in sizes]
    wants = F.broadcast(rows.sparkSession.createDataFrame(wanted, "lang string, n long, want long"))  # a row for each language
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit("langid"))).otherwise(F.xxhash64("doc_id", F.lit("langid")))
    text = F.min(F.substring("text", 1, share)).alias("text")  # no text gives more than a share
    chosen = rows.withColumn("drawn", drawn).join(wants, "lang").filter(F.pmod("drawn", "n") < F.col("want"))
    # rows that repeat an id are drawn once
    trees = chosen.groupBy("lang", "drawn").agg(text).groupBy("lang").applyInPandas(_planted(share), "lang string, tree binary")
    packed = {r["lang"]: bytes(r["tree"]) for r in trees.collect()}
    if missing := [lang for lang, _, _ in wanted if lang not in packed]:  # where one id stands for many rows
        few = rows.filter(F.col("lang").isin(missing)).groupBy("lang").agg(text).groupBy("lang").applyInPandas(_planted(share), "lang string, tree binary")
        packed |= {r["lang"]: bytes(r["tree"]) for r in few.collect()}
    return Model(packed)


def _planted(share: int):
    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "tree": [Tree.of(_shared(list(pdf["text"]), share)).packed()]})

    return plant


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score in place of text; its other columns are carried through untouched."""
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = held.value.predict(batch.column("text").to_pylist())
            others = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[c for _, c in others], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*[n for n, _ in others], "lang_pred", "score"])

    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(score, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a language: those that aren't `und`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _ = held.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def trainable(docs: DataFrame) -> DataFrame:
    return docs.filter(common.doc_remainder("doc_id", 5) != 0).select("doc_id", "text", "lang")


def query(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    rows = docs.select("doc_id", (common.doc_remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return identify(rows, learn(trainable(docs)))
