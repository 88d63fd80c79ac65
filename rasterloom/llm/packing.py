"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class k holds pieces with lengths in (capacity/(k+1), capacity/k]; a bin of class k takes exactly k pieces, so a bin
never needs a search and each task fills its own bins without hearing of the others. Documents longer than the
capacity first give whole sequences (class 1). The rest of a document is one piece if k such pieces fill a bin but
for `slack` of it; otherwise the longest piece for which that holds is cut off, and the remainder is classed anew. Bins
still open at the end of a task (fewer than k pieces for each class) are emptied into common sequences, cut where a
sequence is full; what remains ends in sequences whose fills are powers of two, so they need no padding.

Each task streams its documents; it holds open bins only, which are bounded by the classes. There is no shuffle.
Sequence ids join the number of the task's partition and a counter, so they are unique and the same on a retry.

Defined cases: null text counts as empty and packs as the single id 0; a null doc_id is kept as null; repeated rows
are packed as often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
CAPACITY = 1024
SLACK = 0.01
END = 0
#: Texts of these characters get the same ids from the faster library; all others go to the reference tokenizer.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")


class Encoder:
    """Ids of a byte-level BPE vocabulary. path: the tokenizers file; a .tiktoken file beside it is used for plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def lengths(capacity: int, slack: float) -> list[int]:
    """For each rest up to capacity the longest piece that fills bins of its class but for slack."""
    out = [0]
    for c in range(1, capacity + 1):
        out.append(c if capacity // c * c >= capacity * (1 - slack) else out[-1])
    return out


def cut(length: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document, in order."""
    pieces = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        c = lengths(capacity, slack)[rest]
        pieces.append((capacity // c, c))
        rest -= c
    return pieces


class Packer:
    """Fills bins; rows that are settled gather in `done`."""

    def __init__(self, capacity: int, slack: float, first: int):
        self.capacity, self.slack, self.next = capacity, slack, first
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        for k, length in cut(len(ids), self.capacity, self.slack):
            pieces = self.open.setdefault(k, [])
            pieces.append((doc_id, start, len(ids), ids[start : start + length]))
            start += length
            if len(pieces) == k:
                self._close(pieces)
                self.open[k] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, total, ids in pieces:
            self.done.append((doc_id, start, len(ids), total, self.next, at, ids.tobytes()))
            at += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Empties the open bins into common sequences."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[3]) for p in pieces)
        row: list[tuple] = []
        room = size = 0
        for doc_id, start, total, ids in pieces:
            while len(ids):
                if not room:
                    room = size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                part = ids[:room]
                row.append((doc_id, start, total, part))
                start, ids, room, left = start + len(part), ids[len(part) :], room - len(part), left - len(part)
                if not room:
                    self._close(row)
                    row = []
        assert not row and not left, size


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, slack: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def settled() -> pa.RecordBatch:
        rows, packer.done = packer.done, []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)

    encode = Encoder(path)
    packer = Packer(capacity, slack, TaskContext.get().partitionId() << 40)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            packer.add(doc_id, np.append(encode(text.as_py() or ""), np.uint32(END)))
            if len(packer.done) >= 4096:
                yield settled()
    packer.finish()
    yield settled()


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit)."""
    path = path or default_path()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _pack(it, path, capacity, slack), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir):
    return digest(pack(common.documents(spark, sf_dir)))
