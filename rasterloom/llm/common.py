"""What the text operators share: scratch tables, table reading, ASCII folding."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z only.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def folded(text: str | Column) -> Column:
    """The text with A-Z in lower case; null is the empty text."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def doc_remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session may go without: it gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='rasterloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/rasterloom"


#: Tables written by this session and not yet removed.
_TABLES: list[str] = []


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, outlives executors. Removed by `cleared` or when the
    driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    if not _TABLES:
        atexit.register(_remove_all, spark)
    _TABLES.append(path)
    return spark.read.schema(schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is no longer referred to; it does so only when the JVM collects. The first
    collection frees what holds them, the second finds them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def mark() -> int:
    """For `settled`: the tables stored up to now stay."""
    return len(_TABLES)


def settled(make: Callable[[], DataFrame], name: str, since: int) -> DataFrame:
    """What make() gives, stored; all other tables stored since that mark are removed."""
    out = stored(make(), name)
    for path in _TABLES[since:-1]:
        _remove(out.sparkSession, path)
    del _TABLES[since:-1]
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        pass


def _remove_all(spark: SparkSession) -> None:
    for path in _TABLES:
        _remove(spark, path)


def tasks(shards: int) -> int:
    """Tasks for so many shards: one each, up to what a scheduler and a shuffle can bear."""
    return max(1, min(shards, 1 << 17))


#: Groups that the blocks of one task are dealt to, at most.
FAN = 256


def width_of(above: int) -> int:
    """Shards of a group, where a group of `above` shards is split into FAN at most."""
    return max(1, -(-above // FAN))


def dealt_on(blocks: DataFrame, name: str, shards: int, split: Callable[[list[bytes], int], Iterable[tuple[int, bytes]]], most: int) -> GroupedData:
    """Blocks (name, block) of groups of shards, dealt to smaller groups until each has its own shard, and grouped by shard. split: a list of blocks
    and a width to (group, block) pairs; most: bytes of blocks that are put together at once. Blocks of groups below 0 are passed on.

    A task gives FAN blocks at most for what it puts together, so the number of blocks follows the volume, not its square.
    """
    schema = pa.schema([(name, pa.int32()), ("block", pa.binary())])

    def step(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[bytes] = []
            now, size = None, 0

            def flushed() -> Iterator[pa.RecordBatch]:
                for group, block in split(held, width) if held else ():
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([block], pa.binary())], schema=schema)
                held.clear()

            for batch in batches:
                for group, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if group < 0:
                        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([block.as_py()], pa.binary())], schema=schema)
                        continue
                    if group != now or size >= most:
                        yield from flushed()
                        now, size = group, 0
                    held.append(block.as_py())
                    size += len(held[-1])
            yield from flushed()

        return run

    width = width_of(shards)
    while width > 1:
        groups = -(-shards // width)
        salted = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(max(1, width // FAN))))
        width = width_of(width)
        blocks = salted.repartition(tasks(groups * 4), name, "salt").sortWithinPartitions(name).select(name, "block").mapInArrow(step(width), f"{name} int, block binary")
    # each shard gets a task of its own; by a hash of their numbers several would meet in one
    n = tasks(shards)
    return blocks.withColumn("task", F.pmod(F.col(name), F.lit(n))).repartitionById(n, F.col("task")).groupBy("task", name)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones and so on, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Bounds the bytes handed to Python at once; long texts make the default number of rows too much for two workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
