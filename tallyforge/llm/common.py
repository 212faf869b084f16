"""What the operators of this subpackage share: written intermediate tables, hot-key joins, streams of sorted groups."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []
#: What empties the caches that a Python worker keeps from task to task.
FORGET: list[Callable[[], None]] = []
#: Of tables of short rows whose number has a known bound.
ROWS_A_FILE = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, the context's checkpoint folder, or with a local
    master (tests) a temporary one. On a cluster one of the first two must be set: a machine's own folder is no use there."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL_DIR:
            _LOCAL_DIR.append(tempfile.mkdtemp(prefix="tallyforge-"))
        path = f"file://{_LOCAL_DIR[0]}"
    return path.rstrip("/")


class Scratch:
    """A folder for the intermediate tables of one operator run.

    Tables are written as Parquet in the shared folder, so that a lost executor costs no recomputation of what stands
    before them; ``drop`` deletes the ones no longer needed, and ``close`` the folder. What a lazy result still reads stays
    until the driver's JVM ends, which deletes the folder unless ``keep`` is set (it then holds files for the caller).
    """

    def __init__(self, spark: SparkSession, name: str, keep: bool = False):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        if not keep:
            files.deleteOnExit(path)

    def table(self, name: str, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``rows``: how many rows ``df`` has at most, if they are short ones. It then takes a file for each ``ROWS_A_FILE`` of them: where
        a file system has no native library, Hadoop starts processes for each file it creates."""
        path = f"{self.path}/{name}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        self.drop("")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_with_hot_keys(left: DataFrame, right: DataFrame, key: str, weight: str, spread: str, most: int = 1000) -> DataFrame:
    """Left outer join to ``right``, which holds each ``key`` once with the number of left rows (``weight``) it meets.

    The keys that hold over 1/``most`` of the rows counted in ``right`` are fewer than ``most`` by arithmetic: those are
    broadcast. Their left rows are then dealt by another key in the shuffled join of the rest, so that no task gets
    a hot key's rows; ``spread`` is a left column that tells them apart. ``right`` should be a written table, as it is read three times.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    value = [c for c in right.columns if c not in (key, weight)]
    hot = right.filter(F.col(weight) * most > F.lit(total)).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in value])
    cold = right.filter(F.col(weight) * most <= F.lit(total)).select(F.col(key).cast("string").alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in value])
    joined = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    dealt = F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), F.concat(F.lit("\u0001"), F.xxhash64(spread).cast("string"))).otherwise(F.col(key).cast("string"))
    joined = joined.withColumn("_k", dealt).join(cold, F.col("_k") == F.col("_ck"), "left")
    return joined.select(*left.columns, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in value])


def spread_prefix(df: DataFrame, group: str, order: list[str | Column], chunk: Column, value: str, out: str, scratch: Scratch) -> DataFrame:
    """Running sum of ``value`` before each row of its ``group``, rows ordered by (chunk, order); null groups are groups.

    A group may hold most rows, so no window spans it: sums of (group, chunk) are accumulated in a small table first, and
    the windows over rows are of one (group, chunk) each. ``chunk`` must be monotone in the order wanted and bound the
    rows of a chunk.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_chunk", chunk)
    sums = df.groupBy(group, "_chunk").agg(F.sum(value).alias("_sum"))
    at = W.partitionBy(group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_sum").over(at), F.lit(0)).alias("_base"))
    within = W.partitionBy(group, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    df = df.join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_chunk") == F.col("_c")))
    return df.withColumn(out, F.col("_base") + F.col("_within")).drop("_g", "_c", "_base", "_within", "_chunk")


def frugal(run: Callable, keep: bool = False, most_mb: int = 128) -> Callable:
    """``run``, a function for mapInArrow, of which a Python worker keeps no memory when its task is over.

    Workers live on between tasks and stages, and allocators keep what was freed: a worker with over ``most_mb`` resident gives that back. Caches
    of other operators are emptied first, unless ``keep`` is set."""

    def of(batches):
        if not keep:
            forget_caches()
        try:
            yield from run(batches)
        finally:
            give_back(most_mb)

    return of


def forget_caches() -> None:
    for forget in FORGET:  # of the worker's own module, so no part of what is sent to it
        forget()


def give_back(most_mb: int = 0) -> None:
    """Returns free memory of this process to the system, if over ``most_mb`` are resident (where the system tells)."""
    with contextlib.suppress(OSError, AttributeError):
        with open("/proc/self/statm") as f:
            resident = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
        if resident > most_mb << 20:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 3 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of at most ``most_bytes`` of text (or one row), with the text's bytes and their row offsets; null is empty."""
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = text.fill_null("")
    kind = np.dtype(np.int64 if pa.types.is_large_string(text.type) else np.int32)
    offsets = np.frombuffer(text.buffers()[1], kind, len(text) + 1, text.offset * kind.itemsize).astype(np.int64)
    data = text.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, to - at), buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double precision) of a list column's usable vectors, a pair for each length: neither null nor empty, no
    component null or non-finite."""
    if not len(column):
        return
    lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    at = np.cumsum(lens) - lens
    for dim in np.unique(lens[lens > 0]).tolist():
        rows = np.flatnonzero(lens == dim)
        place = at[rows][:, None] + np.arange(dim)
        m = x[place]
        good = known[place].all(axis=1) & np.isfinite(m).all(axis=1)
        yield rows[good], m[good]


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys`` from a stream sorted by them; a table may hold many groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = 0
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        if batch.num_rows > 1:
            changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
            if len(changes):
                cut = int(changes[-1]) + 1
        same = held and all(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() == c[0] for k, c in zip(keys, cols, strict=True))
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(*cols: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, and the length at the end."""
    n = len(cols[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])
