"""Helpers shared by the corpus operators: checkpoints, text kernels, components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import checkpoint_dir, cut

_MASK = (1 << 64) - 1
_PRIME = 0x9E3779B97F4A7C15 | 1


# ------------------------------------------------------------------ checkpoints
def stored(df: DataFrame, label: str) -> DataFrame:
    """Like cut() for wider rows: a compressed Parquet table in the shared folder."""
    return kept(df, label)[0]


def kept(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """Like stored(), with the function that removes the table before the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before the interpreter does
            pass

    atexit.register(drop)
    return spark.read.parquet(path), drop


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, the shuffle files of a query are removed when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, rows: int = 1000, size: str = "8m") -> DataFrame:
    """The same rows, sent to Python in Arrow batches of at most so many rows and bytes (a longer text is a batch of its own): a session setting, only ever lowered."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, rows)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


# ------------------------------------------------------------------ hashing
def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z when lower is set."""
    values = splitmix(np.arange(1, 257, dtype=np.uint64))
    if lower:
        values[65:91] = values[97:123]
    return values


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = pow(_PRIME, -1, 1 << 64)
            for name, base in (("up", _PRIME), ("down", inverse)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """S with hash(data[i:j]) = (S[j] - S[i]) * down[i], all modulo 2**64."""
    up, _ = _POWERS.get(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _POWERS.get(len(s))
    return splitmix((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64))


# ------------------------------------------------------------------ Arrow text batches
def text_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets with n+1 entries, null mask) of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    nulls = np.asarray(column.is_null())
    wide = column.cast(pa.large_string())
    n, first = len(wide), wide.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), nulls
    _, off, data = wide.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, first * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], nulls


def pieces(offsets: np.ndarray, most: int):
    """Runs of rows (first, past) whose texts together have about `most` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text with n+1 entries) of the runs of bytes other than white space."""
    if len(data) == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    full = ~_SPACE[data]
    begin = full.copy()
    begin[1:] &= ~full[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = full[edges]
    last = full.copy()
    last[:-1] &= ~full[1:]
    last[edges - 1] = full[edges - 1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


# ------------------------------------------------------------------ connected components
def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """(id, component) for each node of undirected edges; component is the least id reachable.

    Alternates large-star and small-star rounds until nothing changes. Loops, repeated
    and null edges are ignored; without edges the result is empty. A round joins edges with
    one minimum for each node, so a hot hub only makes a skewed join, which adaptive
    execution splits. Every round is checkpointed. Edges that do not settle within `most_rounds` are an error.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut(small)
        state = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
