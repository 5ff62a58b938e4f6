"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_id(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of rows that have an id. A row without doc_id can't be addressed by any
    result, so it is left out everywhere."""
    return docs.select(*(columns or docs.columns)).where(F.col("doc_id").isNotNull())


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores behind it as set it apart from the columns (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, the warehouse; only a local session may use a
    temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.startswith("local"):
        return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.conf.get("spark.sql.warehouse.dir") + "/shiftlens-work"


_LOCAL: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete written tables whose last reader has been written itself."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver find that shuffles behind a written table are no longer needed, so that executors delete their files.
    To be called where no variable holds the DataFrame that was written."""
    for _ in range(2):  # what the first round frees may hold the last reference to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def give_back() -> None:
    """Return freed memory to the system. A Python worker lives on from task to task, and what one task freed would count beside what the
    next stage needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


try:
    _LIBC = ctypes.CDLL(None)
except OSError:
    _LIBC = None


@contextmanager
def no_cycles():
    """For work that makes very many objects, none of them in a cycle: without collections that look at all of them again and again."""
    collects = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collects:
            gc.enable()


class Numbers(dict):
    """Numbers keys by first use, after those that it begins with."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


#: What a worker keeps from task to task; tasks of other work drop it.
KEPT: dict = {}


def chunks(batches, column: str, limit: int = 4 << 20, keep: bool = False):
    """Slices of record batches whose texts hold about `limit` bytes, one row at least. What the task before and this one have
    freed is given back to the system, and unless `keep`, what the worker kept for other tasks is freed too."""
    if not keep:
        KEPT.clear()
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more entry than rows). Null: empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def planes(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one block: all first bytes of a column, all second bytes, and so on, compressed."""
    return pa.compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def unplaned(block: bytes, n: int, kinds: list) -> list[np.ndarray]:
    """The columns of a block of n rows."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    data = np.frombuffer(pa.decompress(block, n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind)[:, 0])
        at += n * size
    return out


def texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Newton's method for a logistic regression of rows with a weight; the last of the result is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * w)
    return w
