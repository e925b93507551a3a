"""What the operators of this subpackage share: shipping code, scratch tables, hashing of words."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

#: Arrow batches sent to Python stay under this, whatever the length of the texts.
ARROW_BATCH_BYTES = 16 << 20
#: Texts are handled together up to about this many bytes.
CHUNK_BYTES = 1 << 20

_lock = threading.Lock()


def prepare(spark: SparkSession) -> None:
    """Give the package to the executors once per application and bound the size of Arrow batches (a setting of the session, which stays)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    ship(spark)


#: What a Python worker remembers from task to task, by owner and name.
remembered: dict[tuple, object] = {}


def forget_others(owner: str) -> None:
    for key in [k for k in remembered if k[0] != owner]:
        del remembered[key]


def give_back() -> None:
    """Freed memory goes back to the system; the allocators would keep it for the worker's next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def light(run, owner: str = ""):
    """run (an iterator of batches to one) for a worker that holds little between tasks, and of what is remembered only the owner's."""

    def task(it):
        forget_others(owner)
        try:
            yield from run(it)
        finally:
            give_back()

    return task


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and all runs on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    with _lock:
        if not hasattr(scratch_root, "own"):
            scratch_root.own = "file://" + tempfile.mkdtemp(prefix="tidemark-scratch-")
    return scratch_root.own


#: On file: folders without checksum files: for each file, data or checksum, the executor's JVM starts a process (chmod).
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.options(**PLAIN_FILES).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            p.getFileSystem(conf).delete(p, True)
        gc.collect()  # shuffle files go when the driver's references to them do
        jvm.System.gc()


MASK64 = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        for key, r in (("up", _R), ("down", _RINV)):
            x = np.full(n, r, dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWERED, _SPACED = _LOWER.tobytes(), _SPACE.tobytes()


def words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, A-Z lower-cased."""
    return hashed_spans(np.frombuffer(buf.translate(_LOWERED), dtype=np.uint8), np.frombuffer(buf.translate(_SPACED), dtype=bool))


def hashed_spans(b: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(b):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=np.uint64)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    if not space[-1]:
        edge = np.concatenate((edge, [len(b)]))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(b))
    c = np.zeros(len(b) + 1, dtype=np.uint64)
    sums = c[1:]
    np.add(b, np.uint64(1), out=sums)
    sums *= up[: len(b)]
    np.cumsum(sums, out=sums)
    return starts, ends, mix((c[ends] - c[starts]) * down[starts])


def chunks(texts, limit: int = CHUNK_BYTES):
    """Lists of (position, UTF-8 bytes) of about `limit` bytes; a longer text stands alone."""
    out, size = [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if out and size + len(b) > limit:
            yield out
            out, size = [], 0
        out.append((i, b))
        size += len(b)
    if out:
        yield out
