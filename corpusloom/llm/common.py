"""What the operators share: the shared folder, staged tables, and numpy views of Arrow text."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy code takes at once; a longer text is taken alone, whole.
CHUNK = 1 << 20
_UNDO: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary one; on a cluster other machines would not see that, so it is an error.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: this operator needs a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(top)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


def _clear() -> None:
    for spark, path in _UNDO:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the shared folder has its own cleaning
            return


def forget_at_exit(spark: SparkSession, path: str) -> None:
    if not _UNDO:
        atexit.register(_clear)
    _UNDO.append((spark, path))


def staged(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage, and outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Stands for a null doc_id where a number is needed.
NO_ID = -(1 << 63)


def row_key(id_name: str, name_1: str, name_2: str, doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What names a row: its doc_id (NO_ID for null) and a 128-bit hash of its text; rows that share all three are alike."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias(id_name),
        F.xxhash64(F.col(text)).alias(name_1),
        F.xxhash64(F.lit(0x5DEECE66D), F.col(text)).alias(name_2),
    ]


def spread(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an explicit exchange: the session's own setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def runs(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to n."""
    global _POW, _IPOW
    while len(_POW) <= n:
        k = len(_POW)
        with np.errstate(over="ignore"):
            _POW = np.concatenate([_POW, _POW * np.uint64(pow(_BASE, k, 1 << 64))])
            _IPOW = np.concatenate([_IPOW, _IPOW * np.uint64(pow(_INV, k, 1 << 64))])
    return _POW, _IPOW


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Rolling:
    """64-bit hashes of any byte ranges of one buffer, from prefix sums of code[byte] * base**position modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.pow, self.inv = _powers(len(data))
        self.sum = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_CODE[data] * self.pow[: len(data)], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sum[end] - self.sum[start]) * self.inv[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and the number of words in each row; a row's end ends a word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, off))
