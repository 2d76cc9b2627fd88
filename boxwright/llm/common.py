"""Shared pieces: the shared folder, staged tables, hot-key joins and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as Java and Python regular expressions both read it.
SPACE = r"[\x20\x09-\x0D]+"
#: Keys that hold at least one row in so many are hot; so there are at most that many of them.
HOT_SHARE = 2000


#: Bytes of an Arrow batch between the JVM and a Python worker, about; a larger row comes alone.
BATCH_BYTES = 4 << 20
#: Workers keep little freed memory, as several of them share an executor's memory.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}


def shipped(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers find this package where the driver has it (else: --py-files).

    It also bounds Arrow batches by BATCH_BYTES, unless the session has a smaller bound.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(bound)) > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a local one in tests."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="boxwright-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/boxwright-{uuid.uuid4().hex}/{name}"
    atexit.register(_delete, spark, path.rsplit("/", 1)[0])
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's own retention applies
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and executors may be lost."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """left, joined (how: left or inner) with table, which is unique by key and goes to the shared folder.

    count says how many rows of left, at least, have the key; left has total rows. Keys with at least
    total / HOT_SHARE rows go by broadcast: there are at most HOT_SHARE of them, as the counts add up to
    total. The others are joined by a shuffle in which no key can be large.
    """
    bound = max(2, -(-total // HOT_SHARE))
    values = [c for c in table.columns if c not in (key, count)]
    table = staged(table, "table")
    hot = [r[0] for r in table.filter(F.col(count) >= bound).select(key).collect()]
    cold = table.filter(F.col(count) < bound).select(key, *values)
    if not hot:
        return left.join(cold, key, how).select(*left.columns, *values)
    among = F.coalesce(F.col(key).isin(hot), F.lit(False))
    hit = left.filter(among).join(F.broadcast(table.filter(F.col(count) >= bound).select(key, *values)), key)
    rest = left.filter(~among).join(cold, key, how)
    return hit.select(*left.columns, *values).unionByName(rest.select(*left.columns, *values))


def least_hashes(df: DataFrame, keys: list[str], n: int, columns: list) -> list:
    """columns of the n rows with the least hash of keys (then least keys), on the driver.

    A bound on the hash, from the number of rows, leaves about 4 n rows in all, so that tasks do not send n
    rows each. Where it leaves too few (many rows share a hash), all rows are ranked.
    """
    ranked = df.withColumn("__hash", F.xxhash64(*keys))
    total = df.count()
    take = lambda rows: rows.orderBy("__hash", *keys).limit(n).select(*columns).collect()
    if total > 8 * n:
        found = take(ranked.filter(F.col("__hash") < -(2**63) + 2**64 * 4 * n // total))
        if len(found) == n:
            return found
    return take(ranked)


# ---------------------------------------------------------------- words of Arrow batches, in numpy

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: ASCII capitals to small letters, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            up[0] = 1
            down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
            down[0] = 1
            _POWERS.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def tidy(run: Callable, *forget: Callable[[], None]) -> Callable:
    """run (batches to batches); when a task is done, forget and give what it has freed back to the system.

    Python workers live on beside later stages, and share their executor's memory with them.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if _POWERS["n"] > 1 << 20:
                _POWERS.update(n=0, up=None, down=None)
            for f in forget:
                f()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each starts and ends; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - at[0]


def lowered(column: pa.Array) -> pa.Array:
    """The texts in ASCII lower case, nulls as empty texts. (Arrow's ascii_lower misreads slices of large strings.)"""
    raw, at = text_buffers(column)
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(LOWER[raw]))


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all texts, and the number of words before each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~_IS_SPACE[raw]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~word[:-1]
    inner = at[:-1][at[:-1] < n]
    first[inner] = True
    starts = np.flatnonzero(word & first)
    last = np.empty(n, bool)
    last[:-1] = first[1:] | ~word[1:]
    last[-1] = True
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the number of words before each text."""
    starts, ends, before = word_spans(raw, at)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts]), before


def shingles(words: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of width words within each text, and the number before each text.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    n = np.diff(before)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(before[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    out = np.zeros(len(at), np.uint64)
    stop = np.repeat(before[1:], count)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        out = mix64(out + np.where(at + k < stop, padded[at + k], np.uint64(0)) + np.uint64(0x632BE59BD9B4E019 * (k + 1) % 2**64))
    return out, bounds


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most so many rows and bytes of text; a longer text comes alone."""
    at = np.cumsum(np.concatenate([[0], np.asarray(pc.binary_length(batch.column(column).fill_null("")), np.int64)]))
    row = 0
    while row < batch.num_rows:
        end = min(row + rows, max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1))
        yield batch.slice(row, end - row)
        row = end


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterable[str]:
    return (x or "" for x in batch.column(column).to_pylist())
