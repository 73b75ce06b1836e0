"""What the corpus operators share: the scratch folder, row ids, and vectorised word hashing.

Words are hashed to 64 bits with numpy over a whole batch of texts at once, so that
no Python object is made per word.  Equal words have equal hashes everywhere: the
hash depends on nothing but the bytes.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal columns start so; a table's own columns may have any other name.
UID = "_q_uid"
#: Spark's setting to delete a query's shuffle files when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that one vectorised step handles.
CHUNK_BYTES = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of this machine if it is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("quarry.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quarry/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder.  Cuts lineage: a lost executor costs no recomputation of df, and its shuffle files go."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._q_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Frees a table made by written() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._q_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Names of files are sent to all tasks up to this size; beyond it they are joined.
BROADCAST_BYTES = 8_000_000
#: Rows of one file that a row number has room for: 2**ROW_BITS; the bits above number the files.
ROW_BITS = 40


def with_uid(df: DataFrame) -> DataFrame:
    """A number per row, also where ids repeat or are null.  The same at every evaluation, however the scan is split.

    Rows of a file scan are numbered by file and by place in the file; a scan that is to be
    numbered must not have lost its hidden columns to a select() before.  Other rows are
    written once, with their numbers.  The driver sees the names of the files.
    """
    try:
        paths = df.select(F.col("_metadata.file_path").alias("_q_file"))
        placed = df.select("*", F.col("_metadata.file_path").alias("_q_file"), F.col("_metadata.row_index").alias("_q_row"))
    except AnalysisException:
        return written(df.withColumn(UID, F.monotonically_increasing_id()), "rows")
    names = sorted(r[0] for r in paths.distinct().collect())
    if len(names) < 2:
        return placed.withColumn(UID, F.col("_q_row")).drop("_q_file", "_q_row")
    files = df.sparkSession.createDataFrame([(n, i << ROW_BITS) for i, n in enumerate(names)], f"_q_file string, {UID} bigint")
    if sum(map(len, names)) <= BROADCAST_BYTES:
        files = F.broadcast(files)
    return placed.join(files, "_q_file").withColumn(UID, F.col(UID) + F.col("_q_row")).drop("_q_file", "_q_row")


def remainder(column: str, m: int) -> Column:
    """crc32 of the id's text, mod m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


# --- a Python worker's memory --------------------------------------------

_held: dict[Hashable, Any] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Drops what the worker holds and gives free memory back to the system.  A worker serves one stage after another, and idle memory adds to the next one's."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """A model that a worker holds for its next tasks; it holds one at a time."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def released(batches: Iterator) -> Iterator:
    """batches, by a task that starts and ends with released memory."""
    release()
    try:
        yield from batches
    finally:
        release()


# --- words ---------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(7))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_pow = np.ones(1, np.uint64)

#: Words of [^\x20\x09-\x0D]+ by byte; bytes of other characters are never white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        size = max(n, 4096)
        _pow = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, _STEP, np.uint64))])
    return _pow


class Words:
    """The words of some texts: hash, start and length in the joined bytes, and where each text's words begin."""

    __slots__ = ("buffer", "hashes", "lens", "ptr", "starts")

    def __init__(self, parts: list[bytes], is_word: np.ndarray, lower: bool):
        joined = b" ".join(parts) + b" "
        self.buffer = np.frombuffer(joined, np.uint8)
        inside = is_word[self.buffer]
        turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            turn = np.concatenate([[0], turn])
        self.starts, ends = turn[0::2], turn[1::2]
        self.lens = ends - self.starts
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.ptr = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.hashes = self._hash(_VALUE_LOWER if lower else _VALUE)

    def _hash(self, value: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(self.starts), np.uint64), 1 << 18
        for a in range(0, len(out), step):
            s, n = self.starts[a : a + step], self.lens[a : a + step]
            offset = np.cumsum(n) - n
            at = np.arange(int(n.sum()))
            inside = at - np.repeat(offset, n)
            v = value[self.buffer[inside + np.repeat(s, n)]] * _powers(int(n.max()))[inside]
            out[a : a + step] = mix(np.add.reduceat(v, offset) + n.astype(np.uint64) * _STEP)
        out[out == 0] = 1
        return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    power, size, total, done, left = hashes, 1, None, 0, n  # power: sums over size words, total: over done words
    while left:
        if left & 1:
            if total is None:
                total, done = power, size
            else:  # size more words before those of total
                m = len(hashes) - size - done + 1
                total = power[:m] * np.uint64(pow(int(_STEP), done, 1 << 64)) + total[size : size + m]
                done += size
        left >>= 1
        if left:
            m = len(hashes) - 2 * size + 1
            power, size = power[:m] * np.uint64(pow(int(_STEP), size, 1 << 64)) + power[size : size + m], 2 * size
    return mix(total + np.uint64(n))


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Row ranges of a batch with about most bytes of text each: the first row, and the texts in UTF-8 (null: empty)."""
    texts = batch.column(column).cast(pa.large_binary())
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    first = 0
    while first < len(texts):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield first, [x or b"" for x in texts[first:last].to_pylist()]
        first = last


def by_key(batches, names: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by these columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in names]
        new = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            new |= np.asarray(pc.fill_null(pc.not_equal(k[1:], k[:-1]), True))
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            key = [k[a].as_py() for k in keys] if a == 0 or b == batch.num_rows else None
            if held and (a > 0 or key != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def bits_of(df: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """A bit for each hash in a column, at the hash mod 2**log2_bits, as bytes: at most 2**(log2_bits - 6) rows reach the driver."""
    bit = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    rows = (
        df.select(F.shiftright(bit, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(({column} & 63L) as int))").alias("bit"))
        .groupBy("slot")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(max(1, 1 << (log2_bits - 6)), np.int64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return out


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in what bits_of() gave."""
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
