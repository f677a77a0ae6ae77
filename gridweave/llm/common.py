"""What the operators of this subpackage share: settled tables, words, batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words: 0x20 and 0x09-0x0D, exactly what bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) a folder of its own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gridweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/gridweave/{what}-{uuid.uuid4().hex}"


_TO_CLEAR: set[str] = set()


def _clear(spark: SparkSession, at: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone by now; nothing depends on it
        pass


def settle(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a table written in the shared folder: cuts the lineage, survives lost executors, and fixes values made from row order.

    Results read such tables lazily, so they stay as long as the application; its folder is deleted when the driver ends.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/gridweave/{spark.sparkContext.applicationId}"
    if own not in _TO_CLEAR:
        _TO_CLEAR.add(own)
        atexit.register(_clear, spark, own)
    at = f"{own}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(at)
    return spark.read.schema(schema).parquet(at)


def drop_settled(*tables: DataFrame) -> None:
    """Delete settled tables that no later plan reads."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        for f in t.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            if "/gridweave/" in path.toString():
                path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A row number that tells equal rows apart. Only fixed once the frame is settled."""
    return df.withColumn(name, F.monotonically_increasing_id())


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, if its files make fewer parts than there are cores (few row groups); larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an integer column's decimal text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def held_out(doc_id: int | None, mod: int) -> bool:
    """The same rule for one value in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod == 2


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a whole UTF-8 text after lower-casing A-Z alone; null has none."""
    return text.lower().split() if text else []


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def column_list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def chunks_by_size(texts: list, most: int) -> Iterator[slice]:
    """Slices of texts whose lengths sum to about `most`; a longer text stands alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts, in a column as they are or as ids, take some `most` bytes; a longer text stands alone."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def c_library() -> ctypes.CDLL | None:
    """glibc, which alone has mallopt and malloc_trim."""
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "mallopt") and hasattr(found, "malloc_trim") else None
    except OSError:
        return None


def give_back() -> None:
    """Hands back what Arrow and C keep of freed memory, which a worker would hold through all later tasks."""
    pa.default_memory_pool().release_unused()
    if c := c_library():
        c.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives back the memory that its task has freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))
