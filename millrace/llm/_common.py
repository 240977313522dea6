"""What the operators of this subpackage share: bounded Arrow batches and written scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship

#: Bytes of an Arrow batch sent to a Python worker; a row above it travels alone.
BATCH_BYTES = 8 << 20
#: The same for functions that gain nothing from large batches: the executor and its workers hold several copies of one.
SMALL_BATCH_BYTES = 1 << 20

_written: list[tuple[SparkSession, str]] = []
_own_base: list[str] = []


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Make ready for Python on the executors: this package there, and Arrow batches small in bytes, as rows differ in length by a factor of thousands."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def handing_back(compute: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """compute for mapInArrow, after which the worker gives free memory back: workers serve later tasks and stages, and else keep the most they ever held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compute(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def id_and_text_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """doc_id and text; a null text counts as empty."""
    return [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads."""
    return docs.select(*id_and_text_columns(id_col, text_col))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, end to end, and its n + 1 offsets."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of_rows(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most `most` bytes together, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def scratch_base(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); where it is unset, as in tests, one of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_base:
        _own_base.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
    return _own_base[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, *used_up: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more, and let the shuffle files of plans that are used up go now, not when the driver happens to collect its garbage."""
    for path in (df._scratch_path for df in used_up):
        _written.remove((spark, path))
        delete_path(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_mark() -> int:
    """The number of scratch tables so far, for forget_scratch."""
    return len(_written)


def forget_scratch(since: int = 0, keep: int = 0) -> None:
    """Delete the scratch tables written since a mark, but for the newest `keep`; results that read them must be used up by then."""
    while len(_written) > since + keep:
        spark, path = _written.pop(since)
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)


atexit.register(forget_scratch)


def unsigned_crc32(column: Column | str) -> Column:
    """Spark's crc32 is already an unsigned number in a long."""
    return F.crc32(column)
