"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: All bytes but a-z, 0-9 and those above 127 become a space, once A-Z are lower-cased.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text whose A-Z are lower-cased.

    Bytes above 127 only occur inside non-ASCII characters, so this works on bytes.
    """
    return text.translate(WORD_BYTES).split()


#: About so many bytes are Python values at a time; a single larger row comes alone.
PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices, as many rows each as about PART_BYTES hold on average."""
    step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between its tasks: the last thing asked for, and nothing else. Workers
    live on through an application's stages, so one operator's tables must not stay for the next ones."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give the memory that Arrow and the C library have set aside back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_columns(
    df: DataFrame, columns: list[str], fn: Callable[..., list], schema: str, out: pa.Schema
) -> DataFrame:
    """Apply ``fn(*columns)`` to each Arrow batch; it returns the output columns.

    String columns arrive as lists of UTF-8 bytes, all others as Python values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                given = [
                    (c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in part.columns
                ]
                made = fn(*given)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(made, out, strict=True)], schema=out
                )
        release()

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, fn: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of df, with all their columns, for which fn says true; it gets the column's values (UTF-8
    bytes or None) in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                mask = fn(part.column(column).cast(pa.binary()).to_pylist())
                yield part.filter(pa.array(mask, pa.bool_()))
        release()

    return df.mapInArrow(run, df.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and Spark runs on
    this machine alone, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Spark's setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them again.

    The shuffle files of the write go with it, as nothing reads them any more. The tables of an application
    are in one folder named after it, which may be cleared when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the folders of tables made by `written`, which nothing may read any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("table-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
