"""Files as tables: content by binary reader, JSON-lines logs, the driver's Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of every file under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def json_lines(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """A folder of JSON lines with a given schema, in batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)


#: Bytes of a file that `write_records` aims at.
FILE_BYTES = 64 << 20
#: Folder of a sink's log; readers of the sink pass over names that begin so.
LOG = "_log"


def _logged(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Every entry of a sink's log: run, number, done, the partition's values and digest."""
    schema = f"{columns}, n long, sum string, xor long, run string, number long, done boolean"
    try:
        return spark.read.schema(schema).json(f"{path}/{LOG}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_records(df: DataFrame, path: str, partitions: list[str], run: str, record: str = "record") -> int:
    """Write the JSON records of df as lines under path/partition=value/, and return how many partitions were
    written.

    The partitions that df has are replaced, others stay. The log tells what each one holds (rows, and sum
    and xor of their hashes), before and after it is written: one whose last entry is done with the same
    digest is left as it is, so a repeated run leaves the same files, and a run that died is done again.
    Null records are left out, null partition values have a folder of their own. One run writes at a time.
    A large partition is cut into files of about FILE_BYTES by a hash of its records, and small ones are gathered
    in one task, so that a task holds a few files' records whatever the size of the whole (Spark's rebalancing
    goes by compressed sizes, of which a task may hold twenty times as much).
    """
    spark = df.sparkSession
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*partitions).schema)
    own = cut(df.select(*partitions, record).where(F.col(record).isNotNull()))
    h = F.xxhash64(record)
    digests = own.groupBy(*partitions).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(h).alias("xor"), F.sum(F.octet_length(record) + 1).alias("_bytes"))
    log = _logged(spark, path, columns)
    last = log.groupBy(*partitions).agg(F.max_by(F.struct("n", "sum", "xor", "done"), F.struct("number", "done")).alias("_last"))
    last = last.select(*(F.col(p).alias(f"_of_{i}") for i, p in enumerate(partitions)), "_last")
    same = F.col("_last.done") & (F.col("_last.n") == F.col("n")) & (F.col("_last.sum") == F.col("sum")) & (F.col("_last.xor") == F.col("xor"))
    for i, p in enumerate(partitions):
        same &= F.col(p).eqNullSafe(F.col(f"_of_{i}"))
    new = cut(digests.join(last, same, "left_anti"))
    count, size = new.agg(F.count(F.lit(1)), F.sum("_bytes")).first()
    if not count:
        return 0
    number = (log.agg(F.max("number")).first()[0] or 0) + 1

    def note(done: bool) -> None:
        entries = new.drop("_bytes").withColumns({"run": F.lit(run), "number": F.lit(number), "done": F.lit(done)})
        entries.write.mode("append").option("ignoreNullFields", False).json(f"{path}/{LOG}")

    keys = new.select(*(F.col(p).alias(f"_of_{i}") for i, p in enumerate(partitions)), F.ceil(F.col("_bytes") / FILE_BYTES).alias("_files"))
    held = [F.col(p).eqNullSafe(F.col(f"_of_{i}")) for i, p in enumerate(partitions)]
    tasks, file = -(-size // FILE_BYTES), F.pmod(h, F.col("_files"))
    rows = own.join(keys, held).withColumn("_file", file).repartition(tasks, *partitions, "_file").select(*partitions, record)
    note(False)
    rows.write.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic").mode("overwrite").text(path)
    note(True)
    return count
