"""What the operators share: tables, stored intermediate results, and small Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster in `spark.checkpoint.dir`.

    Only a session on this one machine (local[...]) may go without a named folder and gets one of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tetrarank-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", "file://" + local)
    return "file://" + local


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of frames made by `stored` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for frame in frames:
        for name in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if v is None else v for v in column.to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices (no copies) of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(schema: pa.Schema, work: Callable[[pa.RecordBatch], dict]) -> Callable:
    """A mapInArrow function out of one that returns the columns of a batch."""

    def run(batches):
        for batch in small_batches(batches):
            columns = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

    return run


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Number of buckets: at least four per shuffle partition, and no more than `each` rows in one on average."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now rather than when the driver happens to collect its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
