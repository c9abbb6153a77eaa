"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of every contract: runs of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a function of a batch is given at once. Spark bounds the bytes of an Arrow batch (64 MB or one row, by
#: default); this bounds the Python objects made of it.
BATCH_ROWS = 256
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is named, a local master (tests) gets a temporary one; on a cluster that is an error, since each machine
    would have a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the application's folder. What is written there belongs to the application; see clean_up()."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes all that this application's operators have stored, archives of lost attempts included.

    Call it when every result has been written: results of operators are read from there.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most rows rows while a table is written; the session's own setting comes back afterwards."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def stored(df: DataFrame, name: str, codec: str = "snappy", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    with _batches_of(df.sparkSession, batch_rows):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, codec: str = "snappy") -> DataFrame:
    """As stored(), in as many buckets by key as a shuffle has partitions: joins by key then leave these rows in place."""
    spark = df.sparkSession
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    with _batches_of(spark, BATCH_ROWS):
        df.repartition(buckets, key).write.option("compression", codec).option("path", new_path(spark, name)).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of the catalogue only: the files have a path of their own
    return out


def trim() -> None:
    """Gives memory that is free within this Python worker back to the machine: workers outlive the stages that filled them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]], rows: int = BATCH_ROWS, after: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow with a function built once a task; it turns up to rows rows into columns (lists or Arrow arrays) of schema.

    after is called when a task's last batch is out, to drop what the worker need not keep.
    """
    target = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = work(batch.slice(start, rows))
                yield pa.RecordBatch.from_arrays([c if isinstance(c := out[f.name], pa.Array) else pa.array(c, f.type) for f in target], schema=target)
        if after:
            after()

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def text_sha256() -> Column:
    """Of the text with A-Z lowered; null counts as empty."""
    return F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of docs for each (doc_id, text_sha256) of kept; which one, if rows agree in both, is not said.

    kept has a row for each row of docs that it stands for. Only texts of rows that repeat are moved to choose one.
    """
    counted = stored(kept.groupBy("doc_id", "text_sha256").count(), "kept")
    same = lambda n: docs.join(k := counted.where(n).select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_sha")), docs["doc_id"].cast("long").eqNullSafe(k["_kept"]) & (text_sha256() == k["_sha"]), "left_semi")
    once, again = same("count = 1"), counted.where("count > 1")
    if again.isEmpty():
        return once
    repeated = same("count > 1").withColumn("_sha", text_sha256()).dropDuplicates(["doc_id", "_sha"]).drop("_sha")
    return once.union(repeated)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 of a string column; null is empty. bytes.split() and bytes.lower() then follow WORD and A-Z exactly."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


#: A table of fewer rows than this may be broadcast (a few dozen bytes a row); a larger one is joined by shuffle with salt.
BROADCAST_ROWS = 100_000
SALTS = 32


def join_keyed(big: DataFrame, small: DataFrame, key: str, salt_by: Column, how: str = "inner") -> DataFrame:
    """big with the columns of small (one row a key, both sides without null keys), also where one key has much of big.

    small is counted: up to BROADCAST_ROWS it is broadcast, beyond that every key of it is copied to SALTS salts.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
