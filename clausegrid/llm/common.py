"""Shared helpers: worker import path, tables in the cluster's shared folder, bounded Arrow slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands into tokens at a time. One longer text is one slice.
SLICE_BYTES = 2_000_000
#: Rows and bytes of an Arrow batch, which is held by the JVM and by the worker at once. One longer row is a batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and bound an Arrow batch."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    spark.conf.set(_BYTES, f"{BATCH_BYTES}b")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine, one of our own if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise RuntimeError("spark.checkpoint.dir names the folder that a cluster shares; it is unset")
        base = f"file://{tempfile.mkdtemp(prefix='clausegrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back; lost executors cost no recomputation of its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/clausegrid/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._clausegrid_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of `materialize` that nothing will read any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._clausegrid_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    """Null text as empty."""
    return F.coalesce(text, F.lit(""))


def bucket_of(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; the folds of the contracts. A null id falls into no fold (null)."""
    return F.crc32(key.cast("string").cast("binary")) % n


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most limit bytes of text (or one row)."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            n = n or 0
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
    release()


def release() -> None:
    """Give what a worker has freed back to the system: workers live on through stages, beside each other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text of a batch, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


#: Bits of a filter over keys: at most 4096 rows of 4 KB, 16 MB, whatever the input.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 27


def key_filter(keys: DataFrame, key: Column) -> tuple[DataFrame, int]:
    """(bit filter over the keys as a table: bucket, bits (4 KB a bucket); its number of bits)."""
    n = keys.count()
    size = LEAST_BITS
    while size < min(MOST_BITS, 64 * n):
        size *= 2
    bit = F.pmod(F.xxhash64(key), F.lit(size))
    bits = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    return materialize(bits, "key-filter"), size


def in_filter(rows: DataFrame, key: Column, filter_: tuple[DataFrame, int]) -> DataFrame:
    """rows with hit: true for every row whose key the filter holds, and for few others. Rows have no columns bucket, at, bits."""
    table_, size = filter_
    bit = F.pmod(F.xxhash64(key), F.lit(size))
    rows = rows.withColumn("bucket", F.bitmap_bucket_number(bit)).withColumn("at", F.bitmap_bit_position(bit))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftleft(1, cast(at % 8 as int))").bitwiseAND(byte) > 0
    return rows.join(F.broadcast(table_), "bucket", "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("bucket", "at", "bits")


def packed(docs: DataFrame, id_col: str, also: Column | None = None) -> DataFrame:
    """row (all columns of docs, whatever their names), id, also."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), (F.lit(b"") if also is None else also).alias("also"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Condition that rows have the same id (or none) and the same digest (column also)."""
    return left.id.eqNullSafe(right.id) & (left.also == right.also)


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str, also: Column | None = None) -> DataFrame:
    """docs without the rows whose id is in gone (columns id, and also if a digest is given), columns as they came.

    Only the rows that a filter over the ids lets through are joined, so texts that stay needn't be shuffled.
    """
    gone = gone.select("id", (F.lit(b"") if also is None else F.col("also")).alias("also"))
    marked = in_filter(packed(docs, id_col, also), F.col("id"), key_filter(gone, F.col("id")))
    maybe = marked.where("hit")
    return marked.where("not hit").unionByName(maybe.join(gone, same_row(maybe, gone), "left_anti")).select("row.*")


def one_of_repeated(docs: DataFrame, repeated: DataFrame, id_col: str, also: Column) -> DataFrame:
    """docs with one of the rows that repeat both id and digest, for those in repeated (id, also)."""
    if repeated.isEmpty():
        return docs
    twice = repeated.select("id", "also").distinct()
    rows = packed(docs, id_col, also)
    once = rows.join(twice, same_row(rows, twice), "left_semi").dropDuplicates(["id", "also"]).select("row.*")
    return drop_rows(docs, twice, id_col, also).unionByName(once)
