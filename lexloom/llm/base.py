"""What the training-data operators share: table access, staged tables and grouping helpers."""

from __future__ import annotations

import ctypes
import math
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.sources.corpus import spread
from lexloom.sources.staging import shared_path, staged

#: Text bytes that one Python task should hold at a time.
CHUNK_BYTES = 8 << 20
#: Bytes of text that a vectorised step works on at a time.
SUB_CHARS = 1 << 20
BATCH_ROWS = 1000
#: Tasks that the rows of one hot key of a join are dealt over.
SLOTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back; it is deleted when the application ends."""
    return staged(df, name)


def stage_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """stage(), dealt by `key` into as many buckets as a shuffle has partitions: joins and groupings
    by `key` then read it in place. df should come from a shuffle by `key`, so each task writes its own buckets."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"lexloom_{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.option("path", shared_path(spark, name)).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, by one aggregate."""
    n, b = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return int(n), int(b or 0)


def pieces(total: int, each: int) -> int:
    """How many groups of about `each` a total makes; at least 1."""
    return max(1, math.ceil(total / each))


def join_spread(rows: DataFrame, per_key: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined to per_key, which has at most a row for each key.

    Rows of one key are dealt over SLOTS keys by the column `by`, so a hot key isn't one task's;
    per_key goes to the slots that its key has in rows. rows is read twice.
    """
    slot = free_name(rows, "slot")
    dealt = rows.withColumn(slot, F.pmod(F.xxhash64(by, F.lit("slot")), F.lit(SLOTS)).cast("int"))
    known = dealt.select(key, slot).distinct().join(per_key, key)
    return dealt.join(known, [key, slot]).drop(slot)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sub_batches(sizes, limit: int):
    """(start, stop) ranges of consecutive rows whose sizes add up to about `limit`."""
    start, held = 0, 0
    for i, s in enumerate(sizes):
        if i > start and held + s > limit:
            yield start, i
            start, held = i, 0
        held += s
    if start < len(sizes):
        yield start, len(sizes)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows: texts of many kB each would make large ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers stay for the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batch, column: int | str):
    """Parts of an Arrow batch with about SUB_CHARS bytes in a text or binary column, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for start, stop in sub_batches(sizes, SUB_CHARS):
        yield batch.slice(start, stop - start)


def per_text(docs: DataFrame, key: str, ddl: str, make, text: str = "text") -> DataFrame:
    """(key, columns of `ddl`): one row per row of docs.

    make() runs once a task and returns a function from a list of texts (None where null) to a
    list of columns. Arrow batches, so that null and large keys pass through unchanged.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType.fromDDL(ddl)
    types = [to_arrow_type(f.dataType) for f in schema]
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        work = make()
        for b in batches:
            for part in slices(b, "t"):
                columns = [pa.array(c, type=kind) for c, kind in zip(work(part.column("t").to_pylist()), types)]
                yield pa.RecordBatch.from_arrays([part.column("k"), *columns], names=["k", *schema.names])
        give_back()

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(run, f"k {key_type}, {ddl}").withColumnRenamed("k", key)
