"""What the operators share: tables, the shared folder, number of buckets."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe.scratch import scratch_path

#: A word, as a regular expression that Java, Python and RE2 read alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Remove a materialised table that nothing will read any more, before the driver's JVM ends."""
    spark, path = table.sparkSession, getattr(table, "_scratch_path", None)
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def buckets(spark: SparkSession) -> int:
    """Pieces into which a global order is cut; grows with the shuffle setting."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_key(c: str) -> Column:
    """A string for each value and another one for null, so that plain joins and windows take null as a value."""
    return F.concat(F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))


def spread_join(rows: DataFrame, by_key: DataFrame, key: str | list[str], how: str = "inner", salts: int = 32, by: list[str] | None = None, few: bool = False) -> DataFrame:
    """rows joined with a table of one row a key, whose rows are few beside them.

    A hot key's rows are dealt, by their other columns or those named, over as many
    places as there are salts, each with a copy of the key's row.  The planner may
    broadcast the copies only where they are said to be few (a row for each source):
    it sizes them by the file they come from, and would find a growing table small.
    """
    keys = [key] if isinstance(key, str) else list(key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in by or rows.columns if c not in keys]), F.lit(salts)))
    copies = by_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies if few else copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and at its end hand freed memory back: workers live on into stages that have no use for it."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


def slices(batches: Iterator[pa.RecordBatch], rows: int = 250, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some rows and bytes on average, so that few texts are Python objects at a time."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
