"""What the training-data operators share: scratch tables, bounded filters and table access."""

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of the filter that ``maybe_in`` broadcasts: 262,144 rows of two longs at most, however large the input.
FILTER_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only in local mode, where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif spark.sparkContext.master.startswith("local["):
            root = "file://" + tempfile.mkdtemp(prefix="glyphgrid-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/glyphgrid"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession):
    """Spark deletes the shuffle files of each query within as soon as the query is done."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write the rows to the shared folder, and read them back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no plan reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def chunks(batch: pa.RecordBatch, column: int, size: int) -> list:
    """The batch's rows in slices of about so many bytes of a text column; a longer text is alone or ends its slice."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    return [batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i]


def maybe_in(df: DataFrame, keys: list[Column], ids: DataFrame, id_keys: list[Column], inside: bool = True) -> DataFrame:
    """Rows of df whose keys may be among the ids: all that are, and few others while the ids are few.

    Not inside: the other rows, which surely aren't. The filter is a bitmap of ``FILTER_BITS`` bits, so what is
    broadcast is bounded. It spares shuffles only: joins with the ids still decide.
    """
    spot = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    marks = ids.select(spot(id_keys).alias("_spot")).groupBy(F.shiftright("_spot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_spot & 63 as int))")).alias("_bits"))
    seen = df.withColumn("_spot", spot(keys)).withColumn("_word", F.shiftright("_spot", 6)).join(F.broadcast(marks), "_word", "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_spot & 63 as int)) & 1L"), F.lit(0)) == (1 if inside else 0)
    return seen.filter(hit).select(*[F.col(f"`{c}`") for c in df.columns])
