"""Reading input tables and staging intermediate ones in the session's shared folder."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.session import scratch_path, ship_package


#: Most bytes of one Arrow batch between Spark and a Python worker: texts are long, and a batch of many rows would fill the worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and read it back.

    The folder is shared, so the rows outlive the executors that made them and
    later plans start from a file scan.  ``group_rows`` bounds the rows of a row
    group, for rows of megabytes: a reader holds a whole group.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex[:12]}")
    (df.write.option("parquet.block.row.count.limit", str(group_rows)) if group_rows else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def addressed(df: DataFrame, name: str, file: str, at: str) -> DataFrame:
    """``df`` with the address of each row: hash of its file's path (``file``) and its number there (``at``).

    An address is the same each time the rows are read.  Rows that don't come
    straight from Parquet files are staged under ``name`` first.
    """
    place = lambda d: d.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    if df._jdf.queryExecution().analyzed().children().isEmpty():  # a bare relation: rows of a join or an explode would share an address
        try:
            return place(df)
        except AnalysisException:  # in memory, or files without row numbers
            pass
    return place(stage(df, name))


def lower_ascii(col) -> F.Column:
    """A-Z only; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those named; like Spark, it ignores case."""
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


def inner_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for columns that an operator adds for itself."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
