"""File sources and sinks of the collector / preparation pipeline.

Readers take an explicit schema (no inference), treat ``N/A``, empty and
``nan`` as NULL, turn NaN into NULL, and derive the batch from the folder name
(``..._batch<N>/``), so a single multi-path read covers every batch and
Catalyst prunes columns and partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = ["master", "node1", "node2"]
QUANTITIES = ["temp", "hum", "tvoc", "eco2", "mq3_ppm"]
BANDS = ["f1_415nm", "f2_445nm", "f3_480nm", "f4_515nm", "f5_555nm", "f6_590nm", "f7_630nm", "f8_680nm"]

SENSOR_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType()), T.StructField("cycle_number", T.IntegerType())]
    + [T.StructField(f"{n}_{q}", T.DoubleType()) for n in NODES for q in QUANTITIES])

SPECTRAL_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(b, T.IntegerType()) for b in [*BANDS, "clear", "nir", "gain", "atime", "astep"]])

#: In the name of the file's own folder; folders above it may hold other numbers.
BATCH_PATTERN = r"batch[_-]?(\d+)[^/]*/[^/]*$"


def _csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, nested: bool = False) -> DataFrame:
    """Collector CSVs with ``_folder``, the name of each file's own folder; with ``nested``, all that lie below the paths."""
    reader = (spark.read.schema(schema).option("header", True).option("nullValue", "N/A").option("nanValue", "NaN")
              .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"))
    if nested:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    # cut at slashes: a regular expression over the path would cost more than the rest of the row
    return df.withColumn("_folder", F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1))


def _nan_to_null(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_batches(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, nested: bool = False) -> DataFrame:
    """Read collector CSVs of many batches in one scan, tagging ``batch`` from the folder (A1, A2, H1, Q12).

    ``nested``: the paths are folders of batch folders, which Spark lists in tasks (the driver resolves a pattern alone).
    """
    df = _nan_to_null(_csv(spark, paths, schema, nested))
    batch = F.regexp_extract(F.concat("_folder", F.lit("/")), BATCH_PATTERN, 1)
    return df.withColumn("batch", F.when(batch != "", batch.cast("int"))).drop("_folder")


def missing_batches(spark: SparkSession, found: DataFrame, expected: Iterable[int] | DataFrame) -> DataFrame:
    """Expected batch ids that have no rows (A3), as a DataFrame (a left anti join)."""
    exp = expected if isinstance(expected, DataFrame) else spark.createDataFrame([(int(b),) for b in expected], "batch int")
    return exp.select(F.col("batch").cast("int").alias("batch")).distinct().join(
        found.select(F.col("batch").cast("int").alias("batch")).distinct(), "batch", "left_anti")


def require_batches(spark: SparkSession, found: DataFrame, expected: Iterable[int] | DataFrame) -> None:
    """Stop if a batch is missing; the message has their number and the smallest id."""
    n, first = missing_batches(spark, found, expected).agg(F.count(F.lit(1)), F.min("batch")).first()
    if n:
        raise FileNotFoundError(f"{n} batches are missing, the first is {first}")


def read_condition_runs(spark: SparkSession, base: str, runs: dict[int, tuple[str, str]]) -> DataFrame:
    """Condition-run CSVs (A4): ``runs`` maps a run number to its folder under ``base`` and its condition label.

    One scan of all folders; a row's run and condition come from its folder.
    """
    df = _nan_to_null(_csv(spark, [f"{base.rstrip('/')}/{folder}" for folder, _ in runs.values()], SPECTRAL_SCHEMA))
    place = F.create_map(*[v for n, (folder, label) in runs.items() for v in (F.lit(folder), F.struct(F.lit(n).alias("run"), F.lit(label).alias("condition")))])
    return df.withColumn("_mark", F.element_at(place, F.col("_folder"))).select(*[c for c in df.columns if c != "_folder"], "_mark.run", "_mark.condition")


def append_csv(df: DataFrame, path: str, columns: Sequence[str], partition_by: str | None = "batch") -> None:
    """Append rows with a fixed column order and a header, one folder per batch."""
    out = df.select(*columns, *([partition_by] if partition_by and partition_by not in columns else []))
    if partition_by:  # each folder's rows together: a file or few per folder, split only where a folder is large
        out = out.hint("rebalance", partition_by)
    w = out.write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.option("header", True).option("nullValue", "N/A").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def export_split(df: DataFrame, path: str, features: Sequence[str], fmt: str = "csv") -> None:
    """Export prepared rows: meta columns (if present) + ``*_norm`` + label text + code, by split."""
    meta = [c for c in ["timestamp", "ts", "batch", "cycle_number"] if c in df.columns]
    cols = [*meta, *[f"{c}_norm" for c in features], "nir_label", "label", "split"]
    w = df.select(*cols).write.mode("overwrite").partitionBy("split")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def keyed_map(rows: DataFrame, key: Column, fields: Column) -> DataFrame:
    """One row with ``map<string, struct>`` column ``m``: an entry a row of ``rows``, in order of the keys.

    For the documents of A11 and A12, whose maps have an entry a batch or class.
    """
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.cast("string").alias("key"), fields.alias("value"))))).alias("m"))


def write_stats_json(stats: DataFrame, path: str) -> None:
    """Dataset statistics / training report as JSON (A11, A12): one nested row, ``map`` columns kept."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def image_listing(spark: SparkSession, path: str, names: str = "*.jpg") -> DataFrame:
    """Image files under ``path``, in folders of any depth, with the capture time parsed from the name.

    Only paths are read: without its ``content`` column the source opens no file.
    """
    source = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true")
    return image_times(source.load(path).select("path"))


def image_times(listing: DataFrame) -> DataFrame:
    """Parse the capture time from a file name, either ``YYYYMMDD_HHMMSS`` or ``YYYY-MM-DD_HH-MM-SS``."""
    compact = F.regexp_extract("path", r"(\d{8}_\d{6})", 1)
    dashed = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})", 1)
    ts = F.coalesce(F.try_to_timestamp(F.nullif(compact, F.lit("")), F.lit("yyyyMMdd_HHmmss")),
                    F.try_to_timestamp(F.nullif(dashed, F.lit("")), F.lit("yyyy-MM-dd_HH-mm-ss")))
    return listing.withColumn("ts", ts.cast("timestamp_ntz"))


def table_kind(columns: Sequence[str]) -> str:
    """'spectral' if a header names 415 nm or f1..f8 bands with 'nm', else 'sensor' (A14)."""
    for c in columns:
        lc = c.lower()
        if "415" in lc or re.search(r"f[1-8].*nm", lc):
            return "spectral"
    return "sensor"


# Header aliases, tested in this order (eco2 before co2, tvoc before voc).
NODE_ALIASES = [("node1", r"node_?1|n1_"), ("node2", r"node_?2|n2_"), ("master", r"master|ref")]
QUANTITY_ALIASES = [("tvoc", r"tvoc"), ("tvoc", r"voc"), ("mq3_ppm", r"mq3|alcohol"), ("temp", r"temp"),
                    ("hum", r"hum"), ("eco2", r"eco2"), ("eco2", r"co2")]


def canonical_name(column: str) -> str | None:
    """Map a free-form header to ``<node>_<quantity>`` (A15); None when it does not match."""
    lc = column.lower()
    node = next((n for n, p in NODE_ALIASES if re.search(p, lc)), None)
    if node is None:
        return None
    rest = re.sub(NODE_ALIASES[[n for n, _ in NODE_ALIASES].index(node)][1], "", lc)
    qty = next((q for q, p in QUANTITY_ALIASES if re.search(p, rest)), None)
    return f"{node}_{qty}" if qty else None


def normalise_headers(df: DataFrame) -> DataFrame:
    """Rename recognised columns to the canonical names (one projection; unknown columns kept)."""
    return df.select(*[F.col(f"`{c}`").alias(canonical_name(c) or c) for c in df.columns])


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Tolerant column drop (B4): Spark's ``drop`` ignores missing names."""
    return df.drop(*cols)


def load_weights(spark: SparkSession, path: str) -> list[float]:
    """Flat float32 weights, one value per line, in the 227-value layout (A16): bounded, read to the driver."""
    from ripestream.functions.nn import N_WEIGHTS

    lines = spark.read.text(path).where(F.trim("value") != "").take(N_WEIGHTS + 1)  # one more shows a file that is too long
    vals = [float(r[0]) for r in lines]
    if len(vals) != N_WEIGHTS:
        raise ValueError(f"expected {N_WEIGHTS} weights, got {len(vals)}")
    return vals
