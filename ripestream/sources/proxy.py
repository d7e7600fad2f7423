"""Map the driver's generic tables onto the sensor data model.

The reference ships no raw data, so the registered queries run on the
driver's tables through a fixed mapping (decided once, used everywhere):

* batch := ``events.user_id``; time := ``events.ts``; tie-break := ``event_id``
* spectral (optical) feed := ``event_type = 'view'`` with nir := ``value`` and
  clear := ``props.k``
* sensor feed := every other event type
* cycle-wide sensor table := per (user_id, day) the sum of ``value`` per type:
  click -> node1_tvoc, error -> node1_mq3_ppm, purchase -> node2_tvoc,
  signup -> node2_mq3_ppm; saturation threshold 150 (about p95 of ``value``)
* condition runs := ``lineitem`` grouped by ``l_returnflag``
* feature vectors := the first 10 dims of ``embeddings`` with class ``label % 3``

Every function is lazy and returns a projection, so Catalyst prunes the parquet
columns and pushes the ``event_type`` predicate into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the proxy mapping.
SPECTRAL_TYPE = "view"
CYCLE_TYPES = {
    "click": "node1_tvoc",
    "error": "node1_mq3_ppm",
    "purchase": "node2_tvoc",
    "signup": "node2_mq3_ppm",
}
PROXY_SATURATION = 150.0
N_FEATURES = 10
N_CLASSES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spectral_feed(events: DataFrame) -> DataFrame:
    """(batch, id, ts, nir double, clear int) — one optical reading per row."""
    return events.where(F.col("event_type") == SPECTRAL_TYPE).select(
        F.col("user_id").alias("batch"),
        F.col("event_id").alias("id"),
        "ts",
        F.col("value").alias("nir"),
        F.get_json_object("props", "$.k").cast("int").alias("clear"),
    )


def sensor_feed(events: DataFrame) -> DataFrame:
    """(batch, id, ts, event_type, value) — narrow sensor rows."""
    return events.where(F.col("event_type") != SPECTRAL_TYPE).select(
        F.col("user_id").alias("batch"),
        F.col("event_id").alias("id"),
        "ts",
        "event_type",
        "value",
    )


def cycle_wide(events: DataFrame) -> DataFrame:
    """One wide row per (batch, day): (batch, cycle_number, ts, 4 node columns).

    ``ts`` is the time of the last packet of the cycle; ``cycle_number`` is the
    day number since 1970-01-01.  A node column is NULL when the node sent
    nothing that day (the collector's ``N/A``).  One partial+final aggregate,
    no pivot value discovery.
    """
    aggs = [
        F.sum(F.when(F.col("event_type") == t, F.col("value"))).alias(c)
        for t, c in CYCLE_TYPES.items()
    ]
    return (
        events.where(F.col("event_type").isin(list(CYCLE_TYPES)))
        .groupBy(F.col("user_id").alias("batch"), F.unix_date(F.to_date("ts")).alias("cycle_number"))
        .agg(F.max("ts").alias("ts"), *aggs)
    )


def condition_runs(lineitem: DataFrame) -> DataFrame:
    """(run, ts, seq_id, value columns) — runs := l_returnflag."""
    return lineitem.select(
        F.col("l_returnflag").alias("run"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("f6_590nm"),
        F.col("l_extendedprice").alias("f7_630nm"),
        F.col("l_discount").alias("f8_680nm"),
        F.col("l_tax").alias("nir"),
    )


def feature_vectors(embeddings: DataFrame) -> DataFrame:
    """(id, f0..f9 double, label int in 0..2) from the first 10 embedding dims."""
    return embeddings.select(
        F.col("vec_id").alias("id"),
        *[F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(N_FEATURES)],
        (F.col("label") % N_CLASSES).alias("label"),
    )


# DuckDB text of the same mapping, used by the oracle SQL of every query.
SQL_SPECTRAL = """spectral AS (
  SELECT user_id AS batch, event_id AS id, ts, value AS nir,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS clear
  FROM events WHERE event_type = 'view')"""

SQL_SENSOR = """sensor AS (
  SELECT user_id AS batch, event_id AS id, ts, event_type, value
  FROM events WHERE event_type <> 'view')"""

SQL_CYCLE = """cycle AS (
  SELECT user_id AS batch,
         CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS cycle_number,
         max(ts) AS ts,
         sum(CASE WHEN event_type = 'click' THEN value END) AS node1_tvoc,
         sum(CASE WHEN event_type = 'error' THEN value END) AS node1_mq3_ppm,
         sum(CASE WHEN event_type = 'purchase' THEN value END) AS node2_tvoc,
         sum(CASE WHEN event_type = 'signup' THEN value END) AS node2_mq3_ppm
  FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup')
  GROUP BY 1, 2)"""

SQL_FEATURES = """fv AS (
  SELECT vec_id AS id,
         """ + ",\n         ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(N_FEATURES)) + """,
         label % 3 AS label
  FROM embeddings)"""
