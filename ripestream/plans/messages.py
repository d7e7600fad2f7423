"""Message-feed queries: board line routing, cycle documents, cycle assembly.

Proxy feeds rendered from ``events``: each event becomes one optical-board
line (view -> reading, error -> error status, click -> ready status, signup ->
reading without nir, purchase -> boot text that is not JSON), and each
(batch, day) cycle becomes one JSON document (every 11th cycle lacks the
``node2`` key; every 5th cycle of every 13th batch is cut short).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.functions.clock import from_wall_micros, wall_micros
from ripestream.operators import sequence as seq
from ripestream.plans.common import bucket_width
from ripestream.plans.registry import register, with_ctes
from ripestream.sources import messages as msg
from ripestream.sources import proxy


def board_lines(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.col("event_type")
    line = (F.when(t == "view", F.to_json(F.struct(F.lit(msg.SENSOR_NAME).alias("sensor"), F.col("value").alias("nir"),
                                                   k.alias("clear"))))
            .when(t == "error", F.to_json(F.struct(F.lit("error").alias("status"), F.lit("sensor fault").alias("msg"))))
            .when(t == "click", F.to_json(F.struct(F.lit("ready").alias("status"))))
            .when(t == "signup", F.to_json(F.struct(F.lit(msg.SENSOR_NAME).alias("sensor"))))
            .otherwise(F.concat(F.lit("ets Jun  8 2016 rst:0x1 boot "), F.col("event_id").cast("string"))))
    return events.select(F.col("user_id").alias("batch"), F.col("event_id").alias("id"), "ts", line.alias("line"))


SQL_LINES = """lines AS (
  SELECT user_id AS batch, event_id AS id, ts,
         CASE event_type WHEN 'view' THEN json_object('sensor', 'AS7341', 'nir', value, 'clear', CAST(json_extract_string(props, '$.k') AS INTEGER))::VARCHAR
                         WHEN 'error' THEN json_object('status', 'error', 'msg', 'sensor fault')::VARCHAR
                         WHEN 'click' THEN json_object('status', 'ready')::VARCHAR
                         WHEN 'signup' THEN json_object('sensor', 'AS7341')::VARCHAR
                         ELSE 'ets Jun  8 2016 rst:0x1 boot ' || CAST(event_id AS VARCHAR) END AS line
  FROM events)"""


#: Board lines with their kind, and whether a poll of 53 minutes reads them: up to its first reading or error, five at most.
SQL_POLLS = (SQL_LINES, """v AS (SELECT batch, id, ts, json_valid(line) AS ok, CASE WHEN json_valid(line) THEN line END AS j FROM lines),
r AS (SELECT batch, id, ts, ok, json_extract_string(j, '$.sensor') AS sensor, CAST(json_extract(j, '$.nir') AS DOUBLE) AS nir,
             CAST(json_extract(j, '$.clear') AS INTEGER) AS clear, json_extract_string(j, '$.status') AS status FROM v),
kinds AS (SELECT *, CASE WHEN NOT ok THEN 'malformed' WHEN sensor = 'AS7341' AND nir IS NOT NULL THEN 'reading' WHEN status = 'error' THEN 'error' ELSE 'status' END AS kind,
             floor(epoch_us(ts) / 3180000000) AS poll FROM r),
polled AS (SELECT id, kind, CASE WHEN ok THEN nir END AS nir, CASE WHEN ok THEN clear END AS clear, CASE WHEN ok THEN status END AS status,
       count(*) FILTER (WHERE kind IN ('reading', 'error')) OVER (PARTITION BY batch, poll ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0
       AND row_number() OVER (PARTITION BY batch, poll ORDER BY ts, id) <= 5 AS consumed FROM kinds)""")


@register("message_router", "A6 J2", with_ctes(*SQL_POLLS) + "SELECT id, kind, nir, clear, status, consumed FROM polled")
def message_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route each board line; ``consumed`` marks the lines a 53-minute poll reads: up to its first reading or error, five at most."""
    lines = board_lines(proxy.table(spark, sf_dir, "events"))
    return msg.polled(msg.route_board_lines(lines).withColumn("poll", F.floor(wall_micros(F.col("ts")) / 3180000000))).select("id", "kind", "nir", "clear", "status", "consumed")


def cycle_docs(events: DataFrame) -> DataFrame:
    cyc = proxy.cycle_wide(events)
    node = lambda n: F.struct(F.col(f"{n}_tvoc").alias("tvoc"), F.col(f"{n}_mq3_ppm").alias("mq3_ppm"),
                              F.col(f"{n}_tvoc").isNotNull().alias("received"))
    full = F.to_json(F.struct(F.col("cycle_number").alias("cycle"), F.floor(wall_micros(F.col("ts")) / 1000).alias("timestamp"),
                              F.struct(F.lit(False).alias("received")).alias("master"), node("node1").alias("node1"),
                              node("node2").alias("node2")))
    no_n2 = F.to_json(F.struct(F.col("cycle_number").alias("cycle"), F.floor(wall_micros(F.col("ts")) / 1000).alias("timestamp"),
                               F.struct(F.lit(False).alias("received")).alias("master"), node("node1").alias("node1")))
    line = (F.when((F.col("batch") % 13 == 0) & (F.col("cycle_number") % 5 == 0), F.substring(full, 1, 20))
            .when(F.col("cycle_number") % 11 == 0, no_n2).otherwise(full))
    return cyc.select("batch", "cycle_number", line.alias("line"))


_SQL_NODE = "json_object('tvoc', {n}_tvoc, 'mq3_ppm', {n}_mq3_ppm, 'received', {n}_tvoc IS NOT NULL)"
SQL_DOCS = """docs AS (
  SELECT batch, cycle_number,
         CASE WHEN batch % 13 = 0 AND cycle_number % 5 = 0 THEN 'truncated {"cycle":'
              WHEN cycle_number % 11 = 0 THEN json_object('cycle', cycle_number, 'master', json_object('received', false), 'node1', """ \
    + _SQL_NODE.format(n="node1") + """)::VARCHAR
              ELSE json_object('cycle', cycle_number, 'master', json_object('received', false), 'node1', """ \
    + _SQL_NODE.format(n="node1") + ", 'node2', " + _SQL_NODE.format(n="node2") + """)::VARCHAR END AS line
  FROM cycle),
vd AS (SELECT *, json_valid(line) AS ok, CASE WHEN json_valid(line) THEN line END AS j FROM docs),
pd AS (SELECT *, COALESCE(json_exists(j, '$.master') AND json_exists(j, '$.node1') AND json_exists(j, '$.node2'), FALSE) AS has_all
       FROM vd)"""


@register("cycle_flatten", "A5 A8 J1",
          with_ctes(proxy.SQL_CYCLE, SQL_DOCS) + """
SELECT batch, CAST(json_extract(line, '$.cycle') AS BIGINT) AS cycle,
       CASE WHEN json_extract(line, '$.node1.received')::BOOLEAN THEN CAST(json_extract(line, '$.node1.tvoc') AS DOUBLE) END AS node1_tvoc,
       CASE WHEN json_extract(line, '$.node1.received')::BOOLEAN THEN CAST(json_extract(line, '$.node1.mq3_ppm') AS DOUBLE) END AS node1_mq3_ppm,
       CASE WHEN json_extract(line, '$.node2.received')::BOOLEAN THEN CAST(json_extract(line, '$.node2.tvoc') AS DOUBLE) END AS node2_tvoc,
       CASE WHEN json_extract(line, '$.node2.received')::BOOLEAN THEN CAST(json_extract(line, '$.node2.mq3_ppm') AS DOUBLE) END AS node2_mq3_ppm
FROM pd WHERE ok AND has_all""")
def cycle_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted cycle documents flattened to wide rows."""
    docs = msg.parse_cycle_docs(cycle_docs(proxy.table(spark, sf_dir, "events")))
    return msg.flatten_cycle(docs).select("batch", "cycle", "node1_tvoc", "node1_mq3_ppm", "node2_tvoc", "node2_mq3_ppm")


@register("rejects", "A5 B11",
          with_ctes(proxy.SQL_CYCLE, SQL_DOCS) + """
SELECT CASE WHEN NOT ok THEN 'malformed' WHEN NOT has_all THEN 'unexpected_keys' ELSE 'accepted' END AS verdict,
       count(*) AS n FROM pd GROUP BY 1""")
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of accepted, malformed and unexpected-key cycle documents."""
    docs = msg.parse_cycle_docs(cycle_docs(proxy.table(spark, sf_dir, "events")))
    return docs.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------ J3 (batch form)
SENDERS = {"click": "node1", "purchase": "node2"}
PACKET_LEN = 9  # props text length of a well-formed packet


def packets(spark: SparkSession, events: DataFrame) -> DataFrame:
    senders = spark.createDataFrame([(t, n) for t, n in SENDERS.items()], "event_type string, node string")
    acc, _ = msg.accept_packets(events, senders.select("event_type"), "event_type", F.length("props"), PACKET_LEN)
    node = F.when(F.col("event_type") == "click", "node1").otherwise("node2")
    start = from_wall_micros(F.floor(wall_micros("ts") / 900_000_000) * 900_000_000)
    return acc.select(F.col("user_id").alias("batch"), F.col("event_id").alias("id"), "ts", node.alias("node"),
                      "value", start.alias("cycle_start"))


def assemble(p: DataFrame, width=None) -> DataFrame:
    """One row per (device, cycle), as the stateful stream closes them (J3): a cycle ends when warm-up is
    over and both nodes are in, or at its deadline; the last packet of each node until then wins (F11);
    status both / expired; sync offset (E31); running number of the device's cycles (F10)."""
    from ripestream.streaming.feeds import RECEIVE_WINDOW_SECONDS, WARMUP_SECONDS

    us = wall_micros("ts")
    timed = p.withColumn("us", us).withColumn("warm", wall_micros("cycle_start") + WARMUP_SECONDS * 1_000_000)
    timed = timed.where(F.col("us") <= F.col("warm") + RECEIVE_WINDOW_SECONDS * 1_000_000)
    of = lambda n, c: F.when(F.col("node") == n, c)
    first = timed.groupBy("batch", "cycle_start").agg(F.min(of("node1", F.col("us"))).alias("f1"), F.min(of("node2", F.col("us"))).alias("f2"))
    j = timed.join(first, ["batch", "cycle_start"])
    both = F.when(F.col("f1").isNotNull() & F.col("f2").isNotNull(), F.greatest("f1", "f2"))
    counted = j.where(both.isNull() | F.when(both < F.col("warm"), F.col("us") < F.col("warm")).otherwise(F.col("us") <= both))
    o = F.struct("us", "id")
    g = counted.groupBy("batch", "cycle_start").agg(
        F.max_by("value", of("node1", o)).alias("node1_value"), F.max_by("value", of("node2", o)).alias("node2_value"),
        F.max(of("node1", F.col("us"))).alias("t1"), F.max(of("node2", F.col("us"))).alias("t2"), F.count_distinct("node").alias("n_nodes"))
    g = seq.with_position(g, "batch", ["cycle_start"], "cycle_no", width=width)
    return g.select("batch", "cycle_start", "cycle_no", "node1_value", "node2_value", F.col("n_nodes").cast("int").alias("n_nodes"),
                    F.when(F.col("n_nodes") == 2, "both").otherwise("expired").alias("status"), (F.abs(F.col("t1") - F.col("t2")) / 1e6).alias("sync_offset_s"))


SQL_CYCLES = """pk AS (
  SELECT user_id AS batch, event_id AS id, ts, CASE WHEN event_type = 'click' THEN 'node1' ELSE 'node2' END AS node, value,
         to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS cycle_start
  FROM events WHERE event_type IN ('click', 'purchase') AND length(props) = 9),
pk2 AS (SELECT *, cycle_start + INTERVAL 15 SECOND AS warm FROM pk WHERE ts <= cycle_start + INTERVAL 105 SECOND),
fb AS (SELECT batch, cycle_start, any_value(warm) AS warm,
              CASE WHEN count(*) FILTER (WHERE node = 'node1') > 0 AND count(*) FILTER (WHERE node = 'node2') > 0
                   THEN greatest(min(ts) FILTER (WHERE node = 'node1'), min(ts) FILTER (WHERE node = 'node2')) END AS t_both
       FROM pk2 GROUP BY ALL),
inc AS (SELECT pk2.* FROM pk2 JOIN fb USING (batch, cycle_start)
        WHERE fb.t_both IS NULL OR (fb.t_both < fb.warm AND pk2.ts < fb.warm) OR (fb.t_both >= fb.warm AND pk2.ts <= fb.t_both)),
asm0 AS (SELECT batch, cycle_start,
               arg_max(value, (ts, id)) FILTER (WHERE node = 'node1') AS node1_value,
               arg_max(value, (ts, id)) FILTER (WHERE node = 'node2') AS node2_value,
               max(ts) FILTER (WHERE node = 'node1') AS t1, max(ts) FILTER (WHERE node = 'node2') AS t2,
               CAST(count(DISTINCT node) AS INTEGER) AS n_nodes
        FROM inc GROUP BY ALL),
asm AS (SELECT batch, cycle_start, row_number() OVER (PARTITION BY batch ORDER BY cycle_start) AS cycle_no, node1_value, node2_value, n_nodes,
               CASE WHEN n_nodes = 2 THEN 'both' ELSE 'expired' END AS status, abs(epoch_us(t1) - epoch_us(t2)) / 1e6 AS sync_offset_s FROM asm0)"""


@register("cycle_assembly", "B11 F10 F11 J3", with_ctes(SQL_CYCLES) + "SELECT * FROM asm")
def cycle_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node packets (click -> node1, purchase -> node2; 9-byte packets only) assembled into 15-minute cycles."""
    p = packets(spark, proxy.table(spark, sf_dir, "events"))
    return assemble(p, bucket_width(spark, sf_dir))


@register("sync_offset", "E31",
          with_ctes(SQL_CYCLES) + """
SELECT batch, count(*) AS n_cycles, count(*) FILTER (WHERE status = 'both') AS n_complete,
       round(avg(sync_offset_s), 6) AS mean_offset_s, round(max(sync_offset_s), 6) AS max_offset_s FROM asm GROUP BY batch""")
def sync_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per device: cycles, complete cycles and node-arrival offsets."""
    c = assemble(packets(spark, proxy.table(spark, sf_dir, "events")), bucket_width(spark, sf_dir))
    return c.groupBy("batch").agg(F.count(F.lit(1)).alias("n_cycles"), F.count_if(F.col("status") == "both").alias("n_complete"),
                                  F.round(F.avg("sync_offset_s"), 6).alias("mean_offset_s"),
                                  F.round(F.max("sync_offset_s"), 6).alias("max_offset_s"))
