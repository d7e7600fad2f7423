"""Device message feeds: optical-board lines and cycle documents.

Parsing uses ``from_json`` with an explicit superset schema (no inference) and
``try_parse_json`` to tell text that is not JSON at all; routing is a ``when``
chain.  The same functions serve batch reads (``spark.read.text``) and
streams (``spark.readStream.text``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the message protocol.
SENSOR_NAME = "AS7341"
REQUIRED_NODES = ["master", "node1", "node2"]
POLL_LINES = 5

BOARD_SCHEMA = T.StructType([
    T.StructField("sensor", T.StringType()),
    T.StructField("nir", T.DoubleType()),
    T.StructField("clear", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("msg", T.StringType()),
])

NODE_SCHEMA = T.StructType([
    T.StructField("temp", T.DoubleType()),
    T.StructField("hum", T.DoubleType()),
    T.StructField("tvoc", T.DoubleType()),
    T.StructField("eco2", T.DoubleType()),
    T.StructField("mq3_ppm", T.DoubleType()),
    T.StructField("received", T.BooleanType()),
])

CYCLE_DOC_SCHEMA = T.StructType([
    T.StructField("cycle", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("freshness_class", T.IntegerType()),
    T.StructField("freshness_label", T.StringType()),
    *[T.StructField(n, NODE_SCHEMA) for n in REQUIRED_NODES],
])


def is_json(line: Column) -> Column:
    return F.try_parse_json(line).isNotNull()


def route_board_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Classify optical-board lines.

    reading: ``sensor`` is the board's name and ``nir`` is present; error:
    ``status = 'error'``; any other JSON: status; not JSON: malformed (skipped
    by the collector).  Adds ``kind`` and the parsed fields.
    """
    p = F.from_json(F.col(line), BOARD_SCHEMA)
    out = lines.withColumn("_m", p).withColumn("_ok", is_json(F.col(line)))
    kind = (F.when(~F.col("_ok"), "malformed")
            .when((F.col("_m.sensor") == SENSOR_NAME) & F.col("_m.nir").isNotNull(), "reading")
            .when(F.col("_m.status") == "error", "error").otherwise("status"))
    return out.select("*", kind.alias("kind"),
                      F.when(F.col("_ok"), F.col("_m.nir")).alias("nir"), F.when(F.col("_ok"), F.col("_m.clear")).alias("clear"),
                      F.when(F.col("_ok"), F.col("_m.status")).alias("status")).drop("_m", "_ok")


def polled(routed: DataFrame, keys: tuple[str, ...] = ("batch", "poll"), order: tuple[str, ...] = ("ts", "id"), lines: int = POLL_LINES) -> DataFrame:
    """Adds ``consumed``: a poll reads its lines in order up to the first reading or error, ``lines`` of them at most.

    Only the first lines of a poll decide, and Spark keeps that many of a poll in
    each task before it shuffles them; the others are compared with where the
    poll ended.  Null keys are a poll of their own.
    """
    at = F.struct(*order)
    w = Window.partitionBy(*keys).orderBy(*order)
    first = routed.select(*keys, *order, "kind").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= lines)
    ends = first.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.least(F.min(F.when(F.col("kind").isin("reading", "error"), at)), F.max(at)).alias("_end"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return routed.join(ends, same).withColumn("consumed", at <= F.col("_end")).drop("_end", *[f"_{k}" for k in keys])


def parse_cycle_docs(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parse cycle documents (A5): adds ``doc`` and ``verdict`` in {accepted, malformed, unexpected_keys}.

    A document is accepted only when it carries all of master, node1, node2.
    """
    doc = F.from_json(F.col(line), CYCLE_DOC_SCHEMA)
    has_all = F.lit(True)
    for n in REQUIRED_NODES:
        has_all = has_all & F.col(f"doc.{n}").isNotNull()
    out = lines.withColumn("doc", doc)
    verdict = F.when(~is_json(F.col(line)), "malformed").when(~has_all, "unexpected_keys").otherwise("accepted")
    return out.withColumn("verdict", verdict)


def flatten_cycle(docs: DataFrame, nodes=("node1", "node2"), fields=("tvoc", "mq3_ppm")) -> DataFrame:
    """Wide row per accepted document; a node's values only when it was received."""
    cols = [F.col("doc.cycle").alias("cycle"), F.timestamp_millis(F.col("doc.timestamp")).cast("timestamp_ntz").alias("ts")]
    for n in nodes:
        for f in fields:
            cols.append(F.when(F.coalesce(F.col(f"doc.{n}.received"), F.lit(False)), F.col(f"doc.{n}.{f}")).alias(f"{n}_{f}"))
    return docs.where(F.col("verdict") == "accepted").select(*[c for c in docs.columns if c not in ("doc", "verdict", "line")],
                                                            *cols)


def accept_packets(packets: DataFrame, senders: DataFrame, sender: str, size_col: Column, size: int) -> tuple[DataFrame, DataFrame]:
    """Packet acceptance (B11): exact length and a known sender; returns (accepted, rejected)."""
    sized = packets.withColumn("_len_ok", F.coalesce(size_col == size, F.lit(False)))
    known = sized.join(senders, sender, "left_semi")
    accepted = known.where("_len_ok").drop("_len_ok")
    rejected = sized.join(senders, sender, "left_anti").unionByName(known.where(~F.col("_len_ok"))).drop("_len_ok")
    return accepted, rejected
