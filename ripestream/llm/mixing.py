"""Source mixing by entropy balancing (DataFrame functions only).

Every document i of a source gets a rate between 0 and ``LIMIT`` copies.  Among
all rates whose expected words meet the source's target, the rates of least
relative entropy to one copy each are exponentially tilted by size:

    rate / (LIMIT - rate) = exp(tilt * size / mean size) / (LIMIT - 1)

The dual is convex with one tilt for each source.  Newton steps, kept inside a
bracket, solve it: each iteration is one grouped sum of words and slopes over
the distinct (source, size) pairs, a table that doesn't grow with the number of
documents of a size.  Sums are decimal, so reruns give the same tilts.

Rates are rounded into copies along descending sizes (the error of a source is
then at most one longest document), and a few further copies are added or taken
away where that brings the source nearer its target.  Within a (source, size)
pair the documents of lowest hash get the copy more; ranks are counted in
``BUCKETS`` hash buckets, so no task holds a whole pair.

Cases: a null text has size 0.  A null source is a source of its own, ordered
last.  Documents of size 0 keep one copy (no words).  Sources without words have target 0.
Null and repeated ids are mixed row by row; rows equal in every column share
their hash and are interchangeable.  An empty table gives an empty result.  All
input columns are kept and ``size``, ``source_size``, ``target``, ``copies``
and ``taken`` added, with the given prefix; columns of the same names are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripestream.llm.common import others, stage

WEIGHTS = (5, 2, 1)
LIMIT = 3
BUCKETS = 4096
#: Newton stops when every source is this near its target, relatively.
TOLERANCE = 1e-9
STEPS = 60
#: Single copies added or taken away in each source after rounding.
REPAIRS = 4


def words(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(key, source, source_size, docs, target): all words shared out by weight, at most ``limit`` times a source's size.

    ``sizes`` has a row for each source; the water level rises until no share is above its cap.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    plan = stage(sizes.withColumn("weight", weight.cast("decimal(38,0)")), "sources")
    size = F.col("source_size").cast("decimal(38,0)")
    total = int(plan.agg(F.sum(size)).first()[0] or 0)
    a, b, capped = total, None, F.lit(False)
    while True:
        left, share = plan.agg(F.sum(F.when(capped, size * limit)), F.sum(F.when(~capped, F.col("weight")))).first()
        now = (total - int(left or 0), int(share or 1))
        if now == (a, b):
            break
        a, b = now
        capped = F.col("weight") * F.lit(a).cast("decimal(38,0)") > size * F.lit(limit * b).cast("decimal(38,0)")
    return plan.select("key", "source", "source_size", "docs", F.when(capped, F.col("source_size") * float(limit)).otherwise(F.col("weight").cast("double") * a / b).alias("target"))


def tilted(limit: int = LIMIT) -> Column:
    z = F.col("size") / F.col("mean")
    # far out the exponent is held: the rate is 0 or the limit there to double precision
    return F.lit(float(limit)) / (1.0 + (limit - 1.0) * F.exp(F.greatest(F.lit(-600.0), F.least(F.lit(600.0), -F.col("tilt") * z))))


def balance(pairs: DataFrame, plan: DataFrame, limit: int = LIMIT, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, tilt, mean, full, none): the dual solution of every source; full and none mark targets at the cap and at 0."""
    state = stage(plan.select("key", F.col("target"), (F.col("source_size") / F.col("docs")).alias("mean"), (F.col("target") >= F.col("source_size") * float(limit)).alias("full"),
                              (F.col("target") <= 0).alias("none"), F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")), "tilts")
    open_pairs = pairs.where("size > 0")
    for _ in range(STEPS):
        r = tilted(limit)
        term = F.col("n") * F.col("size")
        sums = open_pairs.join(state.where("not full and not none"), "key").groupBy("key").agg(
            F.sum((term * r).cast("decimal(32,6)")).cast("double").alias("got"),
            F.sum((term * (F.col("size") / F.col("mean")) * r * (limit - r) / limit).cast("decimal(32,6)")).cast("double").alias("slope"))
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(off > 0, F.col("tilt")).otherwise(F.col("hi"))
        moved = state.join(sums, "key", "left").withColumns({"off": off, "lo": lo, "hi": hi}).withColumn(
            "next", F.col("tilt") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("off") / F.greatest("slope", F.lit(1e-9)))))
        safe = F.when((F.col("next") > F.col("lo")) & (F.col("next") < F.col("hi")), F.col("next")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = stage(moved.select("key", "target", "mean", "full", "none", F.when(F.col("off").isNull() | (F.col("off") == 0), F.col("tilt")).otherwise(safe).alias("tilt"), "lo", "hi",
                                   (F.abs("off") / F.greatest("target", F.lit(1.0))).alias("miss")), "tilts")
        miss = state.agg(F.max("miss")).first()[0]
        state = state.drop("miss")
        if miss is None or miss <= tolerance:
            break
    return state


def rounded(pairs: DataFrame, solution: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, size, n, copies): whole copies for each (source, size) pair, near the source's target."""
    rate = F.when(F.col("none"), F.lit(0.0)).when(F.col("full"), F.lit(float(limit))).otherwise(tilted(limit))
    rated = pairs.join(solution, "key").withColumn("expected", F.when(F.col("size") == 0, F.col("n").cast("double")).otherwise(F.col("n") * rate))
    upto = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)  # at most a row for each length a text has
    run = rated.where("size > 0").withColumn("upto", F.sum("expected").over(upto))
    copies = F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("expected") + 0.5)
    most = F.col("n") * limit
    out = stage(run.select("key", "size", "n", "target", F.greatest(F.lit(0).cast("long"), F.least(most, copies)).alias("copies")), "copies")
    for _ in range(REPAIRS):
        short = out.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
        step = F.signum("short")
        fits = ((F.col("short") > 0) & (F.col("copies") < most)) | ((F.col("short") < 0) & (F.col("copies") > 0))
        after = F.abs(F.abs("short") - F.col("size"))
        pick = out.join(short, "key").where(fits & (after < F.abs("short"))).groupBy("key").agg(F.min_by("size", F.struct(after, "size")).alias("size"), F.first(step.cast("long")).alias("step"))
        out = stage(out.join(pick, ["key", "size"], "left").select("key", "size", "n", "target", (F.col("copies") + F.coalesce("step", F.lit(0).cast("long"))).alias("copies")), "copies")
    return out.select("key", "size", "n", "copies").unionByName(rated.where("size = 0").select("key", "size", "n", F.col("n").alias("copies")))


def mix(docs: DataFrame, text: str = "text", source: str = "source", prefix: str = "", drop_text: bool = False, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``docs`` with size, source_size, target (the source's), copies and taken (copies * size)."""
    added = [prefix + c for c in ("size", "source_size", "target", "copies", "taken")]
    kept = [c for c in others(docs, *added) if not (drop_text and c == text)]
    keyed = docs.withColumns({
        "__key": F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source))),
        "__size": words(text), "__hash": F.xxhash64(*[docs[c] for c in docs.columns])}).withColumn("__bucket", F.pmod("__hash", F.lit(BUCKETS)))
    cells = stage(keyed.groupBy(F.col("__key").alias("key"), F.col(source).alias("source"), F.col("__size").alias("size"), F.col("__bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "cells")
    pairs = stage(cells.groupBy("key", "size").agg(F.sum("n").alias("n")), "pairs")
    sizes = cells.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    plan = stage(targets(sizes, weights, limit), "plan")
    result = rounded(pairs, balance(pairs, plan, limit), limit).join(plan.select("key", "source_size", "target"), "key")
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spots = cells.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("key", "size", "bucket", "offset").join(
        result, ["key", "size"]).select(*[F.col(c).alias(f"__{c}") for c in ("key", "size", "bucket", "offset", "n", "copies", "source_size", "target")])
    inner = Window.partitionBy("__key", "__size", "__bucket").orderBy("__hash")
    rows = (keyed.drop(text) if drop_text else keyed).withColumn("__nth", F.row_number().over(inner)).join(spots, ["__key", "__size", "__bucket"])
    extra = F.when(F.col("__offset") + F.col("__nth") <= F.col("__copies") % F.col("__n"), 1).otherwise(0)
    copies = (F.expr("__copies div __n") + extra).cast("long")
    return rows.select(*kept, F.col("__size").alias(added[0]), F.col("__source_size").alias(added[1]), F.col("__target").alias(added[2]), copies.alias(added[3]), (copies * F.col("__size")).alias(added[4]))
