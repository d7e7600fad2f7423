"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is timed cold (materialised intermediates are dropped first) and
forced with the ``noop`` sink, so the whole plan runs but nothing is pulled
to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "freshness_labels", "label_counts", "nir_zones", "label_segments", "zone_global",
    "quality_matrix", "interval_stats", "reliability", "imputed", "normalised_split",
    "spearman", "pearson_matrix", "box_stats", "density_hist", "channel_summary",
    "mlp_score", "confusion", "nearest_image", "lead_lag", "gas_vs_optical",
    "message_router", "cycle_assembly", "adc_ppm", "timing_correction", "stream_label",
]


# Queries timed three times on two inputs, and the table whose rows the difference of the medians is divided by.
MARGINAL = {"spearman": "lineitem", "channel_summary": "lineitem", "box_stats": "lineitem"}
#: Samples that the scoring rate is measured on.
RATE_ROWS = 1 << 20


def scoring_rate(spark, sf_dir: str) -> dict:
    """Microseconds a sample of the network on ``RATE_ROWS`` written feature vectors, made by repeating the given ones; median of three."""
    import tempfile

    from pyspark.sql import functions as F

    from ripestream.functions import nn
    from ripestream.plans.models import WEIGHTS, X
    from ripestream.sources import proxy

    fv = proxy.feature_vectors(proxy.table(spark, sf_dir, "embeddings"))
    copies = -(-RATE_ROWS // fv.count())
    path = tempfile.mkdtemp(prefix="rs-rate-")
    fv.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")).repartition(16).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    took = []
    for _ in range(4):  # the first compiles
        t0 = time.perf_counter()
        z = nn.forward(rows, X, WEIGHTS)
        z.select("id", nn.argmax([F.col(f"z{k}") for k in range(nn.N_OUT)]).alias("pred")).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - t0)
    n = rows.count()
    return {"rows": n, "us_per_sample": round(sorted(took[1:])[1] / n * 1e6, 3)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from ripestream.plans import load_all
    from ripestream.plans.common import clear_staged
    from ripestream.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="ripestream-bench")
    reg = load_all()
    # Warm the JVM (class loading, JIT, codegen caches) outside the timings by
    # running the headline queries once on the tiny smoke tables: a long-lived
    # cluster JVM is warm, a fresh local one is not.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            try:
                reg[name].build(spark, warm_dir).write.format("noop").mode("overwrite").save()
            except Exception:  # noqa: BLE001 - warm-up only
                pass
    def timed(name: str, where: str) -> float | None:
        clear_staged()
        t0 = time.perf_counter()
        try:
            reg[name].build(spark, where).write.format("noop").mode("overwrite").save()
            return round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and keep timing the rest
            print(f"bench: {name} failed: {type(e).__name__}: {str(e)[:500]}", file=sys.stderr)
            return None

    times = {name: timed(name, sf_dir) for name in names}
    # Marginal cost: the same queries on a smaller input, per row of the table that grows.
    small_dir, marginal = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01"), {}
    if os.path.isdir(small_dir) and small_dir != sf_dir:
        size = {t: [spark.read.parquet(f"{d}/{t}.parquet").count() for d in (small_dir, sf_dir)] for t in ("events", "lineitem", "embeddings")}
        for name in MARGINAL:
            (small, large) = size[MARGINAL[name]]
            if times.get(name) and large > small:
                high, low = (sorted(timed(name, d) or 0.0 for _ in range(3))[1] for d in (sf_dir, small_dir))
                marginal[name] = round((high - low) / (large - small) * 1e6, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(v for v in times.values() if v), 3),
                      "unit": "sec", "failed": [k for k, v in times.items() if v is None],
                      "queries": times, "marginal_us_per_row": marginal, "mlp_rate": scoring_rate(spark, sf_dir), "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
