"""Quality rules with thresholds that follow the corpus.

``measure`` reads every whole text once and counts words, characters, symbols,
repeated lines and repeated five-word windows.  ``fences`` builds one mergeable
quantile sketch per metric, language and source: values fall into logarithmic
bins (relative error ``GAMMA``), the sketch is the bin counts, and merging is
adding.  Sketches of a source roll up to its language and to the corpus; a
group with fewer than ``MIN_ROWS`` documents takes the next level's fences.
``judge`` joins the fences and rejects what lies far outside them.

A fence lies ``REACH`` spreads from the group's median.  The spread is the median
absolute deviation, scaled to a standard deviation, of log(value + least), both
taken from the sketch, so anything below one half of a group can't move it far.
``least`` is what counts as nothing, and follows the group as well: a metric's
number of occurrences (``METRICS``) in a document of the group's usual length,
which is the median of a sketch of 1 / length.  A fence is at least ``REACH`` times
that away.  Where most of a group's values are zeros there is no spread, and the
usual length decides.

Cases: a null or empty text has no words, all counts are 0 and it fails the
base rules.  Null language or source is a group of its own.  Repeated rows are
judged alike.  An empty table gives an empty result.  ``judge`` keeps all input
columns; metric columns carry the prefix given by the caller, so columns of the
same names in the input don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripestream.llm import text as tx
from ripestream.llm.common import stage

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_caps")
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MARKS = np.isin(np.arange(256), list(b"!?;:=+~^@_/\\[]{}"))
CAPS = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
WINDOW = 5
#: Bin width of a sketch, small against the spreads it has to tell (about 1.04 for characters per word).
GAMMA = 1.005
MIN_ROWS = 100
REACH = 6.0
#: Standard deviations in a median absolute deviation.
MAD = 1.4826
#: metric: (numerator, denominator, occurrences that count as nothing, is a low value suspicious too)
METRICS = {
    "chars_per_word": ("word_chars", "n_words", 26.0, True),
    "symbols_per_word": ("n_symbols", "n_words", 4.0, False),
    "marks_per_word": ("n_marks", "n_words", 13.0, False),
    "caps_per_word": ("n_caps", "n_words", 5.0, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 0.7, False),
    "repeat_share": ("n_repeat_words", "n_words", 8.0, False),
}
#: Sketches of 1 / length, which tell how much one occurrence is in a usual document of a group.
LENGTHS = ("n_words", "n_lines")


def counts(page: tx.Page) -> dict[str, np.ndarray]:
    """The base counts of each text of a page opened with the ``INKED`` word bytes."""
    data, offs, n = page.data, page.offs, page.n
    out = {"n_words": page.counts.astype(np.int64), "word_chars": page.per_text(page.inside & tx.LEAD[data])}
    out |= {"n_symbols": page.per_text(SYMBOLS[data]), "n_marks": page.per_text(MARKS[data]), "n_caps": page.per_text(CAPS[data])}
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offs[1:]]))
    inked = np.concatenate([[0], np.cumsum(page.inside, dtype=np.int64)])
    full = inked[end] > inked[start]
    start, end = start[full], end[full]
    owner = np.searchsorted(offs, start, side="right") - 1
    _, kept = np.unique(tx.salted(page.hash_spans(start, end), owner), return_index=True)
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[kept], minlength=n)
    hashes, at = page.grams(WINDOW)
    keys = tx.salted(hashes, page.doc[at])
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        spot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        at = at[twice[spot] == keys]
        total = len(page.words)
        cover = np.cumsum(np.bincount(at, minlength=total + 1) - np.bincount(at + WINDOW, minlength=total + 1))[:total] > 0
        c = np.concatenate([[0], np.cumsum(cover, dtype=np.int64)])
        out["n_repeat_words"] = c[page.first[1:]] - c[page.first[:-1]]
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return out


def measure(docs: DataFrame, text: str = "text", prefix: str = "", drop_text: bool = False) -> DataFrame:
    """``docs`` with the base counts of each text as long columns ``prefix + name``."""
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text)]
    schema = T.StructType([*kept, *[T.StructField(prefix + b, T.LongType()) for b in BASE]])
    spot = docs.columns.index(text)
    wanted = [i for i, f in enumerate(docs.schema.fields) if f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tx.pieces(batch.column(spot)):
                got = counts(tx.Page(data, offs, tx.INKED))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in wanted], *[pa.array(got[b], pa.int64()) for b in BASE]], names=schema.names)

    return docs.mapInArrow(run, schema)


def ratio(metric: str, prefix: str = "") -> Column:
    top, bottom, _, _ = METRICS[metric]
    return F.when(F.col(prefix + bottom) > 0, F.col(prefix + top) / F.col(prefix + bottom)).otherwise(F.lit(0.0))


def base_failed(prefix: str = "") -> Column:
    return (F.col(f"{prefix}n_words") < 10) | (100 * F.col(f"{prefix}n_repeat_words") > 20 * F.col(f"{prefix}n_words"))


def sketch(measured: DataFrame, lang: str, source: str, prefix: str = "") -> DataFrame:
    """(lang, source, metric, bin, n): bin counts of documents that pass the base rules.

    Bin b holds values in (GAMMA**(b-1), GAMMA**b]; zero has the bin of its own
    that lies below all others.  Adding the counts of two sketches merges them.
    The names in ``LENGTHS`` are metrics here, too.
    """
    values = {m: ratio(m, prefix) for m in METRICS} | {d: 1 / F.greatest(F.col(prefix + d), F.lit(1)) for d in LENGTHS}
    logs = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(v <= 1e-9, F.lit(-(1 << 20))).otherwise(F.ceil(F.log(v) / float(np.log(GAMMA))).cast("int")).alias("bin")) for m, v in values.items()])
    return (measured.where(~base_failed(prefix)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(logs).alias("x"))
            .groupBy("lang", "source", "x.metric", "x.bin").agg(F.count(F.lit(1)).alias("n")))


def quantiles(sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """keys, rows and the named quantiles of each merged sketch; as many rows in a window as a sketch has bins."""
    merged = sketches.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    return weighted(merged.withColumn("value", bin_value()), keys, probs)


def bin_value() -> Column:
    return F.when(F.col("bin") <= -(1 << 20), F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bin")))


def weighted(values: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """keys, rows and the named quantiles of ``value``, each of which counts ``n`` times."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    ranked = values.select(*keys, "value", F.sum("n").over(w.orderBy("value")).alias("upto"), F.sum("n").over(w).alias("rows"))
    return ranked.groupBy(*keys).agg(F.max("rows").alias("rows"), *[
        F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * p), F.col("value"))).alias(q) for q, p in probs.items()])


def by_metric(spot: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for m, k in METRICS.items() for v in (m, k[spot])]), F.col("metric"))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``; null keys are equal."""
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(right.withColumnsRenamed({c: f"__{c}" for c in keys}), on).drop(*[f"__{c}" for c in keys])


def centres(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, median ``mid``, ``least`` and ``spread`` (scaled median absolute deviation of log(value + least)) of each merged sketch.

    ``keys`` end in ``metric``.
    """
    merged = sketches.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).withColumn("value", bin_value())
    group = keys[:-1]
    mids = weighted(merged, keys, {"mid": 0.5})
    units = mids.where(F.col("metric").isin(*LENGTHS)).select(*group, F.col("metric").alias("length"), F.col("mid").alias("unit"))
    mine = same(mids.where(~F.col("metric").isin(*LENGTHS)).withColumn("length", by_metric(1)), units, [*group, "length"])
    mids = mine.select(*keys, "rows", "mid", (by_metric(2) * F.col("unit")).alias("least"))
    far = same(merged, mids, keys).select(*keys, "n", "mid", "least", F.abs(F.log((F.col("value") + F.col("least")) / (F.col("mid") + F.col("least")))).alias("value"))
    return weighted(far, [*keys, "mid", "least"], {"mad": 0.5}).select(*keys, "rows", "mid", "least", (MAD * F.col("mad")).alias("spread"))


def fences(sketches: DataFrame) -> DataFrame:
    """One row for each (lang, source): low and high fence of every metric and the level they come from."""
    own, by_lang, overall = (centres(sketches, keys) for keys in (["lang", "source", "metric"], ["lang", "metric"], ["metric"]))
    named = lambda d, tag: d.select(*[c for c in ("lang", "source", "metric") if c in d.columns], *[F.col(c).alias(f"{c}_{tag}") for c in ("rows", "mid", "least", "spread")])
    all3 = same(same(named(own, "own"), named(by_lang, "lang"), ["lang", "metric"]), named(overall, "all"), ["metric"])
    pick = lambda q: F.when(F.col("rows_own") >= MIN_ROWS, F.col(f"{q}_own")).when(F.col("rows_lang") >= MIN_ROWS, F.col(f"{q}_lang")).otherwise(F.col(f"{q}_all"))
    least, mid, reach = pick("least"), pick("mid"), F.exp(REACH * pick("spread"))
    high = F.greatest((mid + least) * reach - least, mid + REACH * least)
    low = F.when(by_metric(3), F.least((mid + least) / reach - least, mid - REACH * least))
    bounds = all3.select("lang", "source", "metric", high.alias("hi"), low.alias("lo"),
                         F.when(F.col("rows_own") >= MIN_ROWS, "source").when(F.col("rows_lang") >= MIN_ROWS, "lang").otherwise("all").alias("level"))
    return bounds.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(b))).alias(f"{m}_{b}") for m in METRICS for b in ("lo", "hi")], F.max("level").alias("level"))


def judge(measured: DataFrame, fence_table: DataFrame, lang: str, source: str, prefix: str = "") -> DataFrame:
    """``measured`` with ``prefix``base_failed, ``prefix``broken (names of the crossed fences) and ``prefix``kept."""
    f = fence_table.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(f"{m}_{b}").alias(f"__{m}_{b}") for m in METRICS for b in ("lo", "hi")])
    joined = measured.join(f, measured[lang].eqNullSafe(f["__lang"]) & measured[source].eqNullSafe(f["__source"]), "left")
    broken = F.array_compact(F.array(*[F.when((ratio(m, prefix) > F.col(f"__{m}_hi")) | (ratio(m, prefix) < F.col(f"__{m}_lo")), F.lit(m)) for m in METRICS]))
    fails = base_failed(prefix)
    out = joined.withColumns({f"{prefix}base_failed": fails, f"{prefix}broken": broken})
    return out.withColumn(f"{prefix}kept", ~fails & (F.size(f"{prefix}broken") == 0)).drop(*[c for c in f.columns])


def rate(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", prefix: str = "", drop_text: bool = False) -> DataFrame:
    """Counts and verdict of every document; the thresholds come from all of ``docs``."""
    need = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    # written first, so that Spark knows its size: a small table is broadcast and the texts stay where they are
    sketches = stage(sketch(measure(need, drop_text=True), "lang", "source"), "sketches")  # read at three levels, so the texts are read once for it
    bounds = stage(fences(sketches), "fences")
    return judge(measure(docs, text, prefix, drop_text), bounds, lang, source, prefix)
