"""Language of pages and documents by Bayesian evidence fusion.

Four kinds of evidence are added as log-probabilities of each language:

* the text: a naive Bayes model of hashed byte trigrams, counted over all
  labelled documents (``train``);
* the declared markup language (``<html lang>``, else a content-language meta
  tag): how often each declared value goes with each language, counted over the
  rows themselves by their text posterior;
* the address suffix (last label of the host): likewise;
* the host: a prior smoothed along host, parent domain and corpus.  Each level
  is a grouped sum of text posteriors, shrunk to the level above by ``SHRINK``
  pseudo-rows.

A row's own share is taken out of every sum that it is judged by: of its host,
parent domain, declared value, suffix and the corpus.

Rows without markup, address or host simply lack that evidence, so plain
documents (with their source as host) and pages go through the same operator.

Cases: a null or empty text says nothing, and the prior decides.  Rows are
judged one by one, also with repeated or null ids.  Null and unseen declared
values or suffixes are values of their own.  Without labelled documents the
language is null.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripestream.llm import text as tx
from ripestream.llm.common import others, stage

BUCKETS = 1 << 15
SHRINK = 5.0
#: Trigrams of a text are not independent: a text counts as at most so many, each with this weight.
MOST_TRIGRAMS, TRIGRAM_WEIGHT = 300, 0.3
DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
META = re.compile(r"<meta\b[^<>]*", re.I)
CONTENT = re.compile(r"\bcontent\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
OPENING = re.compile(r"<!--|<(script|style)\b", re.I)
TAG = re.compile(r"<[^<>]*>")


@dataclass
class TextModel:
    """log P(trigram | language) for each bucket; the last row is neutral."""

    langs: list[str]
    table: np.ndarray


def markup(html: str) -> str:
    """The page without comments, scripts and styles; linear in its length."""
    out, at, low = [], 0, None
    while m := OPENING.search(html, at):
        out.append(html[at : m.start()])
        if m.group(1) is None:
            end, skip = html.find("-->", m.end()), 3
        else:
            low = low or html.lower()
            end, skip = low.find(f"</{m.group(1).lower()}", m.end()) if len(low) == len(html) else html.find(f"</{m.group(1)}", m.end()), 0
        if end < 0:
            at = len(html)
            break
        at = end + skip
    out.append(html[at:])
    return "".join(out)


def visible(page: str) -> str:
    """Text outside of the tags of a page's ``markup``."""
    return TAG.sub(" ", page)


def declared(page: str) -> str | None:
    """Language that a page's ``markup`` declares: of its html tag, else of a content-language tag, whose attributes may come in any order."""
    if not (found := DECLARED.search(page)):
        tags = (m.group() for m in META.finditer(page))
        found = next(filter(None, (CONTENT.search(t) for t in tags if "content-language" in t.lower())), None)
    return found.group(1).lower() if found else None


def trigram_buckets(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at each byte; BUCKETS where it would leave the text."""
    b = tx.LOWER[data].astype(np.uint32)
    out = np.full(len(b), BUCKETS, np.int64)
    if len(b) >= 3:
        out[:-2] = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(17)
    for back in (1, 2):
        at = offs[1:] - back
        out[at[at >= 0]] = BUCKETS
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """Trigram counts of every labelled document; the driver gets BUCKETS sums for each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi, data, offs in tx.pieces(batch.column(0)):
                names, own = np.unique(np.array(batch.column(1).slice(lo, hi - lo).to_pylist(), dtype=object).astype(str), return_inverse=True)
                at = np.repeat(own, np.diff(offs)) * (BUCKETS + 1) + trigram_buckets(data, offs)
                counts = np.bincount(at, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                for name, c in zip(names.tolist(), counts):
                    total[name] = total.get(name, 0) + c
        for name, c in total.items():
            full = np.flatnonzero(c[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(c[full])], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null")
    got = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.full((BUCKETS, len(langs)), 0.5)
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        counts[got.column("bucket").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] += got.column("n").to_numpy()
    table = np.log(counts / counts.sum(axis=0))
    return TextModel(langs, np.concatenate([table, np.zeros((1, len(langs)))]).astype(np.float32))


def text_evidence(rows: DataFrame, model: TextModel, text: str, is_html: str) -> DataFrame:
    """``rows`` without the text, with ``__declared``, ``__ll`` (log-likelihoods) and ``__p`` (their posterior)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    kept = [f for f in rows.schema.fields if f.name not in (text, is_html)]
    schema = T.StructType([*kept, T.StructField("__declared", T.StringType()), T.StructField("__ll", T.ArrayType(T.DoubleType())), T.StructField("__p", T.ArrayType(T.DoubleType()))])
    spot, flag, wanted = rows.columns.index(text), rows.columns.index(is_html), [rows.columns.index(f.name) for f in kept]

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, max(1, a.shape[1]), dtype=np.int32) if a.shape[1] else np.zeros(len(a) + 1, np.int32)), pa.array(a.ravel().astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for lo, hi, _, _ in tx.pieces(whole.column(spot)):
                batch = whole.slice(lo, hi - lo)
                html = batch.column(flag).to_pylist()
                if any(html):
                    raw = [markup(t or "") if h else t for t, h in zip(batch.column(spot).to_pylist(), html)]
                    said = [declared(t) if h else None for t, h in zip(raw, html)]
                    texts = pa.array([visible(t) if h else t for t, h in zip(raw, html)], pa.large_string())
                else:
                    said, texts = [None] * batch.num_rows, batch.column(spot)
                ll = np.zeros((batch.num_rows, len(m.langs)))
                for a, b, data, offs in tx.pieces(texts):
                    buckets = trigram_buckets(data, offs)
                    n = np.maximum(np.diff(offs) - 2, 0)
                    for k in range(len(m.langs)):
                        c = np.concatenate([[0.0], np.cumsum(m.table[buckets, k], dtype=np.float64)])
                        ll[a:b, k] = (c[offs[1:]] - c[offs[:-1]]) / np.maximum(n, 1) * np.minimum(n, MOST_TRIGRAMS) * TRIGRAM_WEIGHT
                p = np.exp(ll - ll.max(axis=1, keepdims=True)) if ll.shape[1] else ll
                p = p / p.sum(axis=1, keepdims=True) if ll.shape[1] else p
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in wanted], pa.array(said, pa.string()), lists(ll), lists(p)], names=schema.names)

    return rows.mapInArrow(run, schema)


def identify(rows: DataFrame, model: TextModel, text: str = "text", host: str | None = None, suffix: str | None = None, parent: str | None = None, is_html: Column | None = None) -> DataFrame:
    """``rows`` without their text, with declared, text_lang, lang and confidence (posterior of ``lang``); input columns of these names are replaced."""
    n = len(model.langs)
    names = F.array(*[F.lit(x) for x in model.langs]) if n else F.array().cast("array<string>")
    col = lambda c: F.col(c) if c else F.lit(None).cast("string")
    own = others(rows, text, "declared", "text_lang", "lang", "confidence")
    given = rows.select(*own, text, col(host).alias("__host"), col(suffix).alias("__suffix"), col(parent).alias("__parent"), (is_html if is_html is not None else F.lit(False)).alias("__html"))
    seen = stage(text_evidence(given, model, text, "__html"), "language-evidence")
    if not n:
        return seen.select(*own, F.col("__declared").alias("declared"), *[F.lit(None).cast(t).alias(c) for c, t in (("text_lang", "string"), ("lang", "string"), ("confidence", "double"))])
    sums = [F.sum(F.col("__p")[i]).alias(f"s{i}") for i in range(n)]
    vector = F.array(*[F.col(f"s{i}") for i in range(n)])
    total = [x or 0.0 for x in seen.agg(*sums, F.count(F.lit(1)).alias("rows")).first()]
    zero = F.lit(0.0)
    less = lambda sums, i: F.greatest(sums - F.col("__p")[i], zero)  # a sum without the row's own share
    level = lambda *keys: seen.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(*sums, F.count(F.lit(1)).cast("double").alias("rows"))
    parents = level("__parent").select(F.col("__parent").alias("k_parent"), vector.alias("up_sum"), F.col("rows").alias("up_rows"))
    hosts = level("__host", "__parent").join(parents, F.col("__parent") == F.col("k_parent"), "left").select(
        F.col("__host").alias("k_host"), F.col("__parent").alias("k_hp"), vector.alias("h_sum"), F.col("rows").alias("h_rows"), "up_sum", "up_rows")

    def prior(i: int) -> Column:
        """P(language) of the row's host, shrunk to its parent domain, that to the corpus."""
        root = (less(F.lit(total[i]), i) + 1.0) / (total[-1] - 1 + n)
        up = F.when(F.col("up_rows").isNull(), root).otherwise((less(F.col("up_sum")[i], i) + SHRINK * root) / (F.col("up_rows") - 1 + SHRINK))
        return F.when(F.col("h_rows").isNull(), root).otherwise((less(F.col("h_sum")[i], i) + SHRINK * up) / (F.col("h_rows") - 1 + SHRINK))

    def values(key: str, name: str) -> tuple[DataFrame, int]:
        """Sums of each value, and the number of values with one to spare."""
        found = level(key)
        return found.select(F.col(key).alias(f"k_{name}"), vector.alias(name)), found.count() + 1

    def likelihood(name: str, kinds: int, i: int) -> Column:
        """log P(value | language), a pseudo-row spread over the values seen; 0 without a value."""
        return F.when(F.col(name).isNull(), zero).otherwise(F.log((less(F.col(name)[i], i) + 1.0 / kinds) / (less(F.lit(total[i]), i) + 1.0)))

    (said, n_said), (ends, n_ends) = values("__declared", "of_declared"), values("__suffix", "of_suffix")
    full = (seen.join(hosts, F.col("__host").eqNullSafe(F.col("k_host")) & F.col("__parent").eqNullSafe(F.col("k_hp")), "left")
            .join(said, F.col("__declared") == F.col("k_of_declared"), "left").join(ends, F.col("__suffix") == F.col("k_of_suffix"), "left"))
    scores = F.array(*[F.col("__ll")[i] + F.log(prior(i)) + likelihood("of_declared", n_said, i) + likelihood("of_suffix", n_ends, i) for i in range(n)])
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    made = full.withColumn("__score", scores)
    confidence = F.lit(1.0) / F.aggregate(F.transform("__score", lambda x: F.exp(x - F.array_max("__score"))), F.lit(0.0), lambda a, x: a + x)
    return made.select(*own, F.col("__declared").alias("declared"), F.when(F.array_min("__ll") < F.array_max("__ll"), best(F.col("__ll"))).alias("text_lang"), best(F.col("__score")).alias("lang"), confidence.alias("confidence"))
