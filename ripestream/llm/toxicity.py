"""Toxicity scores by a small convolutional classifier, trained in numpy.

Every word is the sum of hashed embeddings: one for the word and one for each
of its first ``PREFIXES`` bytes.  Filters of several widths run over the whole
text, the largest value of each is kept (max pooling), and a logistic layer
turns them into a score.  As a filter is linear in the word, it is applied once
to each distinct word of a piece and looked up for the others.

Training reads a bounded sample of labelled rows: at most ``MAX_TOXIC`` and
``MAX_CLEAN`` texts of up to ``MAX_TEXT`` bytes, those of lowest id hash.  A
quarter of it is held back from the weights.  Then all labelled rows, of any
length, that didn't train the weights are scored and counted by language, label
and raw value.  The counts set the scale of the score and a threshold for each
language: that of best F1, drawn to the common one by ``MIN_POSITIVE`` rows'
weight, so a language with few toxic rows stays near that.  Each class weighs as much as among all labelled rows,
so the caps of the sample don't move the score.  The language is used for that
threshold alone, never for the score.  Scoring covers all documents and whole
texts.

Cases: null and empty texts are scored as a text without words.  Labels other
than 0 and 1, null labels and labels without a document are ignored.  Without
both kinds of labels every score is the share of toxic ones, or 0.  Repeated
rows get equal scores.  A null language has the common threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripestream.llm import text as tx

BUCKETS, DIM = 1 << 15, 8
PREFIXES = (3, 4, 5, 6, 7, 8)
WIDTHS, FILTERS = (1, 2, 3), 8
MAX_TOXIC, MAX_CLEAN, MAX_TEXT = 4_000, 8_000, 8_192
EPOCHS, BATCH, RATE = 8, 32, 0.05
#: Toxic rows that pull a language's threshold half-way from the common one to its own.
MIN_POSITIVE = 20
#: Bits of the table of labelled ids, 1 MB whatever their number.
ID_BITS = 1 << 23
#: Bins of one unit of the raw value.
FINENESS = 64
#: Empty words after each text, so that the widest filter stays inside it.
PADS = max(WIDTHS)


def word_buckets(page: tx.Page) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each distinct word, distinct word of each word); distinct word 0 is the pad."""
    start, end = page.spans
    _, where, back = np.unique(page.words, return_index=True, return_inverse=True)
    s, e = start[where], end[where]
    cols = [page.words[where]]
    for n in PREFIXES:
        long = e - s >= n
        h = np.zeros(len(s), np.uint64)
        h[long] = page.hash_spans(s[long], s[long] + n) * np.uint64(2 * n + 1)
        cols.append(h)
    found = (np.stack(cols, axis=1) >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    found[np.stack(cols, axis=1) == 0] = 0  # bucket 0 has no embedding
    return np.concatenate([np.zeros((1, found.shape[1]), np.int32), found.astype(np.int32)]), back + 1


def padded(page: tx.Page, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of all texts with pads after each, first position of each text)."""
    out = np.insert(words, np.repeat(page.first[1:], PADS), 0)
    return out, page.first[:-1] + PADS * np.arange(page.n)


@dataclass
class Model:
    """Weights; ``scale`` and ``shift`` bring the raw value to a calibrated log-odds."""

    emb: np.ndarray
    filters: list[np.ndarray]  # one (width, DIM, FILTERS) for each width
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    trained: np.ndarray | None = None  # rows that set the weights

    def features(self, buckets: np.ndarray, words: np.ndarray, starts: np.ndarray, spots: bool = False):
        """(filters x texts) pooled values before the ramp, and their positions if asked for."""
        x = self.emb[buckets].sum(axis=1)
        edge = np.concatenate([starts, [len(words)]])
        ok = np.ones(len(words), bool)
        for j in range(1, PADS):  # windows that begin at a later pad would reach into the next text
            ok[edge[1:] - j] = False
        pooled, where = [], []
        for w in self.filters:
            width = len(w)
            conv = np.full((w.shape[2], len(words)), -1e30, np.float32)
            n = len(words) - width + 1
            conv[:, :n] = (x @ w[0]).T[:, words[:n]]
            for j in range(1, width):
                conv[:, :n] += (x @ w[j]).T[:, words[j : j + n]]
            conv[:, ~ok] = -1e30
            best = np.maximum.reduceat(conv, starts, axis=1)
            pooled.append(best)
            if spots:
                same = conv == np.repeat(best, np.diff(edge), axis=1)
                at = np.empty(best.shape, np.int64)
                for f in range(len(best)):
                    hit = np.flatnonzero(same[f])
                    at[f] = hit[np.searchsorted(hit, starts)]
                where.append(at)
        return np.concatenate(pooled) + self.bias[:, None], where, x

    def raw(self, page: tx.Page) -> np.ndarray:
        buckets, words = word_buckets(page)
        pooled, _, _ = self.features(buckets, *padded(page, words))
        return self.out @ np.maximum(pooled, 0) + self.out_bias

    def score(self, page: tx.Page) -> np.ndarray:
        if self.constant is not None:
            return np.full(page.n, self.constant)
        return sigmoid(self.scale * self.raw(page).astype(np.float64) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(texts: list[str], toxic: np.ndarray, langs: list[str | None], seed: int = 3) -> Model:
    """Train on three quarters of the rows, calibrate on the rest."""
    rng = np.random.default_rng(seed)
    n = len(texts)
    m = Model(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
              np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)
    m.emb[0] = 0
    if n == 0 or toxic.min() == toxic.max():
        m.constant = float(toxic.mean()) if n else 0.0
        return m
    # words as indexes into one table of distinct words
    table: dict[tuple, int] = {}
    rows: list[np.ndarray] = []
    for _, _, data, offs in tx.pieces(pa.array(texts, pa.large_string())):
        page = tx.Page(data, offs, tx.ALNUM, lower=True)
        buckets, words = word_buckets(page)
        own = np.array([table.setdefault(t, len(table)) for t in map(tuple, buckets.tolist())], np.int32)
        rows += [own[words[page.first[i] : page.first[i + 1]]] for i in range(page.n)]
    known = np.array(list(table), np.int32)
    pad = table[(0,) * known.shape[1]]
    order = rng.permutation(n)
    held, train = order[: n // 4], order[n // 4 :]
    m.trained = np.sort(train)
    params = [*m.filters, m.bias, m.out]
    first, second, grown = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], np.full(BUCKETS, 1e-3, np.float32)
    step = 0

    def batch(ids: np.ndarray):
        seq = [np.concatenate([rows[i], np.full(PADS, pad, np.int32)]) for i in ids]
        words, back = np.unique(np.concatenate(seq), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in seq])])[:-1]
        return known[words], back, starts

    for epoch in range(EPOCHS):
        rng.shuffle(train)
        rate = RATE * (1 - epoch / EPOCHS)
        for lo in range(0, len(train), BATCH):
            ids = train[lo : lo + BATCH]
            buckets, words, starts = batch(ids)
            pooled, where, x = m.features(buckets, words, starts, spots=True)
            hidden = np.maximum(pooled, 0)
            d = (sigmoid(m.out @ hidden + m.out_bias) - toxic[ids]).astype(np.float32) / len(ids)
            grads = [np.zeros_like(p) for p in params]
            grads[-1] = hidden @ d
            back = m.out[:, None] * d * (pooled > 0)
            grads[-2] = back.sum(axis=1)
            dx = np.zeros_like(x)
            for k, at in enumerate(where):
                g = back[k * FILTERS : (k + 1) * FILTERS]
                for j in range(WIDTHS[k]):
                    w = words[np.minimum(at + j, len(words) - 1)]
                    grads[k][j] = np.einsum("fnd,fn->df", x[w], g)
                    np.add.at(dx, w.ravel(), np.einsum("fn,df->fnd", g, m.filters[k][j]).reshape(-1, DIM))
            m.out_bias -= rate * 0.5 * float(d.sum())
            step += 1
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= 0.2 * rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
            hit = np.flatnonzero(np.abs(dx).sum(axis=1))
            spread, rows_at = np.repeat(dx[hit], buckets.shape[1], axis=0), buckets[hit].ravel()
            uniq, inv = np.unique(rows_at, return_inverse=True)
            total = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(total, inv, spread)
            grown[uniq] += (total * total).mean(axis=1)
            m.emb[uniq] -= rate * 2 * total / np.sqrt(grown[uniq])[:, None]
            m.emb[0] = 0
    raw = np.concatenate([m.out @ np.maximum(m.features(*batch(held[lo : lo + 256]))[0], 0) + m.out_bias for lo in range(0, len(held), 256)]).astype(np.float64) if len(held) else np.zeros(0)
    calibrate(m, raw, toxic[held], [langs[i] for i in held])
    return m


def calibrate(m: Model, raw: np.ndarray, toxic: np.ndarray, langs: list[str | None], n: np.ndarray | None = None, weight: np.ndarray | None = None) -> None:
    """Logistic scale of the raw value (Newton steps with a weak prior at 1, 0), then thresholds of best F1.

    An entry stands for ``n`` rows, each of weight ``weight`` (1 where not given).
    """
    n = np.ones(len(raw)) if n is None else n
    mass = n if weight is None else n * weight
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * raw + b)
        e, w = mass * (p - toxic), mass * p * (1 - p)
        grad = np.array([(e * raw).sum() + (a - 1), e.sum() + 0.1 * b])
        hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
        move = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a, b = max(0.05, a - move[0]), b - move[1]
    m.scale, m.shift = float(a), float(b)
    p = sigmoid(a * raw + b)

    def best(own: np.ndarray) -> float:
        if not len(own):
            return 0.5
        cuts, at = np.unique(np.round(p[own], 4), return_inverse=True)
        above = lambda x: np.cumsum(np.bincount(at, x, len(cuts))[::-1])[::-1]
        hit, false = above(mass[own] * toxic[own]), above(mass[own] * (1 - toxic[own]))
        k = int(np.argmax(2 * hit / np.maximum(1, hit + hit[0] + false)))
        return float((cuts[k] + cuts[k - 1]) / 2 if k else cuts[k])  # halfway to the next lower score

    everyone = np.arange(len(raw))
    m.threshold = best(everyone) if toxic.sum() else 0.5
    m.thresholds = {}
    names = np.array(["" if x is None else x for x in langs], object)
    some = np.array([x is not None for x in langs], bool)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.flatnonzero(some & (names == lang))
        marked = float((n[own] * toxic[own]).sum())
        if marked:
            m.thresholds[lang] = (marked * best(own) + MIN_POSITIVE * m.threshold) / (marked + MIN_POSITIVE)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 marks held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Model:
    """Fit on the bounded sample of labelled rows that aren't held out."""
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(remainder(F.col("id")) != 1)
    sample = marks.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(MAX_TOXIC).unionByName(marks.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(MAX_CLEAN))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TEXT)
    got = rows.join(sample, "id").select("id", "text", "lang", "y").toArrow().sort_by([("id", "ascending"), ("text", "ascending"), ("y", "ascending")])
    m = fit(["" if t is None else t for t in got.column("text").to_pylist()], np.array(got.column("y").to_pylist(), np.float32), got.column("lang").to_pylist())
    if m.constant is None:
        seen = docs.sparkSession.createDataFrame(pa.table({"id": got.column("id").take(pa.array(m.trained)).unique()})).withColumn("seen", F.lit(True))
        recalibrate(m, docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id is not null"), marks, seen)
    m.trained = None
    return m


def recalibrate(m: Model, docs: DataFrame, marks: DataFrame, seen: DataFrame) -> None:
    """Calibrate on all labelled rows that didn't train the weights; classes weigh as among all labelled rows.

    A table of hashed ids goes to the tasks, which score the texts whose ids it
    may hold; the join with the labels drops the few others.
    """
    spot = F.pmod(F.xxhash64("id"), F.lit(ID_BITS))
    words = marks.select(spot.alias("h")).groupBy(F.floor(F.col("h") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 AS INT))")).alias("bits")).collect()  # at most ID_BITS / 64 rows
    table = np.zeros(ID_BITS // 64, np.uint64)
    for word, bits in words:
        table[word] = bits & ((1 << 64) - 1)
    sent = docs.sparkSession.sparkContext.broadcast((m, np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(known[batch.column(3).to_numpy()]))
            for lo, hi, data, offs in tx.pieces(batch.column(2)):
                raw = model.raw(tx.Page(data, offs, tx.ALNUM, lower=True)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(raw)], names=["id", "lang", "raw"])

    kinds = T.StructType([docs.schema["id"], docs.schema["lang"], T.StructField("raw", T.DoubleType())])
    valued = docs.select("id", "lang", "text", spot.alias("h")).mapInArrow(run, kinds).join(marks, "id").join(seen, "id", "left")
    rows = valued.groupBy("lang", "y", F.floor(F.col("raw") * FINENESS).alias("bin"), F.col("seen").isNotNull().alias("seen")).agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"))
    got = rows.toArrow().sort_by([("lang", "ascending"), ("y", "ascending"), ("bin", "ascending"), ("seen", "ascending")])
    y, n, raw = (got.column(c).to_numpy().astype(np.float64) for c in ("y", "n", "raw"))
    fresh = ~got.column("seen").to_numpy()
    total, left = (np.bincount(y[own].astype(int), n[own], 2) for own in (fresh | True, fresh))
    if left.min() > 0:  # else the sample's own quarter stands
        share = (total / total.sum()) / (left / left.sum())
        langs = [x for x, f in zip(got.column("lang").to_pylist(), fresh) if f]
        calibrate(m, raw[fresh], y[fresh], langs, n[fresh], share[y[fresh].astype(int)])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity", drop_text: bool = False) -> DataFrame:
    """``docs`` with the score of each whole text; a column named ``out`` is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    kept = [f for f in docs.schema.fields if f.name.lower() != out.lower() and not (drop_text and f.name == text)]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    spot, wanted = docs.columns.index(text), [i for i, f in enumerate(docs.schema.fields) if f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for lo, hi, data, offs in tx.pieces(batch.column(spot)):
                part = batch.slice(lo, hi - lo)
                got = m.score(tx.Page(data, offs, tx.ALNUM, lower=True))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in wanted], pa.array(got, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def flagged(scored: DataFrame, model: Model, lang: str = "lang", score_col: str = "toxicity") -> Column:
    """Whether the score reaches the threshold of the row's language."""
    own = F.lit(model.threshold)
    for name, cut in model.thresholds.items():
        own = F.when(scored[lang] == name, F.lit(cut)).otherwise(own)
    return scored[score_col] >= own
