"""The registered queries of the operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripestream.llm import aligned, decontam, hilbert, langid, licenses, mixing, neardup, quality, shards, tokens, toxicity, urlfilter, veccodes
from ripestream.llm.common import stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (all four kinds of evidence) and documents (text and source); one of page_id and doc_id is null."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = langid.train(docs)
    host = F.nullif(urlfilter.url_host(F.col("url")), F.lit(""))
    none = F.lit(None).cast("string")
    rows = pages.select("page_id", F.lit(None).cast("long").alias("doc_id"), host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("suffix"),
                        F.regexp_replace(host, r"^[^.]*\.(?=[^.]*\.)", "").alias("parent"), F.col("html").alias("text")).unionByName(
        docs.select(F.lit(None).cast("long").alias("page_id"), "doc_id", F.concat(F.lit("source:"), "source").alias("host"), none.alias("suffix"), none.alias("parent"), "text"))
    found = langid.identify(rows, model, "text", "host", "suffix", "parent", F.col("page_id").isNotNull() | F.col("doc_id").isNull())
    return found.select("page_id", "doc_id", "host", "suffix", "declared", "text_lang", "lang", "confidence")


@query("op2_url_filter", r"""
WITH rules(rule, action) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
r AS (SELECT rule, action, regexp_extract(rule, '^([^/]*)', 1) AS h, regexp_extract(rule, '^[^/]*(.*)$', 1) AS p FROM rules),
u AS (SELECT row_number() OVER () AS rid, page_id,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT u.rid, r.rule, r.action, row_number() OVER (PARTITION BY u.rid ORDER BY length(r.rule) DESC, length(r.h) DESC, r.action DESC) AS k
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM u LEFT JOIN m ON m.rid = u.rid AND m.k = 1
""")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("""SELECT * FROM VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
                         ('net/es/', 'block'), ('net/fr/', 'block') AS rules(rule, action)""")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(table(spark, sf_dir, "documents"), shards.SHARDS)
    return placed.select("doc_id", shards.text_bytes("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
                         "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


_ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op4_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, g, len(g) AS k FROM (SELECT item_id, list_slice(w, i, i + 9) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0))),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, list_slice(w, i, i + k - 1) AS g FROM (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw USING (g)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT rid, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN n USING (rid)
""")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark"), drop_text=True)
    names = F.array_join(F.array_sort(F.transform("leaks.items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "leaks.n_words", "leaks.n_hit", F.size("leaks.items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (F.col("leaks.n_hit") > 0).alias("contaminated"))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), drop_text=True)
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.array_join("broken", ",").alias("broken"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "lang", "text"), model, out="score", drop_text=True)
    return scored.select("doc_id", (toxicity.remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
                         toxicity.flagged(scored, model, score_col="score").alias("flagged"))


@query("op7_near_duplicates", r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.rid = x JOIN n v ON v.rid = y WHERE 100 * c >= 80 * (u.n + v.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(rid, q) AS (SELECT rid, rid FROM d UNION SELECT r.rid, e.y FROM r JOIN e ON e.x = r.q),
m AS (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN d o ON o.rid = r.q GROUP BY r.rid)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)
""")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, drop_text=True).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = tokens.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op10_licence_scan")
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    joined = lambda c: F.array_join(f"licence.{c}", ",").alias(c)
    return found.select("doc_id", "licence.n_words", "licence.n_base", "licence.first_word", "licence.last_word", joined("base_labels"), joined("labels"), "licence.score")


def _codes_sql(parts: int = veccodes.PARTS, entries: int = veccodes.ENTRIES, rounds: int = veccodes.ROUNDS) -> str:
    """Product codes by comparing every part with every entry; vectors of 64 components."""
    ctes = [f"""WITH k0 AS (SELECT *, row_number() OVER () AS rid FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
dim AS (SELECT arg_min(len(embedding), (vec_id IS NULL, coalesce(vec_id, 0), -len(embedding))) AS n FROM k0),
k AS (SELECT k0.*, n // {parts} AS w FROM k0, dim WHERE len(embedding) = n),
p AS (SELECT rid, part, list_transform(list_slice(embedding, part * w + 1, part * w + w), lambda x: CAST(greatest(-16777216, least(16777216, floor(256 * CAST(x AS DOUBLE)))) AS BIGINT)) AS v
  FROM k, range(0, {parts}) g(part)),
s AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS entry FROM k QUALIFY entry < {entries}),
c0 AS (SELECT part, entry, v FROM p JOIN s USING (rid))"""]
    near = """SELECT rid, part, min((list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry)) AS best FROM p JOIN {c} c USING (part) GROUP BY rid, part"""
    for i in range(1, rounds + 1):
        ctes.append(f"""a{i} AS ({near.format(c=f"c{i - 1}")}),
m{i} AS (SELECT part, a.best[2] AS entry, list(v) AS vs, count(*) AS n FROM a{i} a JOIN p USING (rid, part) GROUP BY part, a.best[2]),
c{i} AS (SELECT part, entry, CASE WHEN m.n IS NULL THEN c.v ELSE list_transform(range(1, len(c.v) + 1), lambda j: CAST(floor(CAST(list_sum(list_transform(m.vs, lambda q: q[j])) AS DOUBLE) / m.n) AS BIGINT)) END AS v
  FROM c{i - 1} c LEFT JOIN m{i} m USING (part, entry))""")
    ctes.append(f"""f AS ({near.format(c=f"c{rounds}")}),
e AS (SELECT rid, string_agg(lower(printf('%02x', CAST(best[2] AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM f GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS d FROM c{rounds})""")
    return ",\n".join(ctes) + "\nSELECT k.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.d AS codebooks_sha256 FROM k JOIN e USING (rid), h"


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = veccodes.encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    total = veccodes.with_group_error(stage(coded, "codes"), "label", "label_error")
    return total.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(veccodes.digest(codebooks)).alias("codebooks_sha256"))


@query("op12_nearest_vectors")
def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = aligned.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
