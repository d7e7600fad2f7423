import math

from llm_words import prose
from pyspark.sql import functions as F

from ripestream.llm import langid
from ripestream.llm.queries import QUERIES

DE = "der die und ist nicht ein zu das mit sich auf für wird von den schön über straße"
EN = "the and of to in is that it was for on with as this house river street"


def text(words, seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(words.split()) for _ in range(n))


def train(spark):
    rows = [(text(DE, i, 40), "de") for i in range(40)] + [(text(EN, i, 40), "en") for i in range(40)] + [(None, "en"), ("x", None), ("", "de")]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_visible_and_declared():
    page = langid.markup('<!-- <html lang="xx"> --><html class=a lang="de-AT"><script>if (a<b) "</p>"</script><style>p{}</style><p>guten <b>Tag</b></p><script>never closed <p>gone</p>')
    assert langid.visible(page).split() == ["guten", "Tag"]
    assert langid.declared(page) == "de" and langid.declared('<meta http-equiv="content-language" content="fr">') == "fr"
    assert langid.declared('<meta name=a content="xx"><meta content="es-MX" http-equiv="Content-Language">') == "es"
    assert langid.declared(langid.markup('<script>"<html lang=xx>"</script><!-- <meta http-equiv="content-language" content="yy"> --><p>')) is None
    assert langid.declared("<p>") is None and langid.declared('<meta http-equiv="content-language">') is None
    assert len(langid.visible(langid.markup("<" * 200_000))) == 200_000 and langid.visible(langid.markup("<!--" * 50_000)) == ""


def plain(rows, langs):
    """Posterior of each row (ll, p, host, parent, suffix, declared) by counting the other rows one by one."""
    out, n = [], len(langs)
    for j, r in enumerate(rows):
        rest = rows[:j] + rows[j + 1 :]

        def total(test, k):
            return sum(o["p"][k] for o in rest if test(o))

        def share(key, k):
            kinds = len({o[key] for o in rows if o[key] is not None}) + 1
            return 1.0 if r[key] is None else (total(lambda o: o[key] == r[key], k) + 1 / kinds) / (total(lambda o: True, k) + 1)

        logs = []
        for k in range(n):
            prior = (total(lambda o: True, k) + 1) / (len(rest) + n)
            if r["host"] is not None:
                for same in ([lambda o: o["parent"] == r["parent"]] if r["parent"] is not None else []) + [lambda o: (o["host"], o["parent"]) == (r["host"], r["parent"])]:
                    prior = (total(same, k) + langid.SHRINK * prior) / (sum(map(same, rest)) + langid.SHRINK)
            logs.append(r["ll"][k] + math.log(prior) + math.log(share("declared", k)) + math.log(share("suffix", k)))
        weights = [math.exp(x - max(logs)) for x in logs]
        out.append((langs[logs.index(max(logs))], max(weights) / sum(weights)))
    return out


def test_posterior_equals_plain_counting(spark):
    model = train(spark)
    rows = []
    for i in range(60):
        host, parent, suffix = [("a.x.org", "x.org", "org"), ("b.x.org", "x.org", "org"), ("y.com", None, "com"), (None, "x.org", None), (None, None, "com")][i % 5]
        body = [None, "", text(DE, i, 2), text(EN, i, 3), text(DE, i, 1) + " " + text(EN, i, 1)][i * 7 % 11 % 5]
        rows.append((i, f'<html lang="{["de", "en", "fr"][i % 3]}"><p>{body}</p>' if i % 4 == 0 else body, host, parent, suffix))
    frame = spark.createDataFrame(rows, "id long, text string, host string, parent string, suffix string")
    html = F.coalesce(F.col("text").startswith("<html"), F.lit(False))
    seen = {r["id"]: r for r in langid.text_evidence(frame.withColumn("h", html), model, "text", "h").collect()}
    known = [{"ll": seen[i]["__ll"], "p": seen[i]["__p"], "declared": seen[i]["__declared"], "host": h, "parent": p, "suffix": s} for i, _, h, p, s in rows]
    got = {r["id"]: r for r in langid.identify(frame, model, "text", "host", "suffix", "parent", html).collect()}
    for (i, *_), (lang, confidence) in zip(rows, plain(known, model.langs)):
        assert abs(got[i].confidence - confidence) < 1e-9 and (got[i].lang == lang or abs(confidence - 0.5) < 1e-9), i


def test_evidence_is_fused(spark):
    model = train(spark)
    assert model.langs == ["de", "en"]
    rows = [(i, text(DE, 900 + i, 30), "de.example.org", "org", "example.org", None) for i in range(60)]
    rows += [(100 + i, text(EN, 900 + i, 30), "www.other.com", "com", "other.com", None) for i in range(60)]
    rows += [(200, "", "de.example.org", "org", "example.org", None), (201, None, "www.other.com", "com", "other.com", None), (202, "", "new.example.org", "org", "example.org", None),
             (203, "", None, None, None, None), (204, text(DE, 5, 30), "www.other.com", "com", "other.com", None), (None, "", "", "", None, None)]
    rows += [(300 + i, f'<html lang="de"><p>{text(DE, 800 + i, 20)}</p>', None, None, None, "h") for i in range(30)] + [(400, '<html lang="de"></html>', None, None, None, "h")]
    frame = spark.createDataFrame(rows, "id long, text string, host string, suffix string, parent string, lang string")
    got = {r.id: r for r in langid.identify(frame.withColumn("html", F.col("lang").isNotNull()).drop("lang"), model, "text", "host", "suffix", "parent", F.col("html")).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang for i in (200, 201, 202, 204, 400)] == ["de", "en", "de", "de", "de"]
    assert got[200].text_lang is None and got[400].declared == "de" and all(0.5 <= r.confidence <= 1 for r in got.values())


def test_empty_tables(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    assert langid.identify(no_docs.select("doc_id", "text"), model).count() == 0
    assert langid.identify(odd_docs.select("doc_id", "text", "host"), model, host="host").count() == odd_docs.count()
    clash = odd_docs.select("doc_id", "text", F.lit("x").alias("declared"), F.lit(1).alias("p"), F.lit("y").alias("confidence"))
    assert set(langid.identify(clash, model).columns) == {"doc_id", "p", "declared", "text_lang", "lang", "confidence"}
    nothing = langid.train(no_docs)
    assert [r.lang for r in langid.identify(odd_docs.select("doc_id", "text"), nothing).collect()] == [None] * odd_docs.count()


def test_rows_left_out_of_training(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.train(docs.where(~third))
    found = langid.identify(docs.where(third).select("doc_id", "text", "source", F.col("lang").alias("truth")), model, host="source").collect()
    right = sum(r.lang == r.truth for r in found) / len(found)
    print(f"left out: {right:.4f} of {len(found)}")
    assert right >= 0.98


def test_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    found = got.where("doc_id is not null").join(docs, "doc_id").collect()
    assert len(found) == docs.count() and sum(r.lang == r.truth for r in found) >= 0.99 * len(found)
    pages = got.where("page_id is not null").collect()
    assert len(pages) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert sum(r.lang == r.declared for r in pages) >= 0.98 * len(pages)
