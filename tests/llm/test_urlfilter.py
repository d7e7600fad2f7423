from collections import Counter

from ripestream.llm import urlfilter

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("b.com/en", "allow"), ("com/en/2", "block"), ("dup.org/", "allow"), ("dup.org/", "block"), (None, "block")]
URLS = ["https://WWW.Example.com/en/1?q", "http://x.example.com/en/", "http://example.com", "http://example.com/", "ftp://notexample.com/en/1", "x", None, "", "a://b.com/en/2", "http://m.dup.org/z#f",
        "https://a.net/es/9", "https://a.net/ES/9", "http://com/", "http://?x", "u://a://b/c", "http://a..com/", "http://q.com:80/", "http://h.com/a\nb?x"]


def brute(url):
    import re

    if url is None or "://" not in url:
        host = path = ""
    else:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = m[2]
    fits = []
    for rule, action in RULES:
        if rule:
            h = rule.split("/")[0]
            if (host == h or host.endswith("." + h)) and path.startswith(rule[len(h):]):
                fits.append((len(rule), len(h), action == "block", rule))
    best = max(fits, default=None)
    return host, path, best and best[3], ("block" if best[2] else "allow") if best else "allow"


def test_against_brute_force(spark):
    rows = [(i % 5 or None, u, "clash") for i, u in enumerate(URLS * 2)]
    urls = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "rule string, action string")
    for threshold in ("-1", "10485760"):  # shuffled and broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = urlfilter.judge(urls, rules).select("page_id", "host", "path", "rule", "verdict").collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert Counter(map(tuple, got)) == Counter((r[0], *brute(r[1])) for r in rows)


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "rule string, action string")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    none = urlfilter.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), rules.limit(0)).collect()
    assert (none[0].rule, none[0].verdict) == (None, "allow")
