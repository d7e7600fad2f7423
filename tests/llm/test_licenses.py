import re

import pytest

from ripestream.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    spots, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                spots.append(i)
                labels.add(label)
    return len(w), len(spots), min(spots, default=None), max(spots, default=None), sorted(labels)


TEXTS = ["MIT License mit license MIT. license", "cc by é mit", "license", "gnu general-public LICENSE apache license x cc/by", "summit license", "mit licenses", "é mit license日 mit license", "mit", "license mit\n\nlicense", "cc by" * 4, "a " * 50 + "apache\tlicense"]


def test_places_match_brute_force(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(TEXTS, 100)), "doc_id long, text string"))
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    for r in licenses.scan(docs).collect():
        x = r.licence
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute(r.text)
        assert set(x.base_labels) <= set(x.labels) and x.labels == sorted(set(x.labels)) and 0 <= x.score <= 1
    assert licenses.scan(no_docs).count() == 0


@pytest.mark.parametrize("line, postfix, value", [
    ("MIT", "MIT", 1.0), ("GPL-2.0-only OR MIT */", "GPL-2.0-only MIT or", 1.0), ("GPL-2.0-only AND MIT", "GPL-2.0-only MIT and", 0.2),
    ("MIT or Apache-2.0 and GPL-3.0", "MIT Apache-2.0 GPL-3.0 and or", 1.0), ("(MIT or Apache-2.0) and LGPL-2.1", "MIT Apache-2.0 or LGPL-2.1 and", 0.5),
    ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", "GPL-2.0 Classpath-exception-2.0 with MIT and", 0.4), ("LicenseRef-own", "LicenseRef-own", 0.0), ("((MIT))", "MIT", 1.0),
])
def test_expressions(line, postfix, value):
    got = licenses.to_postfix(line)
    assert " ".join(got) == postfix and licenses.evaluate(got)[0] == pytest.approx(value)


@pytest.mark.parametrize("line", ["", "AND MIT", "MIT AND", "(MIT", "()", "MIT OR OR GPL", "WITH"])
def test_bad_expressions(line):
    with pytest.raises(licenses.BadExpression):
        licenses.to_postfix(line)


def test_tags_and_notices(spark):
    texts = ["// SPDX-License-Identifier: Apache-2.0 OR GPL-2.0-or-later\ncode", "spdx-license-identifier: AND", "Redistribution and use in source and binary forms, with or without", "Mozilla Public License; MIT license", "Licensed under CC BY-NC 4.0."]
    got = [r.licence for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [(x.labels, x.score) for x in got] == [(["apache", "gpl"], 1.0), ([], 0.0), (["bsd"], 0.5), (["mit", "mpl"], 0.5), (["cc-by", "cc-by-nc"], 0.1)]
    assert got[0].expressions == ["Apache-2.0 GPL-2.0-or-later or"]
