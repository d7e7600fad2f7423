"""Licence statements in texts: notice phrases, identifier tags, licence expressions.

One Aho-Corasick automaton runs over each whole text, lower-cased (A-Z) and
reduced to its words with single blanks, so a phrase is found wherever its words
stand consecutively, overlaps included.  The same automaton finds the words of
an identifier tag (``SPDX-License-Identifier``); at such a tag the raw line is
read and its expression parsed by a shunting-yard parser:

    expression: identifier | ( expression ) | x AND y | x OR y | x WITH exception

``with`` binds tighter than ``and``, ``and`` tighter than ``or``.  The value of
an expression is how freely the text may be reused: 1 for permissive
identifiers, 0.5 for weak and 0.2 for strong copyleft, 0 for unknown ones; ``or``
takes the larger, ``and`` the smaller, ``with`` adds 0.2 up to 1.

``score`` is how well the text is licensed: the value of its best tag if it has
a valid one, else half the value of its best phrase label, leaving out labels that
a narrower one holds (cc-by beside cc-by-nc); 0 without evidence.

Cases: null and empty texts have no words, places or labels and score 0.  A tag
without a valid expression counts as evidence of nothing.  Phrases split over
lines or punctuation are found.  Repeated rows are scanned one by one.  The
input's columns are kept, and one struct column is added (a column of that name
is replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ripestream.llm import text as tx

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc license": "isc", "creative commons attribution": "cc-by",
    "public domain": "public-domain", "all rights reserved": "all-rights-reserved", "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
}
TAG = "spdx license identifier"
#: Value of a label; identifiers begin with one of these names.
VALUE = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "cc-by": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0, "lgpl": 0.5, "mpl": 0.5, "epl": 0.5,
         "cc-by-sa": 0.5, "gpl": 0.2, "agpl": 0.2, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "all-rights-reserved": 0.0}
TAG_LINE = re.compile(r"spdx-license-identifier\s*:\s*([^\r\n]*)", re.I)
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]+)")
BINDS = {"or": 1, "and": 2, "with": 3}

FOUND = T.StructType([T.StructField(n, t) for n, t in (
    ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.ArrayType(T.StringType())),
    ("labels", T.ArrayType(T.StringType())), ("expressions", T.ArrayType(T.StringType())), ("score", T.DoubleType()))])


class BadExpression(ValueError):
    """Not a licence expression."""


def to_postfix(line: str) -> list[str]:
    """Shunting-yard: the leading expression of a line in postfix order; trailing prose or comment ends are left off."""
    out: list[str] = []
    ops: list[str] = []
    operand = False  # an operand has just been read
    at, depth = 0, 0
    while (m := TOKEN.match(line, at)) and m.end() > at:
        token = m.group(1)
        low = token.lower()
        if token == "(":
            if operand:
                break
            ops.append(token)
            depth += 1
        elif token == ")":
            if not depth or not operand:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif low in BINDS:
            if not operand:
                break
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        else:
            if operand or not re.search(r"[A-Za-z0-9]", token):
                break
            out.append(token)
            operand = True
        at = m.end()
    if depth or not operand:
        raise BadExpression(line)
    while ops:
        out.append(ops.pop())
    return out


def label_of(identifier: str) -> str:
    """The family of an identifier; an unknown one stands for itself."""
    low = identifier.lower().rstrip("+.")
    fits = [f for f in VALUE if low == f or low.startswith(f + "-")]
    return max(fits, key=len) if fits else low


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """(how freely it allows reuse, labels of the licences it names)."""
    stack: list[tuple[float, set[str], str]] = []
    for token in postfix:
        if token in BINDS:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append((min(1.0, left[0] + 0.2) if left[0] else 0.0, left[1], left[2]))
            else:
                stack.append(((max if token == "or" else min)(left[0], right[0]), left[1] | right[1], ""))
        else:
            label = label_of(token)
            stack.append((VALUE.get(label, 0.0), {label}, token))
    return stack[0][0], stack[0][1]


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def reduced(page: tx.Page) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): every text as `` word word ... word ``, A-Z lower-cased."""
    start, end = page.spans
    size = end - start
    # a blank before every word and one after each text
    lead = np.arange(1, len(size) + 1) + page.doc
    place = np.cumsum(size) - size + lead
    total = int(size.sum()) + len(size) + page.n
    out = np.full(total, 32, np.uint8)
    inside = page.inside
    out[np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = tx.LOWER[page.data[inside]]
    per_text = np.concatenate([[0], np.cumsum(page.per_text(inside) + page.counts + 1)])
    return out, per_text


def scan_page(page: tx.Page, machine: ahocorasick.Automaton) -> list[dict]:
    """The FOUND fields of every text of a page opened with the ``ALNUM`` word bytes."""
    data, offs = reduced(page)
    whole = data.tobytes().decode("utf-8")
    # The texts of a page are searched at once; a blank separates them, and matches across a border are dropped.
    hits: dict[int, list[tuple[int, str]]] = {}
    lead = np.flatnonzero(tx.LEAD[data])  # byte of each character
    edges = np.searchsorted(lead, offs)
    ends = [(e, p) for e, p in machine.iter(whole)]
    for last, phrase in ends:
        begin = last - len(phrase) - 1
        i = int(np.searchsorted(edges, begin, side="right")) - 1
        if last < edges[i + 1]:
            hits.setdefault(i, []).append((begin, phrase))
    out = []
    for i in range(page.n):
        row = {"n_words": int(page.counts[i]), "n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "labels": [], "expressions": [], "score": 0.0}
        if found := hits.get(i):
            base = [(b, p) for b, p in found if p in BASE]
            if base:
                spots = [whole.count(" ", int(edges[i]), b + 1) - 1 for b in (min(base)[0], max(base)[0])]
                row |= {"n_base": len(base), "first_word": spots[0], "last_word": spots[1]}
            labels = {BASE[p] for _, p in base}
            row["base_labels"] = sorted(labels)
            labels |= {NOTICES[p] for _, p in found if p in NOTICES}
            # a label that only stands because a narrower one does (cc-by in cc-by-nc) has no say
            score = max((0.5 * VALUE.get(x, 0.0) for x in labels if not any(y.startswith(x + "-") for y in labels)), default=0.0)
            if any(p == TAG for _, p in found):
                raw = page.data[page.offs[i] : page.offs[i + 1]].tobytes().decode("utf-8")
                values = []
                for m in TAG_LINE.finditer(raw):
                    try:
                        postfix = to_postfix(m.group(1))
                    except BadExpression:
                        continue
                    value, names = evaluate(postfix)
                    values.append(value)
                    labels |= names
                    row["expressions"].append(" ".join(postfix))
                score = max(values, default=score)
            row |= {"labels": sorted(labels), "score": float(score)}
        out.append(row)
    return out


def scan(docs: DataFrame, text: str = "text", out: str = "licence", drop_text: bool = False) -> DataFrame:
    """``docs`` with a struct ``out`` of what was found in each whole text."""
    kept = [f for f in docs.schema.fields if f.name.lower() != out.lower() and not (drop_text and f.name == text)]
    schema = T.StructType([*kept, T.StructField(out, FOUND)])
    spot, wanted = docs.columns.index(text), [i for i, f in enumerate(docs.schema.fields) if f in kept]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]
    struct = pa.struct([pa.field(f.name, k) for f, k in zip(FOUND.fields, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for lo, hi, data, offs in tx.pieces(batch.column(spot)):
                rows = scan_page(tx.Page(data, offs, tx.ALNUM, lower=True), machine)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in wanted], pa.array(rows, struct)], names=schema.names)

    return docs.mapInArrow(run, schema)
