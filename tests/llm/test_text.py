import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ripestream.llm import text as tx

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbz 09\t\n.,é日\u00a0", max_size=30)), min_size=1, max_size=8)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 60), st.sampled_from([pa.string(), pa.large_string()]))
def test_words_and_grams_match_regex(texts, limit, kind):
    for table, pattern in ((tx.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (tx.INKED, r"[^\x20\x09-\x0D]+")):
        seen: dict[str, int] = {}
        rows = 0
        for lo, hi, data, offs in tx.pieces(pa.array(texts, kind), limit):
            page = tx.Page(data, offs, table, lower=True)
            starts, ends = page.spans
            for i in range(lo, hi):
                want = re.findall(pattern, (texts[i] or "").translate(LOWER))
                spot = range(page.first[i - lo], page.first[i - lo + 1])
                got = [bytes(tx.LOWER[data[starts[j] : ends[j]]]).decode() for j in spot]
                assert got == want
                for j, w in zip(spot, got):
                    assert seen.setdefault(w, int(page.words[j])) == int(page.words[j])
                rows += 1
            h, at = page.grams(2)
            want = [j for i in range(page.n) for j in range(page.first[i], page.first[i + 1] - 1)]
            assert at.tolist() == want and len(h) == len(want)
        assert rows == len(texts)
        assert len(set(seen.values())) == len(seen)


def test_sliced_and_empty_columns():
    col = pa.array(["a b", "c", None, "d e f"]).slice(1, 3)
    got = [(lo, hi, data.tobytes()) for lo, hi, data, _ in tx.pieces(col)]
    assert got == [(0, 3, b"cd e f")]
    assert list(tx.pieces(pa.array([], pa.string()))) == []
    (_, _, data, offs), = tx.pieces(pa.array([None, ""]))
    page = tx.Page(data, offs, tx.INKED)
    assert page.counts.tolist() == [0, 0] and len(page.words) == 0 and np.all(page.first == 0)
