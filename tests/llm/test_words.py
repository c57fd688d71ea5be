"""Vectorised words, shingles and statistics against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.textstats import text_stats
from millrace.llm.wordhash import SYMBOLS, WHITE, Words, shingles, slices
from tests.llm import helpers as H

TEXT = st.text(alphabet=st.sampled_from("abAB01 \t\n\r.#é\u00a0😀|"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6))
def test_words_and_shingles(texts):
    for separators, pattern in ((WHITE, H.WHITE), (SYMBOLS, H.ALNUM)):
        seen = {}
        for first, raw, offsets in slices(pa.array(texts, type=pa.string()), 64):
            w = Words(raw, offsets, separators)
            h, at = shingles(w)
            low = bytes(raw).translate(bytes(range(256)))
            for i in range(len(offsets) - 1):
                a, b = w.first[i], w.first[i + 1]
                got = [low[s:e].decode().translate(H.LOWER) for s, e in zip(w.start[a:b], w.end[a:b], strict=True)]
                assert got == H.words(texts[first + i], pattern)
                want = H.shingle_set(texts[first + i], pattern)
                mine = np.unique(h[at[i] : at[i + 1]])
                assert len(mine) == len(want)
                for s in want:
                    seen.setdefault(s, set()).add(frozenset(mine.tolist()))
        assert all(len(v) >= 1 for v in seen.values())


def plain_stats(text):
    text = text or ""
    w = H.words(text, lower=False)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if H.WHITE.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct_words": len(set(w))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT, st.text(max_size=30)), min_size=1, max_size=6))
def test_statistics(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    for first, raw, offsets in slices(pa.array(texts, type=pa.string()), 50):
        got = text_stats(raw, offsets)
        for i in range(len(offsets) - 1):
            want = plain_stats(texts[first + i])
            assert {k: int(got[k][i]) for k in want} == want


def test_statistics_of_hard_texts():
    texts = [t for _, t in H.HARD]
    for first, raw, offsets in slices(pa.array(texts, type=pa.string())):
        got = text_stats(raw, offsets)
        for i in range(len(offsets) - 1):
            want = plain_stats(texts[first + i])
            assert {k: int(got[k][i]) for k in want} == want
