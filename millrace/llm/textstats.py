"""Statistics of whole texts, computed for a slice of texts at once."""

from __future__ import annotations

import numpy as np

from millrace.llm.wordhash import U, WHITE, Words, combine, mix

#: Counted symbols.
SYMBOL_CHARACTERS = "#*$%&|<>"

_SETS = {
    "chars": [b for b in range(256) if b & 0xC0 != 0x80],
    "white": np.flatnonzero(WHITE),
    "symbols": [ord(c) for c in SYMBOL_CHARACTERS],
    "upper": range(65, 91),
    "digits": range(48, 58),
    "marks": [ord(c) for c in "!?.,;:"],
}
_TABLES = {}
for _name, _bytes in _SETS.items():
    _TABLES[_name] = np.zeros(256, dtype=np.int32)
    _TABLES[_name][list(_bytes)] = 1

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words")


def _tally(doc: np.ndarray, n: int, which: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc if which is None else doc[which], minlength=n).astype(np.int64)


def _repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items (text, key): which occur twice or more in their text, and which equal an earlier one."""
    both = mix(key + doc.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    same = both[order[1:]] == both[order[:-1]]
    later, any_ = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return any_, later


def text_stats(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """FIELDS of each text.

    Words are runs of characters other than ASCII white space. ``n_repeat_words``: words in
    windows of three words that occur twice or more in the text, the first included.
    ``n_dup_lines``: lines with a word that equal an earlier line of the text. ``n_lines``: lines
    with a word. Characters are code points. An empty text has zeros."""
    n = len(offsets) - 1
    words = Words(raw, offsets, WHITE, lower=False)
    out = {"n_words": words.counts.astype(np.int64)}
    sums = {}
    for name, table in _TABLES.items():
        run = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(table[raw], out=run[1:])
        sums[name] = run[offsets[1:]] - run[offsets[:-1]]
    out["word_chars"] = sums["chars"] - sums["white"]
    out["n_symbols"], out["n_upper"], out["n_digits"], out["n_marks"] = (sums[x] for x in ("symbols", "upper", "digits", "marks"))

    doc = np.repeat(np.arange(n), words.counts)
    h = words.hash
    if len(h) >= 3:
        whole = doc[2:] == doc[:-2]
        at = np.flatnonzero(whole)
        twice, _ = _repeats(doc[at], combine([h[at], h[at + 1], h[at + 2]], 3))
        covered = np.zeros(len(h), dtype=bool)
        for k in range(3):
            covered[at[twice] + k] = True
        out["n_repeat_words"] = _tally(doc, n, covered)
    else:
        out["n_repeat_words"] = np.zeros(n, dtype=np.int64)
    _, later = _repeats(doc, h)
    out["n_distinct_words"] = out["n_words"] - _tally(doc, n, later)

    breaks = np.flatnonzero(raw == 10)
    # each text has one line more than it has breaks; a break ends the line that starts before it
    line_doc = np.repeat(np.arange(n), np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1)
    starts = np.empty(len(line_doc), dtype=np.int64)
    ends = np.empty(len(line_doc), dtype=np.int64)
    heads = np.flatnonzero(np.diff(line_doc, prepend=-1))
    inner = np.ones(len(line_doc), dtype=bool)
    inner[heads] = False
    starts[heads], starts[inner] = offsets[:-1], breaks + 1
    tails = np.append(heads[1:] - 1, len(line_doc) - 1) if n else heads
    inner = np.ones(len(line_doc), dtype=bool)
    inner[tails] = False
    ends[tails], ends[inner] = offsets[1:], breaks
    filled = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    line_doc, starts, ends = line_doc[filled], starts[filled], ends[filled]
    _, later = _repeats(line_doc, words.spans(starts, ends))
    out["n_lines"], out["n_dup_lines"] = _tally(line_doc, n), _tally(line_doc, n, later)
    return {k: out[k] for k in FIELDS}


#: Ratios that models use; none depends on the id, the language or the source.
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "marks_per_word", "distinct_share", "words_per_line")


def ratios(s: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of each text as a matrix; a ratio to nothing is 0."""
    per = lambda a, b: s[a] / np.maximum(s[b], 1)
    return np.column_stack([s["n_words"].astype(float), per("word_chars", "n_words"), per("n_symbols", "n_words"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_upper", "word_chars"), per("n_digits", "word_chars"), per("n_marks", "n_words"), per("n_distinct_words", "n_words"), per("n_words", "n_lines")])
