"""Brute-force versions of the operators, and rows that are hard to handle."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=WHITE, lower=True):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def shingle_set(text, pattern=WHITE, size=5):
    w = words(text, pattern)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def components(rows):
    """(id, number of shingles, smallest id of the component) of (id, text) rows, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * (n := len(a & b)) >= 75 * (len(a) + len(b) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), (least.get(find(i)) if s else k)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
#: Null ids and texts, empty and long texts, repeated rows, other alphabets, odd white space.
HARD = [
    (1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (4, " \t\n\r\x0b\x0c "), (None, "one two three four five six seven eight"),
    (None, None), (5, LONG), (6, LONG + " tail"), (7, "short"), (8, "short"), (9, "Ünï cödé – テスト 😀 text\u00a0with\u2003spaces"), (10, "a\x00b c"), (11, "line\nline\n\nline\r\nother line here now yes"), (12, "ONE TWO THREE FOUR FIVE SIX SEVEN"),
]


def frame(spark, rows, extra=True):
    """Rows as documents, with columns whose names operators use themselves."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    data = [(k, t, "en", None if i % 3 == 0 else f"src{i % 2}", None if t is None else len(t)) for i, (k, t) in enumerate(rows)]
    if extra:
        schema += ", score double, n_words string, node bigint, label int, __label string, kept boolean, hash binary"
        data = [(*r, 0.5, "x", 7, 1, "y", True, b"z") for r in data]
    return spark.createDataFrame(data, schema)


def labels(spark, rows, quality=lambda k: 1, toxic=lambda k: 0):
    return spark.createDataFrame([(k, quality(k), toxic(k)) for k, _ in rows if k is not None] + [(None, 1, 1), (99999, None, None)], "doc_id bigint, quality int, toxic int")
