"""License scans: identifier tags, notice phrases and licence expressions (operator 6).

An Aho-Corasick automaton runs over the words of a whole text, joined by single spaces, and
finds every place of every phrase in one pass. Behind a licence identifier tag stands an expression; a
shunting-yard parser turns it into postfix order and evaluates it: ``and`` takes the least free side, ``or`` the
freest, ``with`` adds a little for the exception.

``score`` says how freely a text may be reused, as far as its notices tell: the least of all that are found,
0.5 if there are none.

Defined results: a null or empty text has no words, no places, empty labels and the score 0.5; rows
with null or repeated ids are scanned each on its own; an empty table gives an empty result; extra
columns are ignored; an expression that doesn't parse gives no label; of overlapping notices (``cc by`` in ``cc by nc``) each
gives its label. Texts are read whole.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notices: phrase -> label.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2": "apache-2.0",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "general public license version 3": "gpl-3.0",
    "general public license version 2": "gpl-2.0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "creative commons": "creative-commons",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}

#: How free a label or the beginning of an identifier is; the longest that fits counts.
FREEDOM = {"reserved": 0.0, "proprietary": 0.0, "cc-by-nd": 0.3, "cc-by-nc": 0.3, "agpl": 0.4, "gpl": 0.5, "cc-by-sa": 0.6, "lgpl": 0.6, "mpl": 0.7, "creative-commons": 0.7, "cc-by": 0.9, "apache": 1.0, "mit": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0}
UNKNOWN = 0.5
EXCEPTION = 0.1

TAG = "spdx license identifier"
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+()\- \t]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}

#: Lower-cases A-Z and turns all that isn't in a word into a space.
_WORDS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 65 <= b <= 90 else b for b in range(256))


def freedom(name: str) -> float:
    fits = [k for k in FREEDOM if name == k or name.startswith(k + "-")]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None if the expression is wrong."""
    out, stack, operand = [], [], True
    for token in _TOKEN.findall(expression):
        t = token.lower()
        if t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        else:
            if not operand:
                break  # prose behind the expression
            out.append(t)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[list[str], float] | None:
    """The identifiers of a licence expression and its freedom."""
    order = postfix(expression)
    if order is None:
        return None
    names, stack = [], []
    for t in order:
        if t not in _RANK:
            stack.append((t, freedom(t)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if t == "with":
            names.append(f"{left}-with-{right}")
            stack.append((None, min(1.0, a + EXCEPTION)))
            continue
        names += [x for x in (left, right) if x]
        stack.append((None, min(a, b) if t == "and" else max(a, b)))
    last, value = stack.pop()
    return names + [last] * (last is not None), value


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrases, base in ((NOTICES, False), (BASE, True)):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (label, base, len(phrase) + 2))
    out.add_word(f" {TAG} ", (None, False, 0))
    out.make_automaton()
    return out


def scan_text(text: str, found: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = text.encode().translate(_WORDS).split()
    line = f" {b' '.join(words).decode()} "
    places, labels, base_labels, tagged, score = [], set(), set(), False, None
    for end, (label, base, size) in found.iter(line):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        score = min(1.0 if score is None else score, freedom(label))
        if base:
            base_labels.add(label)
            places.append(end - size + 1)
    if tagged:
        for m in _TAGGED.finditer(text):
            if got := evaluate(m[1]):
                labels.update(got[0])
                score = min(1.0 if score is None else score, got[1])
    first, last = (line.count(" ", 0, f(places)) if places else None for f in (min, max))
    return len(words), len(places), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), UNKNOWN if score is None else score


FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``scan_text`` gives for each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        found = automaton()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [scan_text(t.as_py() or "", found) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[id_col, *(x.split()[0] for x in FIELDS.split(", "))])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")
