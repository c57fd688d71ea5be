"""Line dedup: a log-template tree of fixed depth over the lines of all documents (operator 9).

A line is its tokens (bounded by white space). It goes down a tree of fixed depth: its number of tokens, its DEPTH
leading tokens, the first half of the other tokens, their second half. Two things are generalised on the way:

* a token with a digit or an ``@`` is a variable field, ``<*>``, at any place;
* at one of the three levels below the number of tokens a line may go through the wildcard branch, which
  takes any tokens of that level. A path with a wildcard is a template of its own if at least LEAST_CONSTANT tokens of it are
  constant, so lines merge in a leaf when the larger part of them agrees and what differs lies at one level.

So a line has up to five leaves: itself as it stands, itself with ``<*>`` fields, and one for each wildcard branch. A leaf
without a generalised field recurs when ``least_docs`` documents have it, one with such a field from ``least_docs_variable`` on, since
lines that differ in a number or a word can be different facts. A line goes from all documents but the first (that with the
smallest id) of each of its leaves that recur. Lines of fewer than ``least_tokens`` tokens are left alone: short sentences
recur by chance.

``keep``, which is for a pipeline that looks for near copies afterwards, goes on from there. When the lines that a document shares a
leaf with in one other document (their first) hold at least ``whole`` of the tokens of the longer of the two, the document is a copy of that one in the main, and
what the two share stays in both: else a fragment would be left that nothing can tie to its source. Its other recurring
lines go, as they go from the source. A document that loses lines and keeps less than ``least_left`` of its tokens goes.

Rows of (document, line, leaf) are written once. Their leaves are counted with partial sums in each task; leaves of one document
fall away against a bitmap of fixed size before the next shuffle, and in the end only documents that may lose a
line are shuffled with their texts: the others are read once more and go straight to the result. Everything is DataFrame functions.

Defined results: a null text stays null and has no lines, an empty text has one; documents without an
id count as one document whose lines are never the ones to stay; rows with the same id are one document
for the counts, each keeps or loses lines on its own; an empty table gives an empty result; extra
columns are ignored by ``dedup`` and kept by ``keep``. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.llm.bitmaps import bitmap, maybe_in
from millrace.llm.tables import written

DEPTH = 2
LEAST_TOKENS = 5
LEAST_CONSTANT = 5
LEAST_DOCS = 2
LEAST_DOCS_VARIABLE = 5
WHOLE = 0.5
LEAST_LEFT = 0.1

_WHITE = r"\x20\x09-\x0D"
_VARIABLE = rf"(?<![^{_WHITE}])[^{_WHITE}0-9@]*+[0-9@][^{_WHITE}]*+"
WILDCARD = "<*>"


def template(text: Column) -> Column:
    """Lines with their variable tokens generalised. White space bounds tokens and isn't touched, so a whole text gives what its lines give."""
    return F.when(F.regexp_like(text, F.lit("[0-9@]")), F.regexp_replace(text, _VARIABLE, WILDCARD)).otherwise(text)


def _plain(text: Column) -> Column:
    """The text with single spaces between the tokens of a line. A text whose only white space in lines is single spaces needs no regular expression."""
    odd = F.contains(text, F.lit("  "))
    for c in "\t\v\f\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)


def _count(line: Column) -> Column:
    """Tokens of a line with single spaces and none around."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _part(line: Column, n: Column) -> Column:
    """The first n tokens, or the last -n."""
    return F.call_function("substring_index", line, F.lit(" "), n)


def _leaves(t: Column, m: Column, n: Column) -> Column:
    """The leaves (hash, whether something is generalised) of a line ``t``, masked ``m``, of n tokens; null for those that it doesn't have."""
    end = F.floor((n - DEPTH + 1) / 2).cast("int")  # tokens of the last level
    leaf = lambda v, *path: F.struct(F.xxhash64(*path).alias("h"), F.lit(v).alias("v"))
    enough = lambda constant, x: F.when(constant >= LEAST_CONSTANT, x)
    return F.array(
        leaf(False, F.lit(0), t),
        F.when(F.contains(m, F.lit(WILDCARD)), leaf(True, F.lit(1), m)),
        enough(n - DEPTH, leaf(True, F.lit(2), n, _part(m, DEPTH - n))),
        enough(DEPTH + end, leaf(True, F.lit(3), n, _part(m, F.lit(DEPTH)), _part(m, -end))),
        enough(n - end, leaf(True, F.lit(4), n, _part(m, n - end))),
    )


def seen(docs: DataFrame, id_col: str, text_col: str, least_tokens: int, totals: bool = False) -> DataFrame:
    """A row for each line and leaf: ``id``, ``r`` (hash of id and text), ``pos`` of the line, ``n``, its tokens, ``total``, those of the document (``totals``: else null), ``h`` and ``v`` of the leaf."""
    text = F.col(text_col).cast("string")
    total = F.regexp_count(text, F.lit(rf"[^{_WHITE}]+")) if totals else F.lit(None).cast("int")
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("r"), total.alias("total"), _plain(text).alias("t"))
    d = d.select("id", "r", "total", F.split("t", "\n").alias("t"), F.split(template(F.col("t")), "\n").alias("m"))
    d = d.select("id", "r", "total", F.posexplode(F.arrays_zip("t", "m")).alias("pos", "x"))
    d = d.select("id", "r", "total", "pos", F.trim("x.t").alias("t"), F.trim("x.m").alias("m")).withColumn("n", _count(F.col("t"))).where(F.col("n") >= least_tokens)
    d = d.select("id", "r", "pos", "n", "total", F.explode(_leaves(F.col("t"), F.col("m"), F.col("n"))).alias("leaf"))
    return d.where("leaf is not null").select("id", "r", "pos", "n", "total", "leaf.*")


def shared(rows: DataFrame, totals: bool = False) -> DataFrame:
    """The rows of leaves that two or more documents have, with the smallest id (``first``) and, with ``totals``, how many tokens that one has."""
    keys = rows.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.isnull("id")).alias("none"))
    several = written(keys.where((F.col("first") != F.col("last")) | F.col("none") & F.col("first").isNotNull()).select("h", "first"))
    maybe = maybe_in(rows, F.col("h"), bitmap(several, "h")).where("__maybe").drop("__maybe")
    if totals:
        own = rows.groupBy(F.col("id").alias("first")).agg(F.min("total").alias("first_total"))
        several = written(several.join(own, "first"))
    return written(maybe.join(several, "h"))


def _copies(rows: DataFrame, whole: float) -> DataFrame:
    """``id``, ``r`` and ``main``, the document of which a document is a copy in the main."""
    lines = rows.where(~F.col("id").eqNullSafe(F.col("first"))).groupBy("id", "r", "first", "pos").agg(F.max("n").alias("n"), F.max(F.greatest("total", "first_total")).alias("total"))
    sums = lines.groupBy("id", "r", "first").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
    best = sums.where(F.col("n") >= whole * F.col("total")).groupBy("id", "r").agg(F.max(F.struct("n", "first")).alias("best"))
    return best.select("id", "r", F.col("best.first").alias("main"))


def lost_lines(docs: DataFrame, id_col: str, text_col: str, least_tokens: int, least_docs: int, least_docs_variable: int, whole: float | None) -> DataFrame:
    """``__id``, ``__r`` and ``__gone``, the positions of the lines that a document loses."""
    rows = shared(written(seen(docs, id_col, text_col, least_tokens, whole is not None)), whole is not None)
    counted = rows.groupBy("h", "v").agg((F.count_distinct("id") + F.max(F.isnull("id").cast("int"))).alias("docs"))
    often = written(counted.where(F.col("docs") >= F.when(F.col("v"), least_docs_variable).otherwise(least_docs)).select("h"))
    lost = rows.where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "r", "pos", "h", "first").join(often, "h", "left_semi")
    if whole is not None:
        main = _copies(rows, whole).select(F.col("id").alias("id2"), F.col("r").alias("r2"), "main")
        lost = lost.join(main, F.col("id").eqNullSafe(F.col("id2")) & (F.col("r") == F.col("r2")), "left").where(~F.col("first").eqNullSafe(F.col("main")))
    return lost.groupBy(F.col("id").alias("__id"), F.col("r").alias("__r")).agg(F.collect_set("pos").alias("__gone"))


def _marked(docs: DataFrame, id_col: str, text_col: str, *options) -> DataFrame:
    """``docs`` with ``__lines``, and for documents that lose some ``__kept``: those that stay."""
    gone = written(lost_lines(docs, id_col, text_col, *options))
    split = maybe_in(docs.withColumn("__row", F.xxhash64(id_col, F.col(text_col).cast("string"))), F.col("__row"), bitmap(gone, "__r"))
    touched = split.where("__maybe").join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__r")), "left").drop("__id", "__r", "__row", "__maybe")
    untouched = split.where("not __maybe").withColumn("__gone", F.lit(None).cast("array<int>")).drop("__row", "__maybe")
    lines = F.split(F.col(text_col).cast("string"), "\n")

    def stay(s: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"])
        return F.transform(places, lambda i: F.get(s["lines"], i))

    kept = F.when(F.col("__gone").isNotNull(), let(F.struct(lines.alias("lines"), F.col("__gone").alias("gone")), stay))
    return untouched.unionAll(touched).withColumn("__lines", lines).withColumn("__kept", kept)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_tokens: int = LEAST_TOKENS, least_docs: int = LEAST_DOCS, least_docs_variable: int = LEAST_DOCS_VARIABLE) -> DataFrame:
    """``n_lines``, ``n_dropped`` and the remaining ``text`` of each document."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    m = _marked(d, "id", "t", least_tokens, least_docs, least_docs_variable, None)
    n = F.when(F.col("t").isNull(), 0).otherwise(F.size("__lines")).cast("bigint")
    dropped = F.when(F.col("__kept").isNull(), 0).otherwise(F.size("__lines") - F.size("__kept")).cast("bigint")
    text = F.when(F.col("__kept").isNull(), F.col("t")).otherwise(F.array_join("__kept", "\n"))
    return m.select(F.col("id").alias(id_col), n.alias("n_lines"), dropped.alias("n_dropped"), text.alias("text"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_tokens: int = LEAST_TOKENS, least_docs: int = LEAST_DOCS, least_docs_variable: int = LEAST_DOCS_VARIABLE, whole: float | None = WHOLE, least_left: float = LEAST_LEFT) -> DataFrame:
    """The documents with the remaining text and all other columns as they are. Copies keep what they share with their source, documents with hardly a word left go."""
    m = _marked(docs, id_col, text_col, least_tokens, least_docs, least_docs_variable, whole)
    words = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + _count(F.trim(_plain(x))))
    m = m.where(F.col("__kept").isNull() | (words(F.col("__kept")) > 0) & (words(F.col("__kept")) >= least_left * words(F.col("__lines"))))
    text = F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    return m.withColumn("__text", text).select(*(F.col("__text").alias(c) if c == text_col else F.col(c) for c in docs.columns))
