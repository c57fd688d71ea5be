"""Lines, values and blocks that repeat: counting, dictionaries, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.arrays import pieces
from millrace.operators.grams import best


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line, with its number from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def counts(values: DataFrame, value: str) -> DataFrame:
    """How often each value occurs; combined before the shuffle."""
    return values.groupBy(value).agg(F.count("*").alias("cnt"))


def ranked(df: DataFrame, order: list[Column], most: int, name: str = "idx") -> DataFrame:
    """The first ``most`` rows with their rank from 0. The global sort is a top-k of bounded size, so that ranking runs on it alone."""
    return df.orderBy(*order).limit(most).withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1).cast("int"))


def line_dictionary(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 255, least_bytes: int = 4) -> DataFrame:
    """The lines worth a dictionary entry: they repeat, and have more than three bytes; most bytes saved first."""
    c = counts(lines(docs, key, text).where(F.octet_length("line") >= least_bytes), "line").where("cnt > 1")
    c = c.withColumn("saving", (F.col("cnt") * F.octet_length("line")).cast("bigint"))
    return ranked(c, [F.desc("saving"), F.asc("line")], most)


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_bytes: int = 20) -> DataFrame:
    """Repeated lines of 20 bytes or more and the bytes that a four-byte reference saves."""
    c = counts(lines(docs, key, text).where(F.octet_length("line") >= least_bytes), "line").where("cnt >= 2")
    n = F.octet_length("line")
    return c.withColumn("saving", (F.col("cnt") * n - n - 4 * F.col("cnt")).cast("bigint")).where("saving > 0")


def encode_references(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each line as an index into the dictionary (at most 255 rows, so it is broadcast) or as itself."""
    d = F.broadcast(dictionary.select("line", "idx"))
    return lines(docs, key, text).join(d, "line", "left").select(key, "line_no", "idx", F.when(F.col("idx").isNull(), F.col("line")).alias("literal"))


def decode_references(encoded: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """The texts again. The lines of one text are gathered, never those of several."""
    d = F.broadcast(dictionary.select("idx", "line"))
    out = encoded.join(d, "idx", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", F.coalesce("literal", "line").alias("line")))).alias("l"))
    return out.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def blocks(docs: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """Non-overlapping blocks of each size; a shorter rest isn't a block."""
    sized = F.array(*(F.struct(F.lit(n).alias("block_size"), pieces(F.col(text), n).alias("b")) for n in sizes))
    return docs.select(F.explode(sized).alias("s")).select("s.block_size", F.explode("s.b").alias("block"))


def block_dedup(docs: DataFrame, text: str = "text", sizes: list[int] | None = None) -> DataFrame:
    """For each block size: distinct and repeated blocks and what a dictionary of them would save.

    Blocks are keyed by a 128-bit digest, so what is shuffled doesn't grow with the block size."""
    b = blocks(docs, text, sizes or [16, 32, 64, 128, 256, 512, 1024]).select("block_size", F.md5("block").alias("digest"))
    g = b.groupBy("block_size", "digest").agg(F.count("*").alias("n"))
    out = g.groupBy("block_size").agg(F.count("*").alias("uniq"), F.sum("n").alias("total"))
    return out.withColumn("dup", F.col("total") - F.col("uniq")).withColumn("saving", F.col("dup") * (F.col("block_size") - 4) - F.col("uniq") * F.col("block_size"))


def words(docs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    return docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z]+"), F.lit(0))).alias("word")).where(F.length("word") >= least)


def word_dictionary(docs: DataFrame, text: str = "text", most: int = 8000) -> DataFrame:
    """Words by the bytes that a two-byte code saves: cnt * (len - 2) - 4."""
    c = counts(words(docs, text), "word").where("cnt > 1")
    c = c.withColumn("saving", (F.col("cnt") * (F.length("word") - 2) - 4).cast("bigint")).where("saving > 0")
    return c.orderBy(F.desc("saving"), "word").limit(most)


def bigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    w = F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z]+"), F.lit(0))
    pairs = docs.select(w.alias("w")).where(F.size("w") > 1).select(F.explode(F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: F.concat_ws(" ", a, b))).alias("bigram"))
    return counts(pairs, "bigram")


def mixed_dictionary(docs: DataFrame, text: str = "text", most: int = 250, most_words: int = 2000, most_bigrams: int = 500) -> DataFrame:
    """The ``most`` words and pairs of words by cnt * (len - 2), among the commonest words and the commonest pairs. Counts are over all texts; the top-k are bounded."""
    w = counts(words(docs, text), "word").select(F.col("word").alias("entry"), "cnt").orderBy(F.desc("cnt"), "entry").limit(most_words)
    b = bigrams(docs, text).select(F.col("bigram").alias("entry"), "cnt").orderBy(F.desc("cnt"), "entry").limit(most_bigrams)
    c = w.unionAll(b).withColumn("saving", (F.col("cnt") * (F.char_length("entry") - 2)).cast("bigint"))
    return c.orderBy(F.desc("saving"), "entry").limit(most)


def substrings(docs: DataFrame, text: str, strides: dict[int, int]) -> DataFrame:
    """All substrings of each length, at every so many characters."""
    sized = F.array(*(F.struct(F.lit(n).alias("n"), pieces(F.col(text), n, k).alias("g")) for n, k in strides.items()))
    return docs.select(F.explode(sized).alias("s")).select("s.n", F.explode("s.g").alias("gram"))


def ngram_savings(docs: DataFrame, text: str = "text", lengths: list[int] | None = None, least: int = 3, most: int = 100) -> DataFrame:
    """Substrings by what a dictionary entry saves: cnt * (n - 2) - (n + 6); the best ``most``."""
    c = counts(substrings(docs, text, dict.fromkeys(lengths or range(3, 17), 1)), "gram").where(F.col("cnt") >= least)
    n = F.char_length("gram")
    c = c.withColumn("saving", (F.col("cnt") * (n - 2) - (n + 6)).cast("bigint")).where("saving > 0")
    return c.orderBy(F.desc("saving"), "gram").limit(most)


def sampled_substrings(docs: DataFrame, text: str = "text", lengths: list[int] | None = None, most: int = 4000) -> DataFrame:
    """Long substrings at strides of a quarter of their length; the count is estimated as 1 + (k - 1) * stride. Runs jobs at once: only what may be among the best is shuffled."""
    strides = {n: max(1, n // 4) for n in lengths or [8, 16, 32, 64, 128]}

    def estimate(n: int, seen):
        return 1 + (seen - 1) * strides[n]

    c = best(docs, text, strides, lambda n, seen: estimate(n, seen) * (n - 3) - (n + 6), most)
    cnt = F.coalesce(*(F.when(F.col("n") == n, estimate(n, F.col("seen"))) for n in strides))
    return c.select("gram", "n", "seen", cnt.cast("bigint").alias("cnt"), F.col("worth").alias("saving"))


def byte_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adjacent bytes: the counting step of byte-pair encoding."""
    p = docs.select(F.explode(pieces(F.hex(F.encode(F.col(text), "utf-8")), 4, 2)).alias("p"))
    return p.groupBy("p").agg(F.count("*").alias("cnt")).select(F.conv(F.substring("p", 1, 2), 16, 10).cast("int").alias("b0"), F.conv(F.substring("p", 3, 2), 16, 10).cast("int").alias("b1"), "cnt")


def byte_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    b = docs.select(F.explode(pieces(F.hex(F.encode(F.col(text), "utf-8")), 2)).alias("b"))
    return b.groupBy("b").agg(F.count("*").alias("cnt")).select(F.conv("b", 16, 10).cast("int").alias("byte"), "cnt")


#: Variable fields of log lines: dates, times, addresses, numbers.
VARIABLES = r"\d{4}-\d{2}-\d{2}|\d{2}:\d{2}:\d{2}(?:[.,]\d+)?|\d+\.\d+\.\d+\.\d+|\d+(?:\.\d+)?"


def templates(texts: DataFrame, text: str = "text") -> DataFrame:
    """Lines with their variable fields replaced by ``{}``, and how many fields a template has."""
    t = texts.select(F.explode(F.split(text, "\n")).alias("line")).where("line <> ''")
    t = t.select(F.regexp_replace("line", VARIABLES, "{}").alias("template"), F.regexp_count("line", F.lit(VARIABLES)).alias("vars"))
    return t.groupBy("template").agg(F.count("*").alias("cnt"), F.max("vars").cast("int").alias("vars"))


def log_fields(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The typed fields of each line: dates first, then times, addresses and numbers in what is left."""
    line = lines(texts, key, text)
    kinds = [("date", r"\d{4}-\d{2}-\d{2}"), ("time", r"\d{2}:\d{2}:\d{2}"), ("ip", r"\d+\.\d+\.\d+\.\d+"), ("num", r"\d+(?:\.\d+)?")]
    rest, found = F.col("line"), []
    for kind, p in kinds:
        found.append(F.regexp_extract_all(rest, F.lit(p), F.lit(0)))
        rest = F.regexp_replace(rest, p, "\u0001")
    out = line.select(key, "line_no", *(f.alias(k) for f, (k, _) in zip(found, kinds, strict=True)))
    pairs = F.concat(*(F.transform(k, _tagged(k)) for k, _ in kinds))
    return out.select(key, "line_no", F.explode(pairs).alias("f")).select(key, "line_no", "f.kind", "f.value")


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def first_difference(a: Column, b: Column) -> Column:
    """The position from 1 of the first character in which two texts differ, 0 if they are equal.

    Halving the range keeps the work linear in the length: equal prefixes are compared as whole strings."""
    n = F.least(F.char_length(a), F.char_length(b))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        same = F.substr(s["a"], F.lit(1), mid) == F.substr(s["b"], F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid).alias("hi"), s["a"].alias("a"), s["b"].alias("b"))

    # the longest equal prefix has between lo and hi - 1 characters
    start = F.struct(F.lit(0).alias("lo"), (n + 1).alias("hi"), a.alias("a"), b.alias("b"))
    found = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(n + F.lit(2))).cast("int")), start, halve, lambda s: s["lo"])
    return F.when(a == b, 0).otherwise(found + 1)
