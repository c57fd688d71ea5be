"""Secret scans: fixed patterns and a battery of randomness tests (operator 2).

Base patterns are matched leftmost and without overlap, each kind on its own; matches that are too short
are dropped. The method then looks at every run of 20 or more characters of the usual encodings
that has a letter:

1. Encoding: the smallest alphabet (hexadecimal, base 32, base 36, base 62, base 64) that holds the run.
2. Battery: is the run what a uniform source over that alphabet gives? Chi-squared of the symbol
   counts, number of runs above and below the middle of the alphabet, serial correlation of neighbours. A run that
   fails a test at REJECT is not random.
3. False discoveries: the null hypothesis is an identifier made of words and numbers (NULL: what the three statistics are
   for such a one, by encoding). Each statistic's distance from that, in standard deviations of a run of this length, gives a z; their sum over
   COMBINED (they are correlated) gives a p-value. In each stratum (encoding and length class) Benjamini-Hochberg over all
   runs of the corpus bounds the share of false discoveries by RATE. p-values are binned (rounded up to
   a tenth of a power of ten), so the corpus-wide step is a small grouped aggregation whose size is
   bounded by strata times bins; its thresholds come back as a scalar subquery.

Positions come from lengths: a split gives what lies between the matches of a pattern, an extraction the
matches. Offsets are sums of both, taken in chunks so that a text with many matches stays cheap.
Everything is DataFrame functions; no row is shuffled but the binned counts.

Defined results: a null text is an empty one, without spans; null or repeated ids are scanned row by
row (repeated rows count in the corpus-wide step as often as they occur); an empty table gives an empty result; extra
columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.arrays import let, matches

#: Base kinds in order, their patterns and least sizes.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more characters: its matches are whole runs
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 or more characters: likewise
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
_LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"  # without it a text has neither candidates nor hex matches
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, pattern, alphabet; the first that fits counts.
ENCODINGS = [
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", _UP + "234567"),
    ("base36", r"^[0-9a-z]+$", _DIGITS + _LOW),
    ("BASE36", r"^[0-9A-Z]+$", _DIGITS + _UP),
    ("base62", r"^[0-9A-Za-z]+$", _DIGITS + _UP + _LOW),
    ("base64", r"^[0-9A-Za-z+/]+$", _UP + _LOW + _DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", _UP + _LOW + _DIGITS + "-_"),
]
REJECT = 3.29  # z of 0.001, two-sided
#: Identifiers, by encoding: the chance that two symbols are equal, that two neighbours lie on both sides of the middle, and the
#: serial correlation. Measured on names joined from English words and numbers in several styles; on hexadecimal ones, mostly digits.
NULL = {
    "hex": (0.085, 0.40, 0.25),
    "HEX": (0.085, 0.40, 0.25),
    "base32": (0.058, 0.42, 0.27),
    "base36": (0.054, 0.48, 0.15),
    "BASE36": (0.045, 0.45, 0.25),
    "base62": (0.042, 0.25, 0.45),
    "base64": (0.050, 0.41, 0.30),
    "base64url": (0.050, 0.38, 0.28),
}
TRIPLES = 0.0008  # by how much three equal symbols are likelier than two pairs of them
COMBINED = 2.0  # standard deviation of the sum of the three z; the square root of three if they were independent
RATE = 0.05
BINS = 300


def _kind(spans: Column, name: str) -> Column:
    """Sortable by start and then kind."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(name)).alias("rank"), x["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def battery(token: Column) -> Column:
    """stratum, chi, runs, serial (z values against a uniform source; small ones look random), z (against identifiers; a large one looks random) and its p-value, binned (``bin``: tenths of -log10 p), of a run."""
    which = reduce(lambda w, e: F.when(F.regexp_like(e[1], F.lit(e[0][1])), F.lit(e[0][0])) if w is None else w.when(F.regexp_like(e[1], F.lit(e[0][1])), F.lit(e[0][0])), [(x, token) for x in ENCODINGS], None)
    alphabets = F.create_map(*(F.lit(v) for name, _, a in ENCODINGS for v in (name, a)))
    identifiers = F.create_map(*(v for name, x in NULL.items() for v in (F.lit(name), F.array(*map(F.lit, x)))))

    def parts(s: Column) -> Column:
        chars = F.filter(F.split(s["t"], ""), lambda c: c != "")
        return F.struct(s["t"].alias("t"), s["e"].alias("e"), s["a"].alias("a"), chars.alias("c"))

    def codes(s: Column) -> Column:
        return F.struct(s["t"].alias("t"), s["e"].alias("e"), F.length(s["a"]).alias("k"), s["c"].alias("c"), F.transform(s["c"], lambda c: F.instr(s["a"], c) - 1).alias("x"), F.size(s["c"]).cast("double").alias("n"))

    def neighbours(v: Column, fn) -> Column:
        return F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), fn)

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)

    def tests(s: Column) -> Column:
        n, k = s["n"], s["k"].cast("double")
        squares = total(F.transform(F.array_distinct(s["c"]), lambda c: F.pow(n - F.char_length(F.replace(s["t"], c, F.lit(""))), F.lit(2.0))))
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        above = total(neighbours(s["x"], lambda a, b: ((a * 2 >= s["k"]) != (b * 2 >= s["k"])).cast("double")))
        runs = (above - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        m = (k - 1) / 2
        spread = total(F.transform(s["x"], lambda a: (a - m) * (a - m)))
        correlation = total(neighbours(s["x"], lambda a, b: (a - m) * (b - m))) / spread
        serial = (correlation + 1 / n) * F.sqrt(n)
        equal, cross, rho = (F.try_element_at(F.try_element_at(identifiers, s["e"]), F.lit(i)) for i in (1, 2, 3))
        pairs = n * (n - 1) / 2
        z_chi = (equal * pairs - (squares - n) / 2) / F.sqrt(equal * (1 - equal) * pairs + 2 * pairs * (n - 2) * TRIPLES)
        z_runs = (above - (n - 1) * cross) / F.sqrt((n - 1) * cross * (1 - cross))
        z = (z_chi + z_runs + (rho - correlation) * F.sqrt(n)) / COMBINED
        stratum = F.concat(s["e"], F.when(n < 32, ":20").when(n < 48, ":32").when(n < 80, ":48").otherwise(":80"))
        return F.struct(stratum.alias("stratum"), chi.alias("chi"), runs.alias("runs"), serial.alias("serial"), z.alias("z"), _bin(z).alias("bin"))

    first = F.struct(F.rtrim(token, F.lit("=")).alias("t"), which.alias("e"), F.try_element_at(alphabets, which).alias("a"))
    return let(let(let(first, parts), codes), tests)


def _bin(z: Column) -> Column:
    """Tenths of -log10 of the upper tail of the normal distribution, rounded down, 0 to BINS.

    For z > 0 the tail is phi(z) * (t - t^3 ...) in the form of a polynomial in t = 1 / (1 + p z); at z <= 0 it is at least a half."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    log10 = (z * z / 2 + 0.9189385332046727) / 2.302585092994046 - F.log10(poly)
    return F.when(z > 0, F.least(F.lit(BINS), F.floor(log10 * 10))).otherwise(0).cast("int")


def _if(test: Column, found: Column) -> Column:
    """The matches of a pattern, which is only searched for where a cheaper test doesn't rule it out."""
    return F.when(test, found).otherwise(F.array().cast("array<struct<start:int,end:int,m:string>>"))


def _candidates(text: Column) -> Column:
    """start, end and battery of the runs that have an encoding and pass all tests of randomness."""
    spans = F.transform(_if(F.regexp_like(text, F.lit(_LONG)), matches(text, CANDIDATE)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["m"]).alias("b")))
    random = lambda b: (F.abs(b["runs"]) < REJECT) & (F.abs(b["serial"]) < REJECT) & (F.abs(b["chi"]) < REJECT)
    return F.filter(spans, lambda x: x["b"]["stratum"].isNotNull() & random(x["b"]))


def thresholds(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: a map from stratum to the least bin that Benjamini-Hochberg accepts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.explode(F.transform(matches(text, CANDIDATE), lambda x: battery(x["m"]))).alias("b")).where("b.stratum is not null")
    counts = every.groupBy(F.col("b.stratum").alias("stratum"), F.col("b.bin").alias("bin")).agg(F.count("*").alias("n"))
    total = W.partitionBy("stratum")
    ranked = counts.select("stratum", "bin", F.sum("n").over(total.orderBy(F.desc("bin"))).alias("rank"), F.sum("n").over(total).alias("m"))
    # the bin's largest p-value is 10 ** (-bin / 10)
    ok = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= RATE * F.col("rank") / F.col("m")).groupBy("stratum").agg(F.min("bin").alias("least"))
    return ok.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least"))).alias("least"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers of base matches, the digest of the base spans, all spans, and ``n_random``, how many the battery adds."""
    least = thresholds(docs, text_col).scalar()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), least.alias("__least"))
    long_enough = lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST
    t = F.col("__text")
    d = d.withColumns({
        "__assign": F.filter(_if(F.contains(t, F.lit(":")) | F.contains(t, F.lit("=")), matches(t, ASSIGN)), long_enough),
        "__access": _if(F.contains(t, F.lit("AKIA")), matches(t, ACCESS)),
        "__hex": _if(F.regexp_like(t, F.lit(_LONG)), matches(t, HEX)),
        "__random": F.filter(_candidates(F.col("__text")), lambda x: x["b"]["bin"] >= F.try_element_at(F.col("__least"), x["b"]["stratum"])),
    })
    d = d.withColumn("__base", F.concat(*(_kind(F.col(f"__{k}"), k) for k in KINDS[:3])))
    d = d.withColumn("__added", _kind(F.col("__random"), "random"))
    size = lambda c: F.size(c).cast("bigint")
    return d.select(F.col("__id").alias(id_col), size("__assign").alias("n_assign"), size("__access").alias("n_access"), size("__hex").alias("n_hex"), F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.concat("__base", "__added")).alias("spans"), size("__random").alias("n_random"))
