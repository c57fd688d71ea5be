"""Audits of cell tables (sheet, row, column, value, formula), packages, names and page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Error values of spreadsheets.
ERRORS = ["#VALUE!", "#DIV/0!", "#REF!", "#NAME?", "#NULL!", "#NUM!", "#N/A"]
#: Functions that older versions lack.
FORBIDDEN = ["FILTER", "UNIQUE", "SORT", "SORTBY", "XLOOKUP", "XMATCH", "SEQUENCE", "LET", "LAMBDA", "RANDARRAY", "ARRAYFORMULA", "QUERY", "IMPORTRANGE"]
#: Lookups that need array entry in some programs.
IMPLICIT = [r"(?i)MATCH\s*\(\s*TRUE\s*\(\s*\)", r"(?i)MATCH\s*\(\s*TRUE\s*,", r"(?i)MATCH\s*\([^,]+[<>=!]+[^,]+,"]
RANGE = r"([A-Z]{1,3})(\d+):([A-Z]{1,3})(\d+)"
WORD = r"[\p{L}\p{M}\p{N}_]+"


def column_letters(n: Column) -> Column:
    """1 -> A, 27 -> AA; up to three letters."""
    letter = lambda i: F.expr("'ABCDEFGHIJKLMNOPQRSTUVWXYZ'").substr(i.cast("int") + 1, F.lit(1))
    a, b, c = (n - 1) % 26, F.floor((n - 27) / 26) % 26, F.floor((n - 703) / 676)
    return F.concat(F.when(n > 702, letter(c)).otherwise(""), F.when(n > 26, letter(b)).otherwise(""), letter(a))


def column_number(letters: Column) -> Column:
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda x: x != ""), F.lit(0), lambda s, x: s * 26 + F.ascii(x) - 64)


def parse_range(r: Column) -> Column:
    """Sheet (null if there is none) and the corners of ``Sheet!A1:F100`` or a single cell."""
    p = r"^(?:'?(.*?)'?!)?([A-Za-z]{1,3})(\d+)(?::([A-Za-z]{1,3})(\d+))?$"
    g = lambda i: F.regexp_extract(r, p, i)
    or_first = lambda i, j: F.when(g(i) == "", g(j)).otherwise(g(i))
    return F.struct(F.nullif(g(1), F.lit("")).alias("sheet"), column_number(g(2)).alias("min_col"), g(3).cast("int").alias("min_row"), column_number(or_first(4, 2)).alias("max_col"), or_first(5, 3).cast("int").alias("max_row"))


def within(cells: DataFrame, box: tuple[str | None, int, int, int, int]) -> DataFrame:
    sheet, c1, r1, c2, r2 = box
    d = cells.where(F.col("col").between(c1, c2) & F.col("row").between(r1, r2))
    return d if sheet is None else d.where(F.col("sheet") == sheet)


def structure(cells: DataFrame) -> DataFrame:
    """Rows, columns, data rows (the first row is the header), formulas and header names of each sheet."""
    heads = F.array_sort(F.collect_list(F.when(F.col("row") == 1, F.struct("col", F.col("value").alias("v")))))
    g = cells.groupBy("sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"), F.count_if(F.col("formula").isNotNull()).alias("formulas"), F.array_join(F.transform(heads, lambda x: F.coalesce(x["v"], F.lit(""))), ",").alias("headers"))
    return g.withColumn("data_rows", F.greatest(F.lit(0), F.col("rows") - 1))


def formula_audit(cells: DataFrame) -> DataFrame:
    """Formulas with an error value, a zero, or an implicit array."""
    f = cells.where(F.col("formula").isNotNull())
    error = F.coalesce(*(F.when(F.contains("value", F.lit(e)), e) for e in ERRORS))
    zero = F.when(F.expr("try_cast(value AS double)") == 0, "zero")
    implicit = F.when(F.regexp_like("formula", F.lit("|".join(IMPLICIT))), "implicit_array")
    return f.select("sheet", "row", "col", F.explode(F.array_compact(F.array(error, zero, implicit))).alias("finding"))


def reference_audit(cells: DataFrame) -> DataFrame:
    """Ranges far beyond the data, aggregates that include the header or few cells, formulas unlike the rest of their column."""
    f = cells.where(F.col("formula").isNotNull())
    size = cells.groupBy("sheet").agg(F.max("row").alias("last"))
    ends = F.transform(F.regexp_extract_all("formula", F.lit(RANGE), F.lit(4)), lambda x: x.cast("int"))
    d = f.join(size, "sheet")
    far = F.when(F.exists(ends, lambda e: (e > F.col("last") * 3) & (e > 100)), "out_of_range")
    head = F.when(F.regexp_like("formula", F.lit(r"(?i)(SUM|AVERAGE|AVG|COUNT|COUNTA|MIN|MAX|SUMPRODUCT)\s*\(\s*[A-Z]{1,3}1:")) & (F.col("row") > 1), "header_included")
    p = r"(?i)(?:SUM|AVERAGE|AVG|COUNT|COUNTA)\s*\(\s*[A-Z]{1,3}(\d+):[A-Z]{1,3}(\d+)\s*\)"
    few = F.exists(F.zip_with(F.regexp_extract_all("formula", F.lit(p), F.lit(1)), F.regexp_extract_all("formula", F.lit(p), F.lit(2)), lambda a, b: F.abs(b.cast("int") - a.cast("int")) + 1), lambda n: n <= 2)
    single = d.select("sheet", "row", "col", F.explode(F.array_compact(F.array(far, head, F.when(few, "small_aggregate")))).alias("finding"))
    norm = f.select("sheet", "row", "col", F.regexp_replace("formula", r"(\$?[A-Z]{1,3}\$?)\d+", "$1#").alias("pattern"))
    counts = norm.groupBy("sheet", "col", "pattern").agg(F.count("*").alias("n"))
    best = counts.groupBy("sheet", "col").agg(F.max(F.struct("n", "pattern")).alias("top"), F.sum("n").alias("all"))
    odd = norm.join(counts.join(best, ["sheet", "col"]).where("all >= 3 and pattern <> top.pattern and n <= 2 and n < top.n").select("sheet", "col", "pattern"), ["sheet", "col", "pattern"], "left_semi")
    return single.unionByName(odd.select("sheet", "row", "col", F.lit("inconsistent_pattern").alias("finding")))


def structural_issues(cells: DataFrame) -> DataFrame:
    f = cells.where(F.col("formula").isNotNull())
    forbidden = F.when(F.regexp_like(F.upper("formula"), F.lit(rf"\b({'|'.join(FORBIDDEN)})\s*\(")), "forbidden_function")
    external = F.when(F.regexp_like("formula", F.lit(r"\[[^\]]+\.xls[xmb]?\]")), "external_file_ref")
    text = F.when(~F.regexp_like(F.substr("formula", F.lit(2)), F.lit(r"[A-Za-z]+\(|\$?[A-Z]{1,3}\$?\d+|[0-9]")), "text_as_formula")
    return f.select("sheet", "row", "col", F.explode(F.array_compact(F.array(forbidden, external, text))).alias("finding"))


def duplicate_ids(ids: DataFrame, scope: list[str], key: str) -> DataFrame:
    return ids.groupBy(*scope, key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """References to what doesn't exist."""
    return references.join(targets.select(key).distinct(), key, "left_anti")


def page_indexes(spec: DataFrame, key: str, text: str, pages: Column) -> DataFrame:
    """``1-3,5`` as sorted distinct page indexes from 0; what lies outside the document goes."""
    part = spec.select(key, pages.alias("__n"), F.explode(F.split(text, ",")).alias("p")).withColumn("p", F.trim("p")).where(F.regexp_like("p", F.lit(r"^\d+(-\d+)?$")))
    lo = F.regexp_extract("p", r"^(\d+)", 1).cast("int")
    hi = F.coalesce(F.nullif(F.regexp_extract("p", r"-(\d+)$", 1), F.lit("")).cast("int"), lo)
    hi = F.least(hi, F.col("__n"))
    return part.where(lo <= hi).select(key, F.explode(F.sequence(lo, hi)).alias("page")).where("page >= 1").select(key, (F.col("page") - 1).alias("idx")).distinct()


def drift(a: Column, b: Column, most: float = 0.3) -> Column:
    """The second count is off by more than ``most`` of the first."""
    return (a > 0) & (F.abs(a - b) / a > most)


def name_variants(docs: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """Spellings of known names that differ from the name itself in capitals."""
    pairs = F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b{n}\b"), F.lit(0)), _pair(n)) for n in names))
    d = docs.select(key, F.explode(pairs).alias("p")).where("p.variant <> p.name")
    return d.groupBy(F.col("p.name").alias("name"), F.col("p.variant").alias("variant")).agg(F.count("*").alias("cnt"), F.count_distinct(key).alias("docs"))


def _pair(name: str):
    return lambda v: F.struct(F.lit(name).alias("name"), v.alias("variant"))


def contradictions(facts: DataFrame, entity: str, attribute: str, value: str) -> DataFrame:
    """Entities with several values of one attribute."""
    return facts.groupBy(entity, attribute).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def dialogue_problems(script: Column, host: str, guest: str, low: int, high: int, needed: list[str]) -> Column:
    """What is wrong with a dialogue: speaker tags, turns, length, elements, lines."""
    lines = F.split(script, "\n")
    n = F.char_length(F.regexp_replace(script, r"\s+", ""))
    turns = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(host)) | F.startswith(x, F.lit(guest))))
    return F.array_compact(F.array(
        F.when(~F.contains(script, F.lit(host)), "no host"), F.when(~F.contains(script, F.lit(guest)), "no guest"), F.when(turns < 8, "few turns"),
        F.when((n < low) | (n > high), "length"), *(F.when(~F.contains(script, F.lit(w)), f"no {w}") for w in needed),
        F.when(F.size(F.filter(lines, lambda x: F.trim(x) != "")) < 10, "few lines"),
    ))


def mentions(docs: DataFrame, key: str, text: str, names: DataFrame, name: str, pattern: str = WORD) -> DataFrame:
    """(key, name) of names of one or several words that occur in a text as whole words in any case; between its words a name stands as it is written.

    Words and what lies between them are tokens. A text's runs of as many tokens as some name has are joined with the names, so that the work grows with the
    text and the number of different lengths of names, not with text times names. Names without a word are never found."""
    token = F.lit(rf"(?s){pattern}|(?:(?!{pattern}).)+")
    pieces = lambda c: F.regexp_extract_all(F.lower(c), token, F.lit(0))
    n = names.select(F.col(name), F.lower(F.trim(name)).alias("__w"), F.size(pieces(F.trim(name))).alias("__n")).where(F.regexp_like("__w", F.lit(pattern))).distinct()
    lengths = sorted(r[0] for r in n.select("__n").distinct().collect())
    d = docs.select(key, pieces(F.col(text)).alias("__p"))
    run = lambda k: F.transform(F.sequence(F.lit(0), F.size("__p") - k), lambda i: F.array_join(F.slice("__p", i + 1, F.lit(k)), ""))
    runs = (F.when(F.size("__p") >= k, F.array_distinct(run(k))).otherwise(F.array().cast("array<string>")) for k in lengths)
    w = d.select(key, F.explode(F.flatten(F.array(*runs) if lengths else F.array().cast("array<array<string>>"))).alias("__w"))
    return w.join(n.select(name, "__w"), "__w").select(key, name).distinct()


def rank_in(df: DataFrame, group: list[str], order: list[Column]) -> Column:
    return F.row_number().over(W.partitionBy(*group).orderBy(*order))
