"""Text expressions: tokens, cleaning, display width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is neither a letter, a mark, a number nor ``_`` in Unicode (``\\w`` alone is ASCII here).
NOT_WORD = r"[^\p{L}\p{M}\p{N}_\s]"
CJK = r"[一-鿿]"
WIDE = r"[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]"


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-cased words of at least ``least`` characters; a null text has none."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "), r"\s+")
    return F.filter(words, lambda w: F.char_length(w) >= least)


def ascii_words(text: Column) -> Column:
    """Runs of ASCII letters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z]+"), F.lit(0))


def clean(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def truncate(text: Column, n: int) -> Column:
    """``clean`` text, cut to n characters with an ellipsis as the last one."""
    c = clean(text)
    return F.when(F.char_length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…")))


def blank_to_null(text: Column) -> Column:
    """White space, no-break and zero-width spaces alone count as nothing."""
    return F.when(F.regexp_replace(text, r"[\s ​]+", "") == "", None).otherwise(text)


def display_width(text: Column) -> Column:
    """Characters, wide ones as 1.7."""
    return F.char_length(text) + 0.7 * F.regexp_count(text, F.lit(WIDE))




def majority_language(has_cjk: Column) -> Column:
    """Aggregate: ``zh`` if more than half of the rows have a CJK character, else ``en``."""
    return F.when(F.avg(has_cjk.cast("double")) > 0.5, "zh").otherwise("en")


def path_fields(path: Column) -> dict[str, Column]:
    """Date, slug and run number out of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    return {"date": F.try_to_date(F.substring(name, 1, 10), "yyyy-MM-dd"), "slug": F.regexp_extract(name, r"^(?:\d{4}-\d{2}-\d{2}-)?(.*?)(?:\.[A-Za-z0-9]+)?$", 1), "run": F.nullif(F.regexp_extract(path, r"run-(\d+)", 1), F.lit("")).cast("int")}


def visible(html: Column) -> Column:
    """Text without scripts, styles and tags (by patterns, not by a parser)."""
    no_code = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, r"<[^>]+>", " "), r"\s+", " "))
