"""Timelines of texts: markers of time, labelled fields, events by time, character and chapter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks a time in a text, the part that names it in brackets.
TIME_MARKERS = [
    r"(?:Day|Night)\s+(\d+)",
    r"(\d+)\s+(?:days?|weeks?|months?|years?)\s+(?:later|ago|after|before)",
    r"(?:Morning|Afternoon|Evening|Night)\s+of\s+(?:Day\s+)?(\d+)",
    r"Chapter\s+(\d+)",
    r"\*\*(?:Timeline|Time|When):\*\*\s*(.+?)(?:\n|$)",
    r"\*\*Date:\*\*\s*(.+?)(?:\n|$)",
]
#: Labels of the lines that name characters.
CHARACTER_LABELS = [r"Characters?", r"(?:POV|Perspective)"]
PREVIEW = 200


def labelled(text: Column, label: str) -> Column:
    """What follows each ``**label:**`` up to the end of its line, in any case of the label."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\*\*{label}:\*\*[^\S\n]*([^\n]+)"), F.lit(1))


def time_markers(text: Column) -> Column:
    """All markers as (kind, marker): kind is the pattern's number from 0, marker the whole match; patterns in turn, matches from the left."""
    found = (F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){p}"), F.lit(0)), _kind(k)) for k, p in enumerate(TIME_MARKERS))
    return F.concat(*found)


def _kind(k: int):
    return lambda m: F.struct(F.lit(k).alias("kind"), F.trim(F.regexp_replace(m, r"\s+", " ")).alias("marker"))


def characters(text: Column) -> Column:
    """The names in lines of characters, split at commas, ``&`` and "and"; each once."""
    lists = reduce(lambda a, b: F.concat(a, b), (labelled(text, label) for label in CHARACTER_LABELS))
    names = F.flatten(F.transform(lists, lambda x: F.split(x, r"[,&]|\sand\s")))
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))


def chapter(text: Column, default: str = "Unknown") -> Column:
    """The first heading of level one."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^#\s+(.+?)\s*$", 1), F.lit("")), F.lit(default))


def timepoint(text: Column, default: str = "Unspecified") -> Column:
    """The first label of a time, else the default."""
    return F.coalesce(F.get(F.transform(labelled(text, "(?:Timeline|Time|When)"), lambda x: F.trim(x)), F.lit(0)), F.lit(default))


def events(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each text as an event: ``timepoint``, ``chapter``, ``characters`` and a ``preview`` of its first characters."""
    t = F.col(text)
    return docs.select(key, timepoint(t).alias("timepoint"), chapter(t).alias("chapter"), characters(t).alias("characters"), F.substring(t, 1, PREVIEW).alias("preview"))


def group_events(rows: DataFrame, key: str, by: str) -> DataFrame:
    """How many events each time, character or chapter has, its first event, and how many characters appear; ``by`` is timepoint, character or chapter.

    Counts are combined before they are shuffled; events themselves aren't gathered, since one chapter may hold most of them."""
    d = rows.withColumn("character", F.explode("characters")) if by == "character" else rows
    return d.groupBy(by).agg(F.count("*").alias("cnt"), F.min(key).alias("first_event"), F.max(F.size("characters")).alias("most_characters"))
