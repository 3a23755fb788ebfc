"""Text expressions. White space is Unicode white space wherever the name says ``strip`` or ``squeeze``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space at either end; Spark's own trim knows spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def normalize_question(text: Column) -> Column:
    """Lower case, what isn't a word character to a space, runs of white space to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))


def is_no_answer(text: Column) -> Column:
    """Empty, or the refusal, whatever quotes and full stops are around it."""
    bare = F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(" .\"'`\n\t\r")))
    return (bare == "") | (bare == "no answer")


def has_cyrillic(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[\\u0400-\\u04FF]")


def between(text: Column, start: Column, end: Column) -> Column:
    """Half-open span of code points, places from 0."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def cut(text: Column, limit: int, mark: str = "") -> Column:
    """At most ``limit`` characters, with ``mark`` after what was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def pipes(items: Column) -> Column:
    """|a|b| or the empty string: the export form of a list of labels."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.concat(F.lit("|"), F.array_join(kept, "|"), F.lit("|"))).otherwise(F.lit(""))


def salvage_json(text: Column) -> Column:
    """The outermost braces of a reply, fences and prose around them dropped; null if there are none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def flatten_description(caption: Column, d: Column) -> Column:
    """Caption and parts of a figure's description, each with its name, joined by bars; empty parts are left out."""
    full = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")))
    texts = [full(k, d[k]) for k in ("subject", "axes_or_layout", "takeaway")]
    return F.concat_ws(" | ", full("Caption", caption), *texts, *[listed(k, d[k]) for k in ("key_visual_elements", "numbers_visible")])


def plain_base64(data: Column) -> Column:
    """Base64 on one line; Spark's own breaks it every 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")
