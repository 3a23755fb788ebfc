"""The article map: a bounded digest of a parsed document, assembled from one row's arrays without an exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T

ABSTRACT, CAPTION, DESCRIPTION, LATEX, MACRO, TOTAL = 1500, 200, 300, 200, 120, 16_000
EQUATIONS, LABELS, SECTIONS_OF_LABEL, MACROS, KEYWORDS = 30, 60, 8, 40, 8


def outline(sections: Column, keywords: Column) -> Column:
    """One line a section, indented by level; its ``keywords``, one list a section, under those of the first."""

    def lines(x: Column) -> Column:
        s = x["s"]
        indent = F.repeat(F.lit("  "), s["level"] - 1)
        head = F.concat(indent, F.lit("- **"), s["number"], F.lit(" "), s["title"], F.lit("**"), F.when(s["synthetic"], " *(synthetic)*").otherwise(""))
        words = F.array_join(F.slice(x["k"], 1, KEYWORDS), ", ")
        return F.when((s["level"] == 1) & (F.size(x["k"]) > 0), F.array(head, F.concat(indent, F.lit("  - Keywords: "), words))).otherwise(F.array(head))

    return F.flatten(F.transform(F.filter(F.arrays_zip(sections.alias("s"), keywords.alias("k")), lambda x: x["s"]["number"] != "0"), lines))


def _section(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"\n## {title}")), lines)).otherwise(F.array().cast("array<string>"))


#: Parts of the structure that the map shows.
PARTS = ("title", "authors", "sections", "keywords", "equations", "referenced")


def article_map(parsed: DataFrame, described: DataFrame | None = None, glossary: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, map). ``described`` (id, label, section_path, caption, description_text) and ``glossary`` (id, name, last) are gathered per
    document, already cut to what the map shows; all else is in the document's row."""
    rows = parsed
    empty = F.array().cast("array<string>")

    def gathered(df: DataFrame | None, line: Column, limit: int, name: str, order: str) -> None:
        nonlocal rows
        if df is None:
            rows = rows.withColumn(name, empty)
            return
        one = df.select(id_col, F.struct(F.col(order).alias("o"), line.alias("line")).alias("x")).groupBy(id_col).agg(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, limit), lambda x: x["line"]).alias(name))
        rows = rows.join(one, id_col, "left").withColumn(name, F.coalesce(name, empty))

    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")
    gathered(described, F.concat(F.lit("- **"), F.col("label"), F.lit("** (Section "), F.col("section_path"), F.lit(") — *Caption*: "), F.substring(F.coalesce(F.nullif(flat(F.col("caption")), F.lit("")), F.lit("(no caption)")), 1, CAPTION), F.when(~T.blank(F.col("description_text")), F.concat(F.lit(" — *Description*: "), F.substring(flat(F.col("description_text")), 1, DESCRIPTION))).otherwise("")) if described is not None else empty, 1_000_000, "__f", "label")
    gathered(glossary, F.concat(F.lit("- `\\"), F.col("name"), F.lit("` → `"), F.substring(T.squeeze(F.col("last")), 1, MACRO), F.lit("`")) if glossary is not None else empty, MACROS, "__m", "name")
    cited = F.transform(F.slice(F.sort_array("referenced"), 1, LABELS), lambda r: F.concat(F.lit("- "), r["label"], F.lit(" referenced from: "), F.array_join(F.transform(F.slice(r["sections"], 1, SECTIONS_OF_LABEL), lambda s: F.concat(F.lit("§"), s)), ", ")))
    size = F.length("text")
    head = F.array(F.lit("# Article Map"), F.lit("\n## Identity"), F.concat(F.lit("- **Title**: "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(unknown)"))))
    who = F.when(F.size("authors") > 0, F.array(F.concat(F.lit("- **Authors**: "), F.array_join("authors", ", ")))).otherwise(empty)
    length = F.array(F.concat(F.lit("- **Length**: "), size.cast("string"), F.lit(" chars / ~"), F.greatest(F.lit(1), F.floor(size / 1800)).cast("string"), F.lit(" chunks")))
    about = F.when(F.col("abstract") != "", F.array(F.concat(F.lit("- **Abstract**: "), F.substring(T.squeeze(F.col("abstract")), 1, ABSTRACT)))).otherwise(empty)
    formulas = F.transform(F.slice("equations", 1, EQUATIONS), lambda e: F.concat(F.lit("- **"), e["label"], F.lit("** (Section "), e["section"], F.lit(") — `"), F.substring(T.squeeze(e["latex"]), 1, LATEX), F.lit("`")))
    lines = F.concat(head, who, length, about, F.array(F.lit("\n## Outline")), outline(F.col("sections"), F.col("keywords")), _section("Figures", F.col("__f")), _section("Equations of Interest", formulas), _section("Cross-Reference Index", cited), _section("Defined Macros", F.col("__m")))
    return rows.select(id_col, T.cut(F.array_join(lines, "\n"), TOTAL, "\n\n[...truncated...]").alias("map"))
