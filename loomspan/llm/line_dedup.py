"""Line dedup over windows of three lines.

A window is three consecutive lines that aren't blank, compared after trimming spaces, tabs and carriage returns. The
occurrence with the smallest (id, position) stays; the lines of every later one go, with blank lines between them, and
overlapping windows merge, as their lines are united. All of it is built-in expressions: one exchange of window hashes
with map-side aggregation finds the repeated ones, a join whose hot hashes Spark can split finds the later
occurrences, and only line numbers travel to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import named
from loomspan.plans.shared import materialize

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """(id, first, last, h1, h2): the lines' numbers from 0 and 128 bits of hash of each window. Texts of fewer lines have none."""
    solid = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(F.trim(x, F.lit(" \t\r")).alias("t"), i.alias("i"))), lambda x: x["t"] != "")
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).where("id is not null and text is not null").select("id", solid.alias("s")).where(F.size("s") >= lines)
    at = lambda k, j: F.get(F.col("s"), k + j)
    parts = lambda k: [at(k, j)["t"] for j in range(lines)]
    made = F.transform(F.sequence(F.lit(0), F.size("s") - lines), lambda k: F.struct(at(k, 0)["i"].alias("first"), at(k, lines - 1)["i"].alias("last"), F.xxhash64(*parts(k)).alias("h1"), F.xxhash64(F.lit(1), *parts(k)).alias("h2")))
    return rows.select("id", F.inline(made))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """(id, gone array<int>): numbers of the lines to remove, for documents that have any. Rows of one id count as one
    document: an occurrence at the same place isn't a later one."""
    found = materialize(windows(docs, id_col, text_col, lines), "windows")
    firsts = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "first")).alias("kept"), F.max(F.struct("id", "first")).alias("latest")).where("kept <> latest").select("h1", "h2", "kept")
    later = found.join(firsts, ["h1", "h2"]).where(F.struct("id", "first") != F.col("kept"))
    spans = later.groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return spans.select("id", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))).alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES, counts: tuple[str, str] | None = ("lines_total", "lines_removed"), drop_emptied: bool = False) -> DataFrame:
    """``docs`` with later occurrences cut from the text, and the ``counts`` of lines before and of lines removed added, unless
    None is given for them; a column of ``docs`` that has such a name gives way to the count. Other names don't clash: what is
    carried along travels in a struct. Null texts stay null with 0 lines, texts without a line that isn't blank are whole, and so
    are texts of a null id. Of equal windows the one of the smallest (id, line) stays. Rows that repeat an id count as one document,
    so equal ones stay equal. Texts of any length are split whole. Which rows there are doesn't change, unless ``drop_emptied``: then
    those go of which a cut leaves nothing but white space."""
    gone = removed_lines(docs, id_col, text_col, lines)
    taken = {c.lower() for c in counts or ()}
    others = [c for c in docs.columns if c not in (id_col, text_col) and c.lower() not in taken]
    rows = docs.select(named(id_col).alias("key"), named(text_col).alias("text"), F.struct(F.lit(None).cast("int"), *map(named, others)).alias("others"))
    split = _lines(F.col("text"))
    rows = rows.join(gone.withColumnRenamed("id", "key"), "key", "left").withColumn("lines", F.when(F.col("gone").isNotNull(), split))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    # ``lines`` is named twice, which keeps the optimizer from splitting the text anew for every line.
    text = F.when(F.col("gone").isNull(), F.col("text")).when(F.size("lines") == F.size("gone"), F.lit("")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    total, removed = F.coalesce(F.size(split), F.lit(0)).cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    rows = rows.select("key", "others", text.alias("text"), total.alias("total"), removed.alias("removed"))
    if drop_emptied:
        rows = rows.where((F.col("removed") == 0) | F.col("text").rlike(r"\S"))
    place = {id_col: F.col("key"), text_col: F.col("text")} | {c: F.col("others").getField(c) for c in others}
    out = [place[c].alias(c) for c in docs.columns if c in place]
    return rows.select(*out, *([F.col("total").alias(counts[0]), F.col("removed").alias(counts[1])] if counts else []))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays; null counts as empty) for every document."""
    from loomspan.llm.common import table

    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
with line as (
  select doc_id, i - 1 as i, ls[i] as l, trim(ls[i], e' \t\r') as t
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, e'\n') as ls from documents where text is not null))),
solid as (select doc_id, i, t, lead(t) over w as t2, lead(t, 2) over w as t3, lead(i, 2) over w as last from line where t <> '' window w as (partition by doc_id order by i)),
win as (select *, row_number() over (partition by t, t2, t3 order by doc_id, i) as occurrence from solid where t3 is not null),
gone as (select distinct doc_id, unnest(range(i, last + 1)) as i from win where occurrence > 1),
kept as (
  select doc_id, count(*) as n_lines, count(g.i) as n_removed, string_agg(l, e'\n' order by line.i) filter (where g.i is null) as text
  from line left join gone g using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from documents left join kept using (doc_id)
"""
