"""Chunks of parsed documents: bodies, captions, equations, section summaries and figure descriptions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import latex, structure

SIZE, OVERLAP = 1200, 150
EQUATION_CHARS, CHUNK_CHARS = 800, 1500
#: Where texts may be parted, coarse to fine; a separator stays with what follows it.
SEPARATORS = (r"(?=\\(?:chapter|section|subsection|subsubsection|paragraph)\b)", r"(?=\\begin\{(?:enumerate|itemize|description|list|quote|quotation|verse|verbatim|align|equation|gather)\*?\})", r"(?=\$\$)", r"(?<=\n)(?=\n)", r"(?<=\n)", r"(?<= )")
COLUMNS = ["chunk_id", "kind", "text", "section_path", "section_number", "section_top", "char_start", "char_end", "label_refs", "figure_refs", "equation_refs", "has_figure", "has_equation", "synthetic"]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters that cover the text, each beginning with at most ``overlap`` characters of the one before."""

    def parts(t: str, level: int) -> list[str]:
        if len(t) <= size - overlap:
            return [t] if t else []
        if level == len(SEPARATORS):
            step = size - overlap
            return [t[k : k + step] for k in range(0, len(t), step)]
        return [p for x in re.split(SEPARATORS[level], t) for p in parts(x, level + 1)]

    out, now = [], ""
    for part in parts(text, 0):
        if now and len(now) + len(part) > size:
            out.append(now)
            tail = now[-overlap:] if overlap else ""
            space = tail.find(" ")
            now = tail[space + 1 :] if 0 <= space < len(tail) - 1 else tail
            if len(now) + len(part) > size:
                now = now[len(now) + len(part) - size :]
        now += part
    return [*out, now] if now else out


def pieces(text: Column) -> Column:
    """array<struct<i, at, piece>>: the pieces of a text that aren't blank, with their number and the length of those before."""

    def run(texts: pa.Array) -> pa.Array:
        offsets, number, place, out = [0], [], [], []
        for t in texts.to_pylist():
            at = 0
            for i, p in enumerate(split_text(t or "") or [t or ""]):
                if p.strip():
                    number.append(i)
                    place.append(at)
                    out.append(p)
                at += len(p)
            offsets.append(len(out))
        columns = [pa.array(number, pa.int32()), pa.array(place, pa.int32()), pa.array(out, pa.string())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["i", "at", "piece"]))

    return F.arrow_udf(run, "array<struct<i:int,at:int,piece:string>>")(text)


def fixed_width(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The plain splitter in built-in expressions: windows of ``size`` every ``size - overlap`` characters."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def _row(kind: str, chunk_id: Column, text: Column, path: Column, number: Column, start: Column, end: Column, refs: Column, figures: Column, equations: Column, has_figure: Column, has_equation: Column, synthetic: Column) -> list[Column]:
    values = [chunk_id, F.lit(kind), text, path, number, structure.section_top(number), start.cast("int"), end.cast("int"), refs, figures, equations, has_figure, has_equation, synthetic]
    return [v.alias(n) for v, n in zip(values, COLUMNS, strict=True)]


def _none() -> Column:
    return F.array().cast("array<string>")


def body_chunks(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sections' texts, unwrapped and split; from the parts sections, bodies, figures and equations. Blank pieces go but keep their number;
    places are approximate, the section's start and the lengths of the pieces before."""
    labels = lambda c: F.transform(c, lambda x: x["label"])
    rows = parsed.select(id_col, labels("figures").alias("f"), labels("equations").alias("e"), F.inline(F.arrays_zip(F.col("sections").alias("s"), F.col("bodies").alias("body"))))
    rows = rows.where(~T.blank(F.col("body"))).withColumn("body", pieces(latex.strip_wrappers(F.col("body"))))
    rows = rows.select(id_col, "f", "e", "s", F.inline("body")).withColumn("refs", structure.refs_in(F.col("piece")))
    rows = rows.withColumns({"fr": F.array_intersect("refs", "f"), "er": F.array_intersect("refs", "e"), "at": F.col("s.char_start") + F.col("at")})
    return rows.select(id_col, *_row("body", F.concat(F.lit("body:"), F.col("s.number"), F.lit("#"), F.col("i").cast("string")), T.strip(F.col("piece")), F.col("s.path"), F.col("s.number"), F.col("at"), F.col("at") + F.length("piece"), F.col("refs"), F.col("fr"), F.col("er"), (F.size("fr") > 0) | structure.has_graphics(F.col("piece")), F.size("er") > 0, F.col("s.synthetic")))


def caption_chunks(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    rows = parsed.select(id_col, F.explode("figures").alias("f")).where("f.caption <> ''")
    one = F.array("f.label")
    return rows.select(id_col, *_row("caption", F.concat(F.lit("caption:"), F.col("f.label")), F.concat(F.lit("Figure "), F.col("f.label"), F.lit(": "), F.col("f.caption")), F.col("f.section_path"), F.col("f.section"), F.col("f.char_pos"), F.col("f.char_pos") + 1, one, one, _none(), F.lit(True), F.lit(False), F.lit(False)))


def equation_text(e: Column) -> Column:
    """The equation, cut, and what stands around it."""
    whole = F.concat(F.lit("eq "), e["label"], F.lit(": "), T.cut(e["latex"], EQUATION_CHARS, " ..."), F.lit("\nBefore: "), e["before"], F.lit("\nAfter: "), e["after"])
    return F.substring(whole, 1, CHUNK_CHARS)


def equation_chunks(parsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    rows = parsed.select(id_col, F.explode("equations").alias("e"))
    one = F.array("e.label")
    return rows.select(id_col, *_row("equation", F.concat(F.lit("equation:"), F.col("e.label")), equation_text(F.col("e")), F.col("e.section_path"), F.col("e.section"), F.col("e.char_pos"), F.col("e.char_pos") + F.length("e.latex"), one, _none(), one, F.lit(False), F.lit(True), F.lit(False)))


def summary_chunks(parsed: DataFrame, summaries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``summaries``: (id, number, dense_summary). Sections without a summary give none."""
    rows = parsed.select(id_col, F.explode("sections").alias("s")).withColumn("number", F.col("s.number")).join(summaries.where("dense_summary <> ''"), [id_col, "number"])
    return rows.select(id_col, *_row("section_summary", F.concat(F.lit("section_summary:"), F.col("number")), F.concat(F.lit("Section "), F.col("number"), F.lit(" "), F.col("s.title"), F.lit(": "), F.col("dense_summary")), F.col("s.path"), F.col("number"), F.col("s.char_start"), F.col("s.char_end"), _none(), _none(), _none(), F.lit(False), F.lit(False), F.col("s.synthetic")))


def description_chunks(described: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``described``: (id, label, section_path, description_text). The section is the path's first word; places are 0."""
    rows = described.where(~T.blank(F.col("description_text"))).withColumn("n", F.when(T.blank(F.col("section_path")), F.lit("")).otherwise(F.split_part(T.strip(F.regexp_replace("section_path", r"(?U)\s+", " ")), F.lit(" "), F.lit(1))))
    one = F.array("label")
    return rows.select(id_col, *_row("figure_desc", F.concat(F.lit("figure_desc:"), F.col("label")), F.concat(F.lit("Figure "), F.col("label"), F.lit(" description: "), F.col("description_text")), F.col("section_path"), F.col("n"), F.lit(0), F.lit(0), one, one, _none(), F.lit(True), F.lit(False), F.lit(False)))


#: Parts of the structure that chunks are made of.
PARTS = ("sections", "bodies", "figures", "equations")


def all_chunks(parsed: DataFrame, summaries: DataFrame | None = None, described: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """The bag union of all kinds."""
    out = body_chunks(parsed, id_col).unionByName(caption_chunks(parsed, id_col)).unionByName(equation_chunks(parsed, id_col))
    if summaries is not None:
        out = out.unionByName(summary_chunks(parsed, summaries, id_col))
    return out if described is None else out.unionByName(description_chunks(described, id_col))


def exported(chunks: DataFrame) -> DataFrame:
    """Lists of labels in the pipe form."""
    return chunks.withColumns({c: T.pipes(F.col(c)) for c in ("label_refs", "figure_refs", "equation_refs")})
