"""Source trees: listing, decoding, root and entry choice, graphics, fingerprints."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from loomspan.functions import text as T
from loomspan.functions.groups import streamed

# Names that aren't entry files, folders that don't hold them, image endings in order of preference.
NOT_ENTRIES = r"(?i)^(?:macros|preamble|defs|appendix\d*|references)$"
NOT_ENTRY_FOLDERS = ("figures", "sections", "fig", "img", "images")
TEX_FOLDERS = ("tex source", "tex-source", "texsource")
IMAGE_ENDINGS = ["", ".pdf", ".png", ".jpg", ".jpeg", ".PDF", ".PNG", ".JPG"]
MACRO_FILES = ("macros.tex", "preamble.tex", "defs.tex", "commands.tex")
SCHEMA_VERSION = 1


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of all files under a root; unread columns aren't loaded."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length", "content")


@F.pandas_udf(StringType())
def decode(content: pd.Series) -> pd.Series:
    """UTF-8 with replacement, without byte-order mark, in normal form C, which no built-in offers."""
    return content.map(lambda b: None if b is None else unicodedata.normalize("NFC", bytes(b).decode("utf-8", "replace").removeprefix("\ufeff")))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def tex_root(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, root): the first folder named like "tex source" that has a .tex file at any depth; else the folder with most .tex files below, the
    shallower of equals. The data folder itself is the empty root."""
    tex = files.where(F.col("path").endswith(".tex")).select(id_col, "path")
    parts = F.split("path", "/")
    ups = tex.select(id_col, F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("root"))
    # one row a folder and document, whatever the number of its files
    counts = ups.groupBy(id_col, "root").agg(F.count(F.lit(1)).alias("n"))
    named = F.lower(F.translate(base_name(F.col("root")), "_", " ")).isin(*TEX_FOLDERS)
    rank = F.struct((~named).alias("a"), F.when(named, F.lit(0)).otherwise(-F.col("n")).alias("b"), F.when(named, F.lit(0)).otherwise(F.length("root") - F.length(F.translate("root", "/", "")) + (F.col("root") != "").cast("int")).alias("c"), F.col("root").alias("d"))
    return counts.groupBy(id_col).agg(F.min_by("root", rank).alias("root"))


def under_root(files: DataFrame, roots: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The files below their document's root, with paths relative to it."""
    rows = files.join(roots, id_col).where((F.col("root") == "") | F.startswith("path", F.concat("root", F.lit("/"))))
    relative = F.when(F.col("root") == "", F.col("path")).otherwise(F.substr("path", F.length("root") + 2))
    return rows.withColumn("path", relative).drop("root")


def entry_point(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, entry) from (id, path, text): files with a document class first, then names that look like a main file, more inputs, larger size, path."""
    name = F.regexp_replace(base_name(F.col("path")), r"\.tex$", "")
    inside = F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*map(F.lit, NOT_ENTRY_FOLDERS)))
    main = F.col("text").rlike(r"(?m)^\s*\\documentclass\b")
    inputs = F.regexp_count("text", F.lit(r"\\(?:input|include|subfile)\s*\{[^}]+\}"))
    rank = F.struct((~main).alias("a"), (name.rlike(NOT_ENTRIES) | inside).alias("b"), (-inputs).alias("c"), (-F.octet_length("text")).alias("d"), F.col("path").alias("e"))
    return files.groupBy(id_col).agg(F.min_by("path", rank).alias("entry"))


def macro_sources(files: DataFrame, entries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, turn, text): the usual macro files at the root in their order, all style files by path, and the entry before its
    \\begin{document}. ``turn`` is a text that sorts so."""
    place = F.array_position(F.array(*map(F.lit, MACRO_FILES)), F.col("path"))
    fixed = files.where(F.col("path").isin(*MACRO_FILES)).select(id_col, F.concat(F.lit("1 "), place.cast("string")).alias("turn"), "text")
    styles = files.where(F.col("path").endswith(".sty")).select(id_col, F.concat(F.lit("2 "), "path").alias("turn"), "text")
    begin = F.instr("text", "\\begin{document}")
    head = files.join(entries, id_col).where("path = entry").select(id_col, F.lit("3").alias("turn"), F.when(begin > 1, F.substr("text", F.lit(1), begin - 1)).otherwise(F.col("text")).alias("text"))
    return fixed.unionByName(styles).unionByName(head)


def graphics_paths(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, turn, folder): the folders that \\graphicspath names, in order."""
    lists = F.flatten(F.transform(F.regexp_extract_all(text_col, F.lit(r"\\graphicspath\s*\{((?:\s*\{[^{}]*\})+)\s*\}"), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(r"\{([^{}]+)\}"), F.lit(1))))
    return texts.select(id_col, F.posexplode(lists).alias("turn", "f")).select(id_col, "turn", F.regexp_replace(T.strip(F.col("f")), "^\\./|/$", "").alias("folder"))


def resolve_figures(figures: DataFrame, files: DataFrame, folders: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, label, tex_path, resolved_path): the first existing of root and graphics folders times image endings, else any image of the same stem."""
    bases = folders.select(id_col, (F.col("turn") + 2).alias("b"), "folder").unionByName(figures.select(id_col).distinct().select(id_col, F.lit(0).alias("b"), F.lit("").alias("folder")))
    ending = F.posexplode(F.array(*map(F.lit, IMAGE_ENDINGS)))
    tried = figures.select(id_col, "label", "tex_path").join(bases, id_col).select(id_col, "label", "tex_path", "b", "folder", ending.alias("e", "ending"))
    path = F.concat(F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/"))), F.regexp_replace("tex_path", "^\\./", ""), "ending")
    have = files.select(id_col, F.col("path").alias("resolved_path"))
    exact = tried.withColumn("resolved_path", path).join(have, [id_col, "resolved_path"]).groupBy(id_col, "label").agg(F.min_by("resolved_path", F.struct("b", "e")).alias("one"))
    stem = lambda p: F.regexp_replace(base_name(p), r"\.[^.]*$", "")
    images = have.where(F.lower("resolved_path").rlike(r"\.(?:pdf|png|jpe?g)$")).groupBy(id_col, stem(F.col("resolved_path")).alias("stem")).agg(F.min("resolved_path").alias("other"))
    rows = figures.select(id_col, "label", "tex_path", stem(F.col("tex_path")).alias("stem")).join(exact, [id_col, "label"], "left").join(images, [id_col, "stem"], "left")
    return rows.select(id_col, "label", "tex_path", F.coalesce("one", "other").alias("resolved_path"))


def fingerprint(files: DataFrame, id_col: str = "doc_id", version: int = SCHEMA_VERSION) -> DataFrame:
    """(id, fingerprint, n_files): 16 hex digits of SHA-256 over the version and each file's path and bytes, sorted by path. A document's
    own files meet in one task; they are hashed as they stream by."""

    def one(rows: Iterator[tuple]) -> tuple[str, int]:
        h, n = hashlib.sha256(f"v{version}\0".encode()), 0
        for path, content in rows:
            h.update(path.encode() + b"\0")
            h.update(b"<unreadable>" if content is None else content)
            h.update(b"\0")
            n += 1
        return h.hexdigest()[:16], n

    return streamed(files.select(id_col, "path", "content"), id_col, ["path"], one, [StructField("fingerprint", StringType()), StructField("n_files", LongType())])


def fingerprint_of_one(path: Column, content: Column, version: int = SCHEMA_VERSION) -> Column:
    """What ``fingerprint`` gives for an article of this one file, without bringing files together."""
    zero = F.unhex(F.lit("00"))
    whole = F.concat(F.encode(F.lit(f"v{version}"), "utf-8"), zero, F.encode(path, "utf-8"), zero, F.coalesce(content, F.encode(F.lit("<unreadable>"), "utf-8")), zero)
    return F.substring(F.sha2(whole, 256), 1, 16)


def images(figures: DataFrame, files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, label, kind, image): the content of figures' image files and its media type. PDF pages would have to be rendered, which
    nothing here does, so they have none, like figures whose file isn't found."""
    ending = F.lower(F.regexp_extract("resolved_path", r"\.([^./]*)$", 1))
    kind = F.when(ending == "png", "image/png").when(ending.isin("jpg", "jpeg"), "image/jpeg")
    have = files.select(id_col, F.col("path").alias("resolved_path"), F.col("content").alias("image"))
    return figures.select(id_col, "label", "resolved_path", kind.alias("kind")).where("kind is not null").join(have, [id_col, "resolved_path"]).select(id_col, "label", "kind", "image")
