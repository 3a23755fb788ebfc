"""Cleaning of LaTeX sources. Built-in expressions where the rule is regular; Arrow UDFs where it needs a stack or state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from loomspan.functions.groups import streamed
from loomspan.functions.spans import matches
from loomspan.plans.shared import bounded_batches

# Commands whose argument stays wrapped, and environments whose blank lines stay.
SAFE_COMMANDS = (
    "caption", "label", "ref", "eqref", "autoref", "cref", "Cref", "section", "subsection", "subsubsection", "paragraph", "title", "author", "abstract",
    "includegraphics", "begin", "end", "input", "include", "subfile", "newcommand", "renewcommand", "providecommand", "def", "graphicspath", "cite",
)
PROTECTED = r"(?:verbatim|lstlisting|align\*?|equation\*?|gather\*?|multline\*?)"
#: Possessive, so that a body that never closes fails at once.
_BODY = r"((?:[^{}]++|\{[^{}]*+\})*+)"
MACRO = r"\\(?:newcommand|renewcommand|providecommand)\*?\s*\{?\\(\w+)\}?\s*(?:\[(\d+)\])?\s*\{" + _BODY + r"\}"
DEF = r"\\def\\(\w+)\s*\{" + _BODY + r"\}"


def strip_comments(text: Column) -> Column:
    """Each line up to its first percent sign that no backslash precedes; line ends become \\n, a final one goes."""
    lines = F.regexp_replace(text, "\r\n|[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n\z", ""), r"(?m)(?<!\\)%.*$", "")


def remove_iffalse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\iffalse\b.*?\\fi\b", "")


def remove_bibliography(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}", "")


def strip_wrappers(text: Column) -> Column:
    """One pass of \\command{X} to X, X without braces. Safe commands' braces are private characters meanwhile: they stay,
    and don't keep what is around them from being unwrapped."""
    safe = "|".join(SAFE_COMMANDS)
    aside = F.regexp_replace(text, rf"(\\(?:{safe})(?![a-zA-Z])\*?)\{{([^{{}}]*)\}}", "$1\ue000$2\ue001")
    bare = F.regexp_replace(aside, r"\\[a-zA-Z]+\*?\{([^{}]*)\}", "$1")
    return F.translate(bare, "\ue000\ue001", "{}")


def collapse_blank_lines(text: pd.Series) -> pd.Series:
    """At most two blank lines in a row, lines without white space at their end; protected environments keep their blank lines as they are."""
    begin, end = re.compile(r"\\begin\{" + PROTECTED + r"\}"), re.compile(r"\\end\{" + PROTECTED + r"\}")

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        out, depth, blank = [], 0, 0
        for line in t.splitlines():
            depth += bool(begin.search(line))
            bare = line.rstrip()
            if bare or depth:
                out.append(bare or line)
                blank = 0 if bare else blank
            elif blank < 2:
                out.append("")
                blank += 1
            depth = max(0, depth - bool(end.search(line)))
        return "\n".join(out)

    return text.map(one)


_collapse = F.pandas_udf(collapse_blank_lines, StringType())


def normalize_whitespace(text: Column) -> Column:
    """A running state over lines: an Arrow UDF on the row, in batches bounded by bytes, rather than an exchange of all lines."""
    bounded_batches(SparkSession.active())
    return _collapse(text)


def macros(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """(id, source, place, name, arity, body, kind): every macro definition; arity is null where none is given. ``order_col`` sorts sources."""
    text = F.col(text_col)
    order = F.col(order_col) if order_col else F.lit(0)
    new = texts.select(id_col, order.alias("source"), F.inline(matches(text, MACRO, 3))).select(id_col, "source", F.col("start").alias("place"), F.col("g1").alias("name"), F.col("g2").cast("int").alias("arity"), F.col("g3").alias("body"), F.lit(0).alias("kind"))
    old = texts.select(id_col, order.alias("source"), F.inline(matches(text, DEF, 2))).select(id_col, "source", F.col("start").alias("place"), F.col("g1").alias("name"), F.lit(None).cast("int").alias("arity"), F.col("g2").alias("body"), F.lit(1).alias("kind"))
    return new.unionByName(old)


def glossary(defined: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, name, last, first_plain, turn): the last definition names the macro in the glossary, the first that gives no number of arguments is
    put in its place in texts. Sources count in their order; within one, \\def comes after the others."""
    at = F.struct("source", "kind", "place")
    return defined.groupBy(id_col, "name").agg(F.max_by("body", at).alias("last"), F.min_by("body", F.when(F.col("arity").isNull(), at)).alias("first_plain"), F.min(F.when(F.col("arity").isNull(), at)).alias("turn"))


def inline_macros(text: Column, known: Column) -> Column:
    """``known``: array<struct<name, body>>, replaced one after the other as whole command names, bodies taken literally."""
    literal = lambda body: F.regexp_replace(body, r"([\\$])", r"\\$1")
    return F.aggregate(known, text, lambda t, m: F.regexp_replace(t, F.concat(F.lit(r"\\"), m["name"], F.lit("(?![a-zA-Z@])")), literal(m["body"])))


def clean(text: Column, known: Column | None = None) -> Column:
    """The fixed order: false conditionals, comments, macros, bibliography, white space."""
    out = strip_comments(remove_iffalse(text))
    if known is not None:
        out = inline_macros(out, known)
    return normalize_whitespace(remove_bibliography(out))


def expand_inputs(files: DataFrame, entries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the entry file with every \\input, \\include and \\subfile{X} replaced by that file's expanded text. ``files``
    (id, path, text), paths relative to the root; ``entries`` (id, entry). X.tex goes before X, the including file's folder before the
    root; a file that is missing, or was expanded before anywhere in the document, becomes nothing. A file's text is bounded by its
    document, so a document's files meet in one task."""
    pattern = re.compile(r"\\(?:input|include|subfile)\s*\{([^}]+)\}")

    def one(rows: Iterator[tuple]) -> tuple[str] | None:
        texts, entry, seen = {}, None, set()
        for is_entry, path, text in rows:
            if is_entry:
                entry = path
            else:
                texts[path] = text or ""
        if entry is None or not texts:
            return None

        def resolve(target: str, folder: str) -> str | None:
            for name in (target,) if target.endswith(".tex") else (target + ".tex", target):
                for base in (folder, ""):
                    parts: list[str] = []
                    for p in f"{base}/{name}".split("/"):
                        if p == ".." and parts:
                            parts.pop()
                        elif p not in ("", ".", ".."):
                            parts.append(p)
                    if (path := "/".join(parts)) in texts:
                        return path
            return None

        out: list[str] = []
        # An explicit stack of (path, text, place): includes may be nested as deep as there are files.
        seen.add(entry)
        stack = [(entry, texts.get(entry, ""), 0)]
        while stack:
            path, text, at = stack.pop()
            m = pattern.search(text, at)
            if not m:
                out.append(text[at:])
                continue
            out.append(text[at : m.start()])
            stack.append((path, text, m.end()))
            found = resolve(m[1].strip(), path.rpartition("/")[0])
            if found is not None and found not in seen:
                seen.add(found)
                stack.append((found, texts[found], 0))
        return ("".join(out),)

    rows = files.select(id_col, F.lit(False).alias("is_entry"), "path", "text")
    rows = rows.unionByName(entries.select(id_col, F.lit(True).alias("is_entry"), F.col("entry").alias("path"), F.lit(None).cast("string").alias("text")))
    return streamed(rows.where(F.col(id_col).isNotNull()), id_col, ["is_entry"], one, [StructField("text", StringType())])
