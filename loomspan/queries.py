"""Registered queries over the driver's tables, each with DuckDB SQL of its own where SQL can say it.

The tables hold no LaTeX, so both engines build the same LaTeX from ``documents``: one heading, label, reference and comment a
paragraph, an equation in every fourth and a figure in every fifth.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions import vectors as V
from loomspan.operators import answers as A
from loomspan.operators import chunks as C
from loomspan.operators import digest, evaluation, intervals, latex, providers, qa_cache, retrieval, scan, structure, vector_index
from loomspan.plans.shared import materialize, shared_root
from loomspan.sources import files as S
from loomspan.sources import questions as Q
from loomspan.sources.store import compared
from loomspan.sources.tables import KeyedTable

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- LaTeX view


def tex(spark: SparkSession, sf_dir: str) -> DataFrame:
    def piece(p: Column, i: Column) -> Column:
        n = i.cast("string")
        level = F.when(i % 3 == 0, "section").when(i % 3 == 1, "subsection").otherwise("subsubsection")
        equation = F.when(i % 4 == 1, F.concat(F.lit("\n\\begin{equation}\\label{e:"), n, F.lit("} x="), n, F.lit(" \\end{equation}"))).otherwise("")
        figure = F.when(i % 5 == 2, F.concat(F.lit("\n\\begin{figure}\\includegraphics{img"), n, F.lit(".png}\\caption{Cap "), n, F.lit("}\\label{f:"), n, F.lit("}\\end{figure}"))).otherwise("")
        return F.concat(F.lit("\\"), level, F.lit("{P"), n, F.lit("}\n\\label{s:"), n, F.lit("}\n"), p, F.lit(" \\ref{s:"), (i - 1).cast("string"), F.lit("}"), equation, figure, F.lit(" % note "), n)

    paragraphs = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(paragraphs, piece), "\n\n").alias("text"))


TEX = r"""tex as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda p, i:
  '\' || case (i - 1) % 3 when 0 then 'section' when 1 then 'subsection' else 'subsubsection' end || '{P' || (i - 1) || '}' || chr(10) || '\label{s:' || (i - 1) || '}' || chr(10) || p || ' \ref{s:' || (i - 2) || '}'
  || case when (i - 1) % 4 = 1 then chr(10) || '\begin{equation}\label{e:' || (i - 1) || '} x=' || (i - 1) || ' \end{equation}' else '' end
  || case when (i - 1) % 5 = 2 then chr(10) || '\begin{figure}\includegraphics{img' || (i - 1) || '.png}\caption{Cap ' || (i - 1) || '}\label{f:' || (i - 1) || '}\end{figure}' else '' end
  || ' % note ' || (i - 1)), chr(10) || chr(10)) as text from documents)"""


def _found(pattern: str, groups: int, name: str) -> str:
    """CTE of matches with places: (doc_id, text, i, pre, whole, g1.., at) from tex."""
    full = "(?s)(.*?)(" + pattern + ")"
    pulls = ", ".join(f"regexp_extract_all(text, '{full}', {k}) as a{k}" for k in range(1, groups + 3))
    picks = ", ".join(["a1[i] as pre", "a2[i] as whole", *[f"a{k + 2}[i] as g{k}" for k in range(1, groups + 1)]])
    return f"{name} as (select *, cast(sum(length(pre) + length(whole)) over (partition by doc_id order by i) - length(whole) as integer) as p0 from (select doc_id, text, i, {picks} from (select *, unnest(range(1, len(a1) + 1)) as i from (select doc_id, text, {pulls} from tex))))"


HEADS = _found(r"\\(section|subsection|subsubsection|paragraph)\{([^}]*)\}", 2, "head")
SECTIONS = (
    f"with {TEX}, {HEADS}, "
    r"""lev as (select *, case g1 when 'section' then 1 when 'subsection' then 2 when 'subsubsection' then 3 else 4 end as level,
  regexp_extract(regexp_replace(substring(text, p0 + length(whole) + 1, 120), '(?s)\\(begin|section|subsection|subsubsection|paragraph|input|include)\b.*$', ''), '\\label\{([^}]+)\}', 1) as lab from head),
c1 as (select *, sum(cast(level = 1 as int)) over (partition by doc_id order by i) as n1, sum(cast(level <= 2 as int)) over (partition by doc_id order by i) as up2 from lev),
c2 as (select *, sum(cast(level = 2 as int)) over (partition by doc_id, n1 order by i) as n2 from c1),
c3 as (select *, sum(cast(level = 3 as int)) over (partition by doc_id, up2 order by i) as n3 from c2),
num as (select *, array_to_string(list_filter([n1, n2, n3][1:level], lambda v: v > 0), '.') as number from c3),
sec as (select doc_id, text, i, number, trim(g2) as title, p0 as char_start, cast(coalesce(lead(p0) over w, length(text)) as integer) as char_end, level, nullif(lab, '') as label,
  case level when 2 then last_value(case when level = 1 then number end ignore nulls) over w when 3 then last_value(case when level = 2 then number end ignore nulls) over w end as parent_number
  from num window w as (partition by doc_id order by i))"""
)


def parsed(spark: SparkSession, sf_dir: str, *parts: str, keep_text: bool = False) -> DataFrame:
    """Only the parts that a query reads are built; the text travels on only where it is read again."""
    return structure.parse(tex(spark, sf_dir), parts=parts, keep_text=keep_text)


@query(f"with {TEX} select doc_id, md5(text) as digest, cast(length(text) as integer) as n from tex")
def latex_view(spark, sf_dir):
    return tex(spark, sf_dir).select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


# ---------------------------------------------------------------- cleaning


@query(f"with {TEX} " + r"select doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '(^|[^\\])%.*$', '\1')), chr(10))) as digest from tex")
def clean_comments(spark, sf_dir):
    return tex(spark, sf_dir).select("doc_id", F.md5(latex.strip_comments(F.col("text"))).alias("digest"))


@query(r"select doc_id, md5(regexp_replace('\iffalse ' || text[1:40] || ' \fi ' || text[41:], '(?s)\\iffalse\b.*?\\fi\b', '', 'g')) as digest from documents")
def clean_iffalse(spark, sf_dir):
    marked = F.concat(F.lit("\\iffalse "), F.substring("text", 1, 40), F.lit(" \\fi "), F.expr("substring(text, 41)"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(latex.remove_iffalse(marked)).alias("digest"))


@query(r"select doc_id, md5(text[1:100] || text[101:]) as digest from documents")
def clean_bibliography(spark, sf_dir):
    marked = F.concat(F.substring("text", 1, 100), F.lit("\\begin{thebibliography}\n\\bibitem{a} x\n\\end{thebibliography}"), F.expr("substring(text, 101)"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(latex.remove_bibliography(marked)).alias("digest"))


@query(f"with {TEX}, " + r"""aside as (select doc_id, regexp_replace(text, '(\\(?:caption|label|ref|section|subsection|subsubsection|includegraphics|begin|end)\*?)\{([^{}]*)\}', '\1' || chr(57344) || '\2' || chr(57345), 'g') as text from tex)
select doc_id, md5(translate(regexp_replace(replace(text, 'the', '\textbf{the}'), '\\[a-zA-Z]+\*?\{([^{}]*)\}', '\1', 'g'), chr(57344) || chr(57345), '{}')) as digest from aside""")  # fmt: skip
def clean_wrappers(spark, sf_dir):
    return tex(spark, sf_dir).select("doc_id", F.md5(latex.strip_wrappers(F.replace("text", F.lit("the"), F.lit("\\textbf{the}")))).alias("digest"))


@query(r"""with t as (select doc_id, replace(text, ', ', chr(10) || chr(10) || chr(10) || chr(10)) as text from documents),
l as (select doc_id, i, rtrim(ls[i], ' ' || chr(9)) as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from t))),
g as (select *, i - row_number() over (partition by doc_id, line = '' order by i) as run from l),
k as (select *, row_number() over (partition by doc_id, run, line = '' order by i) as nth from g)
select doc_id, md5(string_agg(line, chr(10) order by i)) as digest from k where line <> '' or nth <= 2 group by doc_id""")
def collapse_blank_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit("\n\n\n\n")).alias("text"))
    return rows.select("doc_id", F.md5(latex.normalize_whitespace(F.col("text"))).alias("digest"))


def _macro_texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\\newcommand{\\aa}{first {x}}\\renewcommand{\\aa}{last}\\newcommand{\\bb}[2]{#1}\\def\\cc{"), F.col("source"), F.lit("}\n"), F.col("text")).alias("text"))


@query(r"""select doc_id, unnest(['aa', 'bb', 'cc']) as name, unnest(['last', '#1', source]) as last, unnest(['first {x}', null, source]) as first_plain from documents""")
def macro_collect(spark, sf_dir):
    return latex.glossary(latex.macros(_macro_texts(spark, sf_dir))).select("doc_id", "name", "last", "first_plain")


@query(r"select doc_id, md5(replace(replace(text, 'the', 'f$1\x'), 'and', source)) as digest from documents")
def macro_inline(spark, sf_dir):
    known = F.array(F.struct(F.lit("qa").alias("name"), F.lit("f$1\\x").alias("body")), F.struct(F.lit("qb").alias("name"), F.col("source").alias("body")))
    # A command name ends where no letter follows, so the marks are put before what isn't one.
    text = F.replace(F.replace("text", F.lit("the"), F.lit("\\qa\ue010")), F.lit("and"), F.lit("\\qb\ue010"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.translate(latex.inline_macros(text, known), "\ue010", "")).alias("digest"))


# ---------------------------------------------------------------- structure


@query(SECTIONS + " select doc_id, number, title, char_start, char_end, level, label, parent_number from sec")
def section_spans(spark, sf_dir):
    s = parsed(spark, sf_dir, "sections").select("doc_id", F.inline("sections"))
    return s.select("doc_id", "number", "title", "char_start", "char_end", "level", "label", "parent_number")


@query(SECTIONS + r""", f as (select doc_id, number, min_by(title, i) as title, min_by(parent_number, i) as up from sec group by doc_id, number)
select s.doc_id, s.number, s.char_start, concat_ws(' / ', b.number || ' ' || b.title, a.number || ' ' || a.title, s.number || ' ' || s.title) as path, split_part(s.number, '.', 1) as top
from sec s left join f a on a.doc_id = s.doc_id and a.number = s.parent_number left join f b on b.doc_id = a.doc_id and b.number = a.up""")
def section_path(spark, sf_dir):
    s = parsed(spark, sf_dir, "sections").select("doc_id", F.inline("sections"))
    return s.select("doc_id", "number", "char_start", "path", structure.section_top(F.col("number")).alias("top"))


REFS = _found(r"\\(?:ref|eqref|autoref|cref|Cref)\{([^}]+)\}", 1, "r")


@query(SECTIONS + f", {REFS} select r.doc_id, r.p0 as char_at, r.g1 as label, coalesce(s.number, '0') as section from r left join sec s on s.doc_id = r.doc_id and r.p0 >= s.char_start and r.p0 < s.char_end")
def pos_to_section(spark, sf_dir):
    return parsed(spark, sf_dir, "references").select("doc_id", F.inline("references"))


EQS = _found(r"\\begin\{equation\}(.+?)\\end\{equation\}", 1, "e")
FIGS = _found(r"\\begin\{figure\}(.+?)\\end\{figure\}", 1, "g")


@query(SECTIONS + f", {EQS} " + r"select e.doc_id, regexp_extract(g1, '\\label\{([^}]+)\}', 1) as label, s.number as section, trim(g1) as latex, p0 as char_pos from e join sec s on s.doc_id = e.doc_id and p0 >= s.char_start and p0 < s.char_end")
def equations(spark, sf_dir):
    return parsed(spark, sf_dir, "equations").select("doc_id", F.inline("equations")).drop("section_path", "before", "after")


@query(SECTIONS + f", {FIGS} " + r"select g.doc_id, regexp_extract(g1, '\\label\{([^}]+)\}', 1) as label, regexp_extract(g1, 'graphics\{([^}]+)\}', 1) as tex_path, regexp_extract(g1, 'caption\{([^}]+)\}', 1) as caption, p0 as char_pos, s.number as section from g join sec s on s.doc_id = g.doc_id and p0 >= s.char_start and p0 < s.char_end")
def figures(spark, sf_dir):
    return parsed(spark, sf_dir, "figures").select("doc_id", F.inline("figures")).drop("section_path", "section_title")


LABELS = SECTIONS + f", {EQS}, {FIGS}, " + r"""target as (select doc_id, label, arg_max(kind, rank) as kind from (
  select doc_id, label, 'section' as kind, 1 as rank from sec where label is not null
  union all select doc_id, regexp_extract(g1, '\\label\{([^}]+)\}', 1), 'equation', 2 from e union all select doc_id, regexp_extract(g1, '\\label\{([^}]+)\}', 1), 'figure', 3 from g) group by doc_id, label)"""  # fmt: skip
REFERENCED = f", {REFS}, " + r"""seen as (select r.doc_id, r.g1 as label, coalesce(s.number, '0') as section, min(r.p0) as p0 from r left join sec s on s.doc_id = r.doc_id and r.p0 >= s.char_start and r.p0 < s.char_end group by 1, 2, 3)"""


@query(LABELS + " select * from target")
def label_target(spark, sf_dir):
    return structure.label_targets(parsed(spark, sf_dir, "targets"))


@query(SECTIONS + REFERENCED + " select doc_id, label, string_agg(section, ',' order by p0) as sections from seen group by doc_id, label")
def label_referenced_by(spark, sf_dir):
    rows = structure.referenced_by(parsed(spark, sf_dir, "referenced"))
    return rows.select("doc_id", "label", F.array_join("sections", ",").alias("sections"))


@query(LABELS + REFERENCED + " select distinct doc_id, label from seen where not exists (select 1 from target t where t.doc_id = seen.doc_id and t.label = seen.label)")
def label_undefined(spark, sf_dir):
    return evaluation.dangling(parsed(spark, sf_dir, "referenced", "targets")).select("doc_id", F.explode("undefined").alias("label"))


@query(LABELS + REFERENCED + " select doc_id, label from target where not exists (select 1 from seen s where s.doc_id = target.doc_id and s.label = target.label)")
def label_unreferenced(spark, sf_dir):
    return evaluation.dangling(parsed(spark, sf_dir, "referenced", "targets")).select("doc_id", F.explode("unreferenced").alias("label"))


@query(r"""with t as (select doc_id, source || '=' || n_chars || ' \texttt{' || lang || '} \verb|x y| 7 ' || n_chars || '.5 ' || regexp_replace(text, '\d', '', 'g') as text from documents),
p as (select doc_id, list_concat(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*\s*=\s*\d+(?:\.\d+)?(?:[eE][+-]?\d+)?'), lambda m: regexp_replace(m, '\s*=\s*', '=')),
  regexp_extract_all(text, '\\text(?:tt|sf|sc)\{([^{}]+)\}', 1), regexp_extract_all(text, '\\verb\|([^|]+)\|', 1),
  list_filter(list_transform(regexp_extract_all(regexp_replace(text, '([A-Za-z])\d', '\1#', 'g'), '\d+(?:[.,]\d+)?(?:\s*%)?'), lambda v: trim(v)), lambda v: regexp_matches(v, '[.,]') or length(trim(replace(v, '%', ''))) > 1)) as k from t),
d as (select doc_id, v, min(i) as i from (select doc_id, unnest(k) as v, unnest(range(1, len(k) + 1)) as i from p) where v <> '' and length(v) <= 40 group by doc_id, v),
n as (select *, row_number() over (partition by doc_id order by i) as turn from d)
select doc_id, string_agg(v, ';' order by turn) as keywords from n where turn <= 15 group by doc_id""")
def section_keywords(spark, sf_dir):
    text = F.concat("source", F.lit("="), F.col("n_chars").cast("string"), F.lit(" \\texttt{"), "lang", F.lit("} \\verb|x y| 7 "), F.col("n_chars").cast("string"), F.lit(".5 "), F.regexp_replace("text", r"\d", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(structure.keywords(text), ";").alias("keywords"))


@query("select doc_id, lang || '|' || source as authors from documents")
def authors(spark, sf_dir):
    blob = F.concat(F.col("lang"), F.lit(" \\thanks{a b}\\and \\textbf{"), F.col("source"), F.lit("}\\footnote{x},\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(structure.authors(blob), "|").alias("authors"))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) as digest from documents")
def abstract(spark, sf_dir):
    text = F.concat(F.lit("x\\begin{abstract}"), "text", F.lit(" \\end{abstract} y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(structure.abstract(text)).alias("digest"))


# ---------------------------------------------------------------- stored tables


def _new_table(spark: SparkSession, name: str, keys: list[str]) -> KeyedTable:
    return KeyedTable(spark, f"{shared_root(spark)}/loomspan/{name}-{uuid.uuid4().hex}", keys)


@query("""with old as (select doc_id, text from documents join labels using (doc_id)),
now_ as (select doc_id, case when toxic = 1 then 'withdrawn' else text end as text from documents left join labels using (doc_id) where coalesce(quality, 1) <> 0),
both_ as (select 'old' as side, doc_id, text from old union all select 'now', doc_id, text from now_),
f as (select side, doc_id, length(text) as n, substring(sha256(encode('v1') || '\\x00'::blob || encode('main.tex') || '\\x00'::blob || encode(text) || '\\x00'::blob), 1, 16) as fingerprint from both_)
select doc_id, case when o.doc_id is null then 'new' when w.doc_id is null then 'deleted' when o.fingerprint = w.fingerprint then 'same' else 'changed' end as change, w.fingerprint, cast(w.n as integer) as n_chars
from (select * from f where side = 'old') o full join (select * from f where side = 'now') w using (doc_id)""")
def ingest_changes(spark, sf_dir):
    """A corpus of the labelled documents becomes one of all but the bad ones, the toxic ones withdrawn: what changed by fingerprint, and the
    stored table after only that was written."""
    name = F.lit("main.tex")
    docs = table(spark, sf_dir, "documents").select("doc_id", S.fingerprint_of_one(name, F.encode("text", "utf-8")).alias("fingerprint"), F.length("text").alias("n_chars"))
    marked = materialize(docs.join(table(spark, sf_dir, "labels").withColumn("known", F.lit(True)), "doc_id", "left"), "marked")
    gone = F.lit("withdrawn")
    edited = {"fingerprint": S.fingerprint_of_one(name, F.encode(gone, "utf-8")), "n_chars": F.length(gone)}
    old = marked.where("known").select(*docs.columns)
    now = marked.where(F.coalesce("quality", F.lit(1)) != 0).select("doc_id", *(F.when(F.col("toxic") == 1, e).otherwise(F.col(c)).alias(c) for c, e in edited.items()))
    stored = _new_table(spark, "articles", ["doc_id"])
    stored.upsert(old)
    changes = materialize(compared(now, old), "changes")
    todo = changes.where("change in ('new', 'changed')").select("doc_id")
    stored.upsert(now.join(todo, "doc_id", "left_semi"), changes.where("change <> 'same'").select("doc_id"))
    return changes.join(stored.read(), "doc_id", "left").select("doc_id", "change", "fingerprint", "n_chars")


@query("""with c as (select client_id, arg_max(struct_pack(op, source, segment, city, balance), row(seq, change_id)) as l from client_changes group by client_id)
select client_id, source, segment, city, balance from clients where client_id not in (select client_id from c)
union all select client_id, l.source, l.segment, l.city, l.balance from c where l.op <> 'D'""")
def table_upsert(spark, sf_dir):
    """Clients with the last of each one's changes applied, as two changes of a keyed table."""
    row = ["client_id", "source", "segment", "city", "balance"]
    last = table(spark, sf_dir, "client_changes").groupBy("client_id").agg(F.max_by(F.struct("op", *row[1:]), F.struct("seq", "change_id")).alias("l")).select("client_id", "l.*")
    last = materialize(last, "last-changes")
    stored = _new_table(spark, "clients", ["client_id"])
    stored.upsert(table(spark, sf_dir, "clients").select(*row))
    stored.upsert(last.where("op <> 'D'").select(*row), last.where("op = 'D'").select("client_id"))
    return stored.read()


@query("""with c as (select client_id, valid_at, arg_max(struct_pack(segment, city), row(seq, change_id)) as l from client_changes where client_id is not null and valid_at is not null group by all)
select s.sale_id, s.client_id, s.sold_at, c.l.segment as segment, c.l.city as city from sales s asof left join c on s.client_id = c.client_id and s.sold_at >= c.valid_at""")
def sales_as_of(spark, sf_dir):
    """Each sale with its client's segment and city as they were when it was made."""
    sales, changes = table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at"), table(spark, sf_dir, "client_changes")
    return scan.as_of(sales, changes, ["client_id"], "sold_at", "valid_at", ["segment", "city"], ["seq", "change_id"])


@query("""select click_id, client_id, ts, cast(count(*) over w as bigint) as n, cast(count(*) filter (kind = 'purchase') over w as bigint) as purchases, last_value(kind ignore nulls) over w as last_kind
from (select *, row_number() over (partition by client_id, ts, click_id order by arrived_at) as k from clicks) window w as (partition by client_id order by ts nulls first, click_id nulls first, arrived_at nulls first, kind nulls first, k rows unbounded preceding)""")
def click_running(spark, sf_dir):
    """Each click with its client's clicks and purchases so far and the kind of the latest."""
    clicks = table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts", "arrived_at", "kind")
    rows = scan.running(clicks, ["client_id"], ["ts", "click_id", "arrived_at", "kind"], {"n": F.lit(1), "purchases": (F.col("kind") == "purchase").cast("int")}, {"last_kind": F.col("kind")})
    return rows.select("click_id", "client_id", "ts", "n", "purchases", "last_kind")


# ---------------------------------------------------------------- chunks


@query("select doc_id, cast(i as integer) as i, cast(i * 1050 as integer) as char_start, md5(substring(text, cast(i * 1050 + 1 as bigint), 1200)) as digest from (select doc_id, text, unnest(range(0, cast(greatest(ceil((length(text) - 150) / 1050.0), 1) as bigint))) as i from documents)")
def chunk_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.fixed_width(F.col("text"))).alias("i", "piece"))
    return rows.select("doc_id", "i", (F.col("i") * (C.SIZE - C.OVERLAP)).alias("char_start"), F.md5("piece").alias("digest"))


@query()
def chunk_body(spark, sf_dir):
    return C.body_chunks(parsed(spark, sf_dir, *C.PARTS)).select("doc_id", "chunk_id", "section_path", "char_start", "char_end", "has_figure", F.array_join("label_refs", ",").alias("refs"))


@query(SECTIONS + f", {EQS} " + r"""select e.doc_id, 'equation:' || regexp_extract(g1, '\\label\{([^}]+)\}', 1) as chunk_id,
  md5('eq ' || regexp_extract(g1, '\\label\{([^}]+)\}', 1) || ': ' || trim(g1) || chr(10) || 'Before: ' || regexp_replace(substring(text, greatest(p0 - 150, 0) + 1, p0 - greatest(p0 - 150, 0)), '^\s+|\s+$', '', 'g') || chr(10) || 'After: ' || regexp_replace(substring(text, p0 + length(trim(g1)) + 1, 150), '^\s+|\s+$', '', 'g')) as digest from e""")
def chunk_equation_context(spark, sf_dir):
    return C.equation_chunks(parsed(spark, sf_dir, "equations")).select("doc_id", "chunk_id", F.md5("text").alias("digest"))


@query(LABELS + r""" select doc_id, kind, case kind when 'body' then count(distinct t) else count(*) end as n, case when kind not in ('body', 'equation') then sum(length(t)) end as chars from (
  select doc_id, 'body' as kind, number as t from sec
  union all select doc_id, 'caption', 'Figure ' || regexp_extract(g1, '\\label\{([^}]+)\}', 1) || ': ' || regexp_extract(g1, 'caption\{([^}]+)\}', 1) as t from g
  union all select doc_id, 'equation', null from e
  union all select doc_id, 'section_summary', 'Section ' || number || ' ' || title || ': ' || title from sec
  union all select doc_id, 'figure_desc', 'Figure ' || regexp_extract(g1, '\\label\{([^}]+)\}', 1) || ' description: ' || regexp_extract(g1, 'caption\{([^}]+)\}', 1) from g) group by doc_id, kind""")
def chunk_union(spark, sf_dir):
    """All kinds; of bodies, whose pieces the splitter makes, the sections that have any."""
    p = materialize(parsed(spark, sf_dir, *C.PARTS), "parsed")
    summaries = p.select("doc_id", F.inline("sections")).select("doc_id", "number", F.col("title").alias("dense_summary"))
    described = p.select("doc_id", F.inline("figures")).select("doc_id", "label", F.col("section").alias("section_path"), F.col("caption").alias("description_text"))
    rows = C.all_chunks(p, summaries, described)
    body = F.col("kind") == "body"
    n = F.count_distinct(F.when(body, F.col("section_number"))) + F.count_if(~body)
    return rows.groupBy("doc_id", "kind").agg(n.alias("n"), F.sum(F.when(~F.col("kind").isin("body", "equation"), F.length("text"))).alias("chars"))


@query(SECTIONS + """, pieces as (select doc_id, cast(i as integer) as i, i * 1050 as a, least(i * 1050 + 1200, n) as b from (select doc_id, length(text) as n, unnest(range(0, cast(greatest(ceil((length(text) - 150) / 1050.0), 1) as bigint))) as i from tex))
select p.doc_id, p.i, s.number, s.char_start, cast(least(p.b, s.char_end) - greatest(p.a, s.char_start) as bigint) as shared from pieces p join sec s on s.doc_id = p.doc_id and p.a < s.char_end and s.char_start < p.b""")
def chunk_sections(spark, sf_dir):
    """Which sections each fixed-width piece shares characters with, and how many: a join of two tables of spans by overlap."""
    texts = materialize(tex(spark, sf_dir), "latex")
    pieces = texts.select("doc_id", F.length("text").alias("n"), F.posexplode(F.transform(C.fixed_width(F.col("text")), F.length)).alias("i", "__n"))
    at = F.col("i") * (C.SIZE - C.OVERLAP)
    pieces = pieces.select("doc_id", "i", at.cast("long").alias("char_start"), F.least(at + C.SIZE, F.col("n")).cast("long").alias("char_end"))
    sections = materialize(structure.parse(texts, parts=("sections",), keep_text=False).select("doc_id", F.inline("sections")).select("doc_id", "number", F.col("char_start").cast("long"), F.col("char_end").cast("long")), "sections")
    shared = F.least("left.char_end", "right.char_end") - F.greatest("left.char_start", "right.char_start")
    return intervals.overlaps(pieces, sections, ["doc_id"]).select("left.doc_id", "left.i", "right.number", F.col("right.char_start").cast("int").alias("char_start"), shared.alias("shared"))


@query("select doc_id, case when source = 'src0' then '' else '|' || source || '|' || lang || '|' end as refs from documents")
def pipe_encode(spark, sf_dir):
    items = F.when(F.col("source") == "src0", F.array(F.lit(""))).otherwise(F.array("source", F.lit(""), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.pipes(items).alias("refs"))


# ---------------------------------------------------------------- vectors and retrieval


def vector_chunks(spark, sf_dir) -> DataFrame:
    v, s = F.col("vec_id"), F.col("label").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("body", "caption", "figure_desc", "equation"))), (v % 4 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.format_string("v%05d", v).alias("chunk_id"), kind.alias("kind"), F.concat(s, F.lit("."), (v % 3).cast("string")).alias("section_number"), s.alias("section_top"), (v % 2 == 0).alias("has_figure"), F.array(F.concat(F.lit("f"), (v % 7).cast("string"))).alias("figure_refs"), F.array(F.concat(F.lit("e"), (v % 5).cast("string"))).alias("equation_refs"), "embedding")


def vector_plans(spark, sf_dir) -> DataFrame:
    v = F.col("vec_id")
    turn = (v / 20).cast("int")
    scope = F.when(turn % 5 != 4, F.array(F.concat(F.col("label").cast("string"), F.lit(".0")), ((F.col("label") + 1) % 10).cast("string")))
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(v.alias("question_id"), "embedding", scope.alias("scope"), (turn % 3 == 0).alias("is_figure"), F.concat(F.lit("f"), (turn % 7).cast("string")).alias("target_label"))


VECTORS = r"""with chunk as (select printf('v%05d', vec_id) as chunk_id, ['body', 'caption', 'figure_desc', 'equation'][vec_id % 4 + 1] as kind, label || '.' || vec_id % 3 as section_number, cast(label as varchar) as section_top,
  vec_id % 2 = 0 as has_figure, 'f' || vec_id % 7 as fig, 'e' || vec_id % 5 as equ, cast(embedding as double[]) as v from embeddings),
plan as (select vec_id as question_id, cast(embedding as double[]) as q, case when vec_id // 20 % 5 <> 4 then [label || '.0', cast((label + 1) % 10 as varchar)] end as scope, vec_id // 20 % 3 = 0 as is_figure, 'f' || vec_id // 20 % 7 as target from embeddings where vec_id % 20 = 0),
base as (select *, greatest(0, list_cosine_similarity(v, q)) as sim from chunk, plan),
flag as (select *, (scope is null or list_contains(scope, section_number) or list_contains(scope, section_top)) and (not is_figure or kind <> 'equation' and has_figure) as in_scope, not is_figure or kind <> 'equation' and has_figure as in_figures,
  sim + case when list_contains(scope, section_number) then 0.05 else 0 end + case when list_contains(scope, section_top) then 0.03 else 0 end + case when is_figure and kind in ('caption', 'figure_desc') then 0.05 else 0 end + case when target = fig or target = equ then 0.1 else 0 end as score from base)"""
LIMITS = retrieval.Limits(least=0.2)


def _six(c: str) -> Column:
    return F.round(c, 6).alias(c)


@query(VECTORS + " select question_id, chunk_id, cast(rank as integer) as rank, round(sim, 6) as sim from (select *, row_number() over (partition by question_id order by sim desc, chunk_id) as rank from base) where rank <= 6")
def knn_topk(spark, sf_dir):
    return retrieval.top_k(vector_chunks(spark, sf_dir), vector_plans(spark, sf_dir), 6).select("question_id", "chunk_id", "rank", _six("sim"))


@query(VECTORS + " select question_id, chunk_id, round(sim, 6) as sim from (select *, row_number() over (partition by question_id order by sim desc, chunk_id) as rank from flag where in_scope) where rank <= 24 and sim >= 0.2")
def knn_threshold(spark, sf_dir):
    rows = retrieval.top_k(vector_chunks(spark, sf_dir), vector_plans(spark, sf_dir), 24, "scoped")
    return rows.where("sim >= 0.2").select("question_id", "chunk_id", _six("sim"))


@query(VECTORS + " select question_id, chunk_id, round(score, 6) as score from (select *, row_number() over (partition by question_id order by sim desc, chunk_id) as rank from base join flag using (question_id, chunk_id, sim)) where rank <= 24".replace("base join flag using (question_id, chunk_id, sim)", "flag"))
def rerank_bonus(spark, sf_dir):
    rows = retrieval.top_k(vector_chunks(spark, sf_dir), vector_plans(spark, sf_dir), 24)
    return rows.withColumn("score", F.col("sim") + retrieval.bonus(F.col("scope"), F.col("is_figure"), F.col("target_label"))).select("question_id", "chunk_id", _six("score"))


GROUPED = """first as (select *, row_number() over (partition by question_id, section_number, kind order by score desc, sim desc, chunk_id) as f from {0}),
{1} as (select * from (select *, row_number() over (partition by question_id order by score desc, sim desc, chunk_id) as ord from first where f = 1) where ord <= {2})"""


@query(VECTORS + ", top as (select * from (select *, row_number() over (partition by question_id order by sim desc, chunk_id) as rank from flag) where rank <= 24), " + GROUPED.format("top", "kept", 6) + " select question_id, chunk_id, cast(ord as integer) as ord, round(score, 6) as score from kept")
def dedup_group(spark, sf_dir):
    rows = retrieval.top_k(vector_chunks(spark, sf_dir), vector_plans(spark, sf_dir), 24)
    rows = rows.withColumn("score", F.col("sim") + retrieval.bonus(F.col("scope"), F.col("is_figure"), F.col("target_label")))
    return retrieval.best_per_group(rows, 6).select("question_id", "chunk_id", "ord", _six("score"))


RETRIEVE = VECTORS + r""", s0 as (select * from (select *, row_number() over (partition by question_id order by sim desc, chunk_id) as rank from flag where in_scope) where rank <= 24 and sim >= 0.2),
g0 as (select * from (select *, row_number() over (partition by question_id order by sim desc, chunk_id) as rank from flag where in_figures) where rank <= 24 and sim >= 0.2),
p0 as (select * from (select *, row_number() over (partition by question_id order by sim desc, chunk_id) as rank from flag) where rank <= 12 and sim >= 0.2),
""" + GROUPED.format("s0", "s1", 6) + ", enough as (select question_id from s1 group by 1 having count(*) >= 3), " + GROUPED.format("g0", "g1", 8).replace("first as", "first2 as").replace("from first ", "from first2 ") + r""",
b1 as (select *, 6 + row_number() over (partition by question_id order by sim desc, chunk_id) as bord from p0 where question_id in (select question_id from enough) and not exists (select 1 from s1 where s1.question_id = p0.question_id and s1.chunk_id = p0.chunk_id)),
final as (select question_id, chunk_id, ord, score, false as fallback_used from s1 where question_id in (select question_id from enough)
union all select question_id, chunk_id, bord, sim, false from b1 where bord <= 8
union all select question_id, chunk_id, ord, score, true from g1 where question_id not in (select question_id from enough))"""


def _index(spark, sf_dir) -> vector_index.Index:
    chunks = vector_chunks(spark, sf_dir)
    return vector_index.build(chunks, f"{shared_root(spark)}/loomspan/index-{uuid.uuid4().hex}")


@query(SQL["knn_topk"])
def index_topk(spark, sf_dir):
    """As ``knn_topk``, through the index: cells that can't hold one of the nearest aren't read."""
    found, _ = vector_index.search(_index(spark, sf_dir), vector_plans(spark, sf_dir).drop("is_figure"), 6)
    return found.select("question_id", "chunk_id", F.col("rank").cast("int").alias("rank"), _six("sim"))


def _retrieved(spark, sf_dir) -> DataFrame:
    rows = retrieval.retrieve(vector_chunks(spark, sf_dir), vector_plans(spark, sf_dir), LIMITS)
    return rows.select("question_id", "chunk_id", F.col("ord").cast("int").alias("ord"), _six("score"), "fallback_used")


@query(RETRIEVE + " select question_id, chunk_id, cast(ord as integer) as ord, round(score, 6) as score, fallback_used from final")
def retrieve_scoped(spark, sf_dir):
    return _retrieved(spark, sf_dir)


@query(SQL["retrieve_scoped"])
def retrieve_indexed(spark, sf_dir):
    """As ``retrieve_scoped``: global passes through the index's cells, scoped ones through postings by section."""
    rows = vector_index.retrieve(_index(spark, sf_dir), vector_plans(spark, sf_dir), LIMITS)
    return rows.select("question_id", "chunk_id", F.col("ord").cast("int").alias("ord"), _six("score"), "fallback_used")


@query(RETRIEVE + " select question_id, chunk_id, cast(ord as integer) as ord, round(score, 6) as score, fallback_used from final where fallback_used")
def retrieve_fallback(spark, sf_dir):
    return _retrieved(spark, sf_dir).where("fallback_used")


@query(RETRIEVE + " select question_id, chunk_id, cast(ord as integer) as ord, round(score, 6) as score, fallback_used from final where not fallback_used and ord > 6")
def retrieve_bonus_anti(spark, sf_dir):
    return _retrieved(spark, sf_dir).where("not fallback_used and ord > 6")


@query(VECTORS + ", known as (select section_number as s from chunk union select section_top from chunk), i as (select question_id, trim(regexp_replace('§' || unnest(list_append(scope, 'zz')), '^§+', '')) as s from plan where scope is not null) select question_id, string_agg(s, ',' order by s) as scope from i where s in (select s from known) group by question_id")
def scope_validate(spark, sf_dir):
    plans = vector_plans(spark, sf_dir).withColumn("scope", F.transform(F.concat("scope", F.array(F.lit("zz"))), lambda s: F.concat(F.lit("§Section "), s)))
    rows = retrieval.validate_scope(plans, vector_chunks(spark, sf_dir)).where("not unscoped")
    return rows.select("question_id", F.array_join(F.array_sort("scope"), ",").alias("scope"))


@query("select doc_id, cast(('0x' || substring(md5(w), 1, 4))::integer % 64 as integer) as bucket, count(*) as n from (select doc_id, unnest(string_split(lower(text), ' ')) as w from documents) where w <> '' group by 1, 2")
def embed_offline(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(V.hashed_words(F.col("text"))).alias("bucket", "n"))
    return rows.where("n > 0").select("doc_id", "bucket", F.col("n").cast("long").alias("n"))


# ---------------------------------------------------------------- answer cache

NORM = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '[^\p{{L}}\p{{N}}\p{{M}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"select conv_id, turn, {NORM.format('text')} as norm from conversations")
def question_normalize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_question(F.col("text")).alias("norm"))


def _entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), F.col("text").alias("question"))


@query(f"with e as (select conv_id * 1000 + turn as entry_id, {NORM.format('text')} as norm from conversations where role = 'user'), f as (select norm, min(entry_id) as entry_id from e group by norm) select c.conv_id * 1000 + c.turn as question_id, f.entry_id from conversations c join f on {NORM.format("c.text || ' ?!'")} = f.norm where role = 'user'")
def qa_exact_lookup(spark, sf_dir):
    questions = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat("text", F.lit(" ?!")).alias("question"))
    return qa_cache.exact(questions, _entries(spark, sf_dir))


SEMANTIC = "with p as (select q.vec_id as question_id, e.vec_id as entry_id, list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])) as similarity from embeddings q, embeddings e where q.vec_id % 20 = 0 and e.vec_id <> q.vec_id), b as (select question_id, min_by(entry_id, struct_pack(a := -similarity, b := entry_id)) as entry_id, max(similarity) as similarity from p group by 1)"


# Every twentieth vector asks against all others.
def _semantic(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding"), rows.select(F.col("vec_id").alias("entry_id"), "embedding")


@query(SEMANTIC + " select question_id, entry_id, round(similarity, 6) as similarity from b where similarity >= 0.35")
def qa_semantic_lookup(spark, sf_dir):
    return qa_cache.semantic(*_semantic(spark, sf_dir), threshold=0.35, others=True).select("question_id", "entry_id", _six("similarity"))


@query(SEMANTIC + " select 0::bigint as exact_hits, count(*) filter (where similarity >= 0.35) as semantic_hits, count(*) filter (where similarity < 0.35) as misses, round(coalesce(avg(similarity) filter (where similarity >= 0.35), 0), 6) as mean_similarity from b")
def qa_cache_metrics(spark, sf_dir):
    questions, entries = _semantic(spark, sf_dir)
    found = qa_cache.lookup(questions.withColumn("question", F.concat(F.lit("q"), "question_id")), entries.withColumn("question", F.concat(F.lit("e"), "entry_id")), threshold=0.35, others=True)
    return qa_cache.metrics(found).withColumn("mean_similarity", F.round("mean_similarity", 6))


# ---------------------------------------------------------------- digest, context, sources


@query(SECTIONS + " select doc_id, string_agg(repeat('  ', level - 1) || '- **' || number || ' ' || title || '**', chr(10) order by i) as outline from sec group by doc_id")
def article_outline(spark, sf_dir):
    rows = parsed(spark, sf_dir, "sections")
    none = F.transform("sections", lambda s: F.array().cast("array<string>"))
    return rows.select("doc_id", F.array_join(digest.outline(F.col("sections"), none), "\n").alias("outline"))


WORDS = r"""kw as (select doc_id, i as sec_i, regexp_replace(body, '([A-Za-z])\d', '\1#', 'g') as plain, body from (select doc_id, i, substring(text, char_start + 1, char_end - char_start) as body from sec where level = 1)),
kp as (select doc_id, sec_i, list_concat(list_transform(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]*\s*=\s*\d+(?:\.\d+)?(?:[eE][+-]?\d+)?'), lambda m: regexp_replace(m, '\s*=\s*', '=')),
  list_transform(regexp_extract_all(body, '\\text(?:tt|sf|sc)\{([^{}]+)\}', 1), lambda v: trim(v)), list_transform(regexp_extract_all(body, '\\verb\|([^|]+)\|', 1), lambda v: trim(v)),
  list_filter(list_transform(regexp_extract_all(plain, '\d+(?:[.,]\d+)?(?:\s*%)?'), lambda v: trim(v)), lambda v: regexp_matches(v, '[.,]') or length(trim(replace(v, '%', ''))) > 1)) as k from kw),
kd as (select doc_id, sec_i, v, min(j) as j from (select doc_id, sec_i, unnest(k) as v, unnest(range(1, len(k) + 1)) as j from kp) where v <> '' and length(v) <= 40 group by 1, 2, 3),
kl as (select doc_id, sec_i, string_agg(v, ', ' order by turn) as words from (select *, row_number() over (partition by doc_id, sec_i order by j) as turn from kd) where turn <= 8 group by 1, 2)"""


@query(SECTIONS + f", {EQS}, {REFS}, {WORDS}" + r""", seen as (select r.doc_id, r.g1 as label, coalesce(s.number, '0') as section, min(r.p0) as p0 from r left join sec s on s.doc_id = r.doc_id and r.p0 >= s.char_start and r.p0 < s.char_end group by 1, 2, 3),
o as (select sec.doc_id, string_agg(repeat('  ', level - 1) || '- **' || number || ' ' || title || '**' || coalesce(chr(10) || '  - Keywords: ' || words, ''), chr(10) order by i) as t from sec left join kl on kl.doc_id = sec.doc_id and kl.sec_i = sec.i group by sec.doc_id),
q as (select doc_id, string_agg(line, chr(10) order by i) as t from (select e.doc_id, e.i, '- **' || regexp_extract(g1, '\\label\{([^}]+)\}', 1) || '** (Section ' || s.number || ') — `' || substring(trim(regexp_replace(trim(g1), '\s+', ' ', 'g')), 1, 200) || '`' as line
  from e join sec s on s.doc_id = e.doc_id and p0 >= s.char_start and p0 < s.char_end where e.i <= 30) group by doc_id),
x as (select doc_id, string_agg(line, chr(10) order by label) as t from (select doc_id, label, row_number() over (partition by doc_id order by label) as k, line from (
  select doc_id, label, '- ' || label || ' referenced from: ' || array_to_string(list_transform(list(section order by p0)[1:8], lambda v: '§' || v), ', ') as line from seen group by doc_id, label)) where k <= 60 group by doc_id),
m as (select tex.doc_id, concat_ws(chr(10), '# Article Map', chr(10) || '## Identity', '- **Title**: (unknown)', '- **Length**: ' || length(text) || ' chars / ~' || greatest(1, length(text) // 1800) || ' chunks',
  chr(10) || '## Outline', o.t, chr(10) || '## Equations of Interest' || chr(10) || q.t, chr(10) || '## Cross-Reference Index' || chr(10) || x.t) as t from tex left join o using (doc_id) left join q using (doc_id) left join x using (doc_id)),
c as (select doc_id, case when length(t) > 16000 then t[1:16000] || chr(10) || chr(10) || '[...truncated...]' else t end as t from m) select doc_id, cast(length(t) as integer) as n_chars, md5(t) as digest from c""")
def article_map(spark, sf_dir):
    p = parsed(spark, sf_dir, *digest.PARTS, keep_text=True)
    return digest.article_map(p).select("doc_id", F.length("map").alias("n_chars"), F.md5("map").alias("digest"))


@query("with b as (select source as by_source, doc_id, '[body; ' || lang || ']' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') as block from documents where regexp_matches(text, '\\S')) select * from (select by_source, doc_id, md5(block) as digest, cast(sum(length(block) + 2) over (partition by by_source order by doc_id) as bigint) as total from b) where total <= 70000")
def context_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("source", F.lit("body").alias("kind"), F.col("lang").alias("section_path"), F.lit(None).cast("string").alias("section_number"), F.lit(0).alias("char_start"), F.col("doc_id").alias("chunk_id"), "text")
    return A.pack_context(chunks, "source").select(F.col("source").alias("by_source"), F.col("chunk_id").alias("doc_id"), F.md5("block").alias("digest"), "total")


@query("with n as (select source, doc_id, text, row_number() over (partition by source order by doc_id) as k from documents) select source, string_agg('[' || k || '] ' || case when length(text) > 1500 then text[1:1500] || '...' else text end, chr(10) || chr(10) order by k) as sources from n where k <= 8 group by source")
def format_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.col("doc_id").alias("chunk_id"), "text")
    return A.format_sources(rows, "source")


# ---------------------------------------------------------------- questions and answers


@query("with u as (select conv_id, turn, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') as t, row_number() over (partition by conv_id order by turn) as slot from conversations where role = 'user' and regexp_matches(text, '\\S')) select conv_id as doc_id, cast(slot as integer) as slot, cast(slot as integer) as idx, t || chr(10) || 'and more' as text from u")
def parse_numbered(spark, sf_dir):
    flat = F.regexp_replace(F.regexp_replace("text", r"\s+", " "), "^ | $", "")
    u = table(spark, sf_dir, "conversations").where("role = 'user'").where(F.col("text").rlike(r"\S"))
    lines = u.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", flat.alias("t")))), lambda x: x["t"]).alias("l"))
    text = F.array_join(F.transform("l", lambda t, i: F.concat((i + 1).cast("string"), F.lit(") "), t, F.lit("\n\nand more"))), "\n")
    return Q.numbered_items(lines.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("before\n"), text).alias("text")))


@query("with u as (select conv_id, text, row_number() over (partition by conv_id order by turn) as slot from conversations where role = 'user') select conv_id as doc_id, cast(slot as integer) as slot, cast(slot * 2 as integer) as idx, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from u")
def parse_markdown(spark, sf_dir):
    u = table(spark, sf_dir, "conversations").where("role = 'user'")
    lines = u.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("l"))
    text = F.array_join(F.transform("l", lambda t, i: F.concat(F.lit("## question "), ((i + 1) * 2).cast("string"), F.lit("\n"), t, F.lit("\n"))), "\n")
    return Q.markdown_blocks(lines.select(F.col("conv_id").alias("doc_id"), text.alias("text")))


@query("with a as (select conv_id, row_number() over (partition by conv_id order by turn) as slot, coalesce(nullif(regexp_replace(case when turn % 5 = 1 then '  ' else text end, '^\\s+|\\s+$', '', 'g'), ''), 'no answer') as body from conversations where role = 'assistant') select conv_id as doc_id, case when conv_id % 2 = 0 then string_agg('## Answer ' || slot || chr(10) || body, chr(10) || chr(10) order by slot) else string_agg(slot || '. ' || body, chr(10) order by slot) end || chr(10) as text from a group by conv_id")
def format_answers(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("slot", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    fmt = F.when(F.col("conv_id") % 2 == 0, "markdown").otherwise("numbered")
    rows = a.select(F.col("conv_id").alias("doc_id"), "slot", fmt.alias("fmt"), A.format_block(F.col("slot"), F.when(F.col("turn") % 5 == 1, "  ").otherwise(F.col("text")), fmt).alias("block"))
    return A.document(rows)


@query("with q as (select conv_id as doc_id, turn as slot from conversations where role = 'user'), a as (select conv_id as doc_id, turn - 1 as slot, text from conversations where role = 'assistant') select coalesce(q.doc_id, a.doc_id) as doc_id, coalesce(q.slot, a.slot) as slot, case when a.doc_id is null then 'missing answer' when q.doc_id is null then 'unexpected answer' else 'empty answer' end as problem from q full join a on q.doc_id = a.doc_id and q.slot = a.slot where q.doc_id is null or a.doc_id is null or not regexp_matches(a.text, '\\S')")
def validate_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return evaluation.validate(c.where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("slot")), c.where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), (F.col("turn") - 1).alias("slot"), F.col("text").alias("answer")))


REFUSES = r"lower(regexp_replace({0}, '^[\s.\"''`]+|[\s.\"''`]+$', '', 'g')) in ('', 'no answer')"


@query(f"select conv_id, turn, turn % 3 = 0 or {REFUSES.format('text')} as refused from conversations")
def no_answer_filter(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 0, F.lit(" \"No Answer.\" ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_no_answer(text).alias("refused"))


@query("select doc_id, source = 'src3' or regexp_matches(text, '[\\x{0400}-\\x{04FF}]') as cyrillic from documents")
def script_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_cyrillic(F.concat("text", F.when(F.col("source") == "src3", "привет").otherwise(""))).alias("cyrillic"))


@query(f"select conv_id, turn, case when turn % 2 = 0 and not ({REFUSES.format('text')}) then case when regexp_matches(text, '[\\x{{0400}}-\\x{{04FF}}]') then 'in English' else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end else 'from context' || chr(10) || chr(10) || '{A.NOTE}' end as answer from conversations")
def answer_postprocess(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("No answer.").alias("answer"))
    return A.postprocess(rows, F.lit("from context"), F.lit("in English")).select("conv_id", "turn", "answer")


@query("with l as (select conv_id, turn, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) as line from conversations), n as (select conv_id, turn, count(*) as n from l group by 1, 2) select conv_id, turn, n, cast(sum(length(b)) as bigint) as chars from (select conv_id, turn, n, unnest(list_transform(range(1, n + 1), lambda k: k || '. no answer')) as b from n) group by 1, 2, 3")
def baseline_stub(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    return Q.baseline(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("block")).alias("chars")).select("doc_id.conv_id", "doc_id.turn", "n", "chars")


@query("select conv_id, turn, case when turn % 4 = 0 then 'markdown' else 'numbered' end as fmt from conversations")
def numbered_detect(spark, sf_dir):
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("x\n  ## question 3  \n"), "text")).otherwise(F.concat(F.lit("## Question 1 more\n1. "), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(Q.is_markdown(text), "markdown").otherwise("numbered").alias("fmt"))


@query(r"""with q as (select conv_id, count(*) filter (where role = 'user') as nq, count(*) filter (where role = 'assistant') as na from conversations group by conv_id)
select conv_id as doc_id, case when na = 0 then 'no answers' when conv_id % 5 = 4 then 'formats differ' when conv_id % 5 = 3 then 'text before the first answer' when conv_id % 5 = 2 then 'empty answer' when na <> nq then 'number of answers' end as problem
from q where nq > 0""")
def validate_file(spark, sf_dir):
    """Answer files of conversations: fitting ones, and by the conversation's number one of the ways not to."""
    flat = F.regexp_replace("text", r"\s+", " ")
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", flat.alias("t"))))), lambda x: F.concat(F.lit("x "), x["t"])).alias(n) for r, n in (("user", "q"), ("assistant", "a"))])
    kind = F.col("conv_id") % 5
    markdown = lambda c, word: F.array_join(F.transform(c, lambda t, i: F.concat(F.lit(f"## {word} "), (i + 1).cast("string"), F.lit("\n"), F.when((kind == 2) & (i == 0) & F.lit(word == "Answer"), " ").otherwise(t))), "\n\n")
    numbered = lambda c: F.array_join(F.transform(c, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")
    is_md = kind.isin(0, 2, 4)
    answers = F.when(kind == 4, numbered(F.col("a"))).when(is_md, markdown(F.col("a"), "Answer")).when(kind == 3, F.concat(F.lit("preface\n"), numbered(F.col("a")))).otherwise(numbered(F.col("a")))
    files = lists.where(F.size("q") > 0).select(F.col("conv_id").alias("doc_id"), F.when(is_md, markdown(F.col("q"), "Question")).otherwise(F.array_join("q", "\n")).alias("questions"), F.when(F.size("a") > 0, answers).otherwise("").alias("answers"))
    return evaluation.validate_files(files)


# ---------------------------------------------------------------- metrics


@query("with s as (select source, length(text) as n from documents) select source, count(*) as n_chunks, cast(floor(median(n)) as integer) as p50, cast(list_sort(list(n))[cast(floor((count(*) - 1) * 0.95) as bigint) + 1] as integer) as p95 from s group by source")
def chunk_size_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.lit("body").alias("kind"), "text")
    return evaluation.chunk_sizes(rows, "source")


@query("select cast(list_sort(list(n_chars))[cast(floor((count(*) - 1) * 0.95) as bigint) + 1] as bigint) as value from documents")
def floor_percentile(spark, sf_dir):
    return evaluation.floor_rank_of(table(spark, sf_dir, "documents"), "n_chars", 0.95)


@query(RETRIEVE + ", it as (select vec_id as question_id, case when vec_id // 20 % 2 = 0 then label || '.0' end as s, case when vec_id // 20 % 2 = 1 then 'f' || vec_id // 20 % 7 end as f from embeddings where vec_id % 20 = 0), h as (select it.question_id, s, f, coalesce(max(cast(c.section_number = s as int)), 0) as sh, coalesce(max(cast(c.fig = f as int)), 0) as fh from it left join (select question_id, section_number, fig from final join chunk using (chunk_id) where ord <= 5) c on c.question_id = it.question_id group by 1, 2, 3) select round(sum(case when s is not null then sh else 0 end) / greatest(1, count(s)), 3) as section_recall, round(sum(case when f is not null then fh else 0 end) / greatest(1, count(f)), 3) as figure_hit_rate, count(s) as n_factual, count(f) as n_figure from h")
def recall_at_k(spark, sf_dir):
    turn = (F.col("vec_id") / 20).cast("int")
    items = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.when(turn % 2 == 0, F.concat(F.col("label").cast("string"), F.lit(".0"))).alias("target_section"), F.when(turn % 2 == 1, F.concat(F.lit("f"), (turn % 7).cast("string"))).alias("target_figure"))
    return evaluation.recall_at(items, retrieval.retrieve(vector_chunks(spark, sf_dir), vector_plans(spark, sf_dir), LIMITS))


@query(LABELS + ", own as (select doc_id, number, char_end - char_start as n from sec) select doc_id, count(*) as n_sections, count(distinct number) as n_covered, round(count(distinct number) / greatest(1, count(*)), 3) as coverage from own group by doc_id")
def section_coverage(spark, sf_dir):
    p = parsed(spark, sf_dir, *C.PARTS)
    return evaluation.coverage(p, C.body_chunks(p))


@query("with a as (select regexp_replace(text, '^\\s+|\\s+$', '', 'g') as b from conversations where role = 'assistant') select count(*) as n_answers, round(count(*) filter (where b = '' or contains(lower(b), 'no answer')) / greatest(1, count(*)), 3) as refusal_rate, cast(floor(median(length(b))) as integer) as answer_len_p50, coalesce(round(avg(len(regexp_extract_all(b, '§\\d|Figure \\d|fig:|eq:'))), 2), 0) as grounding_density_mean from a")
def refusal_rate(spark, sf_dir):
    return evaluation.self_check(table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("text").alias("answer")))


@query("select doc_id from documents order by md5('42|' || doc_id), doc_id limit 20")
def hash_sample(spark, sf_dir):
    return evaluation.hash_sample(table(spark, sf_dir, "documents"), "doc_id", 20, 42).select("doc_id")


@query("select role as kind, count(*) as n from conversations group by role")
def counts_by_kind(spark, sf_dir):
    return evaluation.counts_by_kind(table(spark, sf_dir, "conversations").withColumnRenamed("role", "kind"))


@query("with m as (select lang, 'n' as metric, cast(count(*) as varchar) as v from documents group by lang), l as (select lang, '## ' || lang || chr(10) || string_agg('- **' || metric || '**: ' || v, chr(10) order by metric) as part from m group by lang) select string_agg(part, chr(10) || chr(10) order by lang) as report from l")
def eval_report(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("section")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return evaluation.render_report(counts.withColumn("metric", F.lit("n")))


# ---------------------------------------------------------------- fingerprints, JSON, figures


@query("select doc_id, substring(sha256(concat('v1'::blob, '\\x00'::blob, encode('d' || doc_id || '.tex'), '\\x00'::blob, encode(text), '\\x00'::blob)), 1, 16) as fingerprint, 1::bigint as n_files from documents".replace("concat(", "(").replace("'v1'::blob, '\\x00'::blob, encode('d' || doc_id || '.tex'), '\\x00'::blob, encode(text), '\\x00'::blob", "'v1'::blob || '\\x00'::blob || encode('d' || doc_id || '.tex') || '\\x00'::blob || encode(text) || '\\x00'::blob"))
def fingerprint_docs(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".tex")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return S.fingerprint(files)


def _files(spark, sf_dir, *named: tuple[str, Column]) -> DataFrame:
    """(doc_id, path, text): for every document the files given by path and text; null texts are no file."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), t.alias("text")) for p, t in named])).alias("f")).select("doc_id", "f.*").where("text is not null")


def _when(condition: str, text: Column) -> Column:
    return F.when(F.expr(condition), text)


@query("select doc_id, case doc_id % 3 when 0 then 'x/Tex_Source' when 1 then '' else '' end as root from documents")
def tex_root(spark, sf_dir):
    any_ = F.col("text")
    return S.tex_root(_files(spark, sf_dir, ("a/b/one.tex", any_), ("a/two.tex", any_), ("x/Tex_Source/deep/er/main.tex", _when("doc_id % 3 = 0", any_)), ("x/Tex_Source/fig.png", any_), ("top.tex", _when("doc_id % 3 = 1", any_))))


@query("select doc_id, case doc_id % 4 when 0 then 'paper.tex' when 1 then 'b.tex' when 2 then 'z.tex' else 'sections/only.tex' end as entry from documents")
def entry_point(spark, sf_dir):
    """One class among others; a class under a name that isn't an entry's; no class, more inputs first; one class in a folder of sections."""
    start, more = F.lit("\n \\documentclass{a}"), F.lit("\\input{a}\\include{b}")
    return S.entry_point(_files(
        spark, sf_dir, ("paper.tex", _when("doc_id % 4 = 0", F.concat(start, "text"))), ("many.tex", _when("doc_id % 4 = 0", F.concat(more, more, "text"))),
        ("macros.tex", _when("doc_id % 4 = 1", F.concat(start, more, "text"))), ("b.tex", _when("doc_id % 4 = 1", start)),
        ("fig/a.tex", _when("doc_id % 4 = 2", F.concat(more, more))), ("y.tex", _when("doc_id % 4 = 2", F.col("text"))), ("z.tex", _when("doc_id % 4 = 2", more)),
        ("sections/only.tex", _when("doc_id % 4 = 3", start)), ("main.tex", _when("doc_id % 4 = 3", F.concat(more, "text"))),
    ))


@query("select doc_id, unnest(['a', 'b', 'c']) as name, unnest(['two', source, 'kept']) as last, unnest(['one', 'style', 'kept']) as first_plain from documents")
def macro_sources(spark, sf_dir):
    files = _files(
        spark, sf_dir, ("preamble.tex", F.lit("\\newcommand{\\a}{two}")), ("macros.tex", F.lit("\\def\\a{one}")), ("sub/z.sty", F.lit("\\newcommand{\\b}{style}")),
        ("main.tex", F.concat(F.lit("\\newcommand{\\b}{"), "source", F.lit("}\\def\\c{kept}\\begin{document}\\newcommand{\\d}{no}"))), ("sub/macros.tex", F.lit("\\def\\e{no}")),
    )
    entries = files.select("doc_id").distinct().withColumn("entry", F.lit("main.tex"))
    return latex.glossary(latex.macros(S.macro_sources(files, entries), order_col="turn")).select("doc_id", "name", "last", "first_plain")


@query(r"select doc_id, md5('A[' || text || '|' || lang || ']B' || 'Z') as digest from documents")
def expand_inputs(spark, sf_dir):
    files = _files(spark, sf_dir, ("main.tex", F.lit("A\\input{sub/b}B\\subfile{sub/b.tex}\\include{none}Z")), ("sub/b.tex", F.concat(F.lit("["), "text", F.lit("\\input{main}|\\input{ c }]"))), ("sub/c.tex", F.col("lang")))
    entries = files.select("doc_id").distinct().withColumn("entry", F.lit("main.tex"))
    return latex.expand_inputs(files, entries).select("doc_id", F.md5("text").alias("digest"))


@query("select doc_id, lang || ' | ' || source as caption, 'q ' || doc_id || ' in ' || lang || ' {text}' as prompt from documents")
def prompt_fill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws(" | ", "lang", "source").alias("caption"), providers.filled("q {id} in {where}{none} {text}", id=F.col("doc_id"), where=F.col("lang"), none=F.lit(None)).alias("prompt"))


@query("select vec_id as question_id, case when vec_id % 40 = 0 then 'mini' else 'none' end as how from embeddings where vec_id % 20 = 0".replace("'mini'", "'exact'").replace("'none'", "'miss'"))
def qa_probe(spark, sf_dir):
    """Questions of a document: some kept word by word, the others without a vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), (F.col("vec_id") % 7).alias("doc_id"), F.concat(F.lit("What is "), "vec_id").alias("question"), "embedding")
    entries = rows.where("question_id % 40 <> 20").select(F.col("question_id").alias("entry_id"), "doc_id", F.concat(F.lit(" what is, "), "question_id", F.lit("?")).alias("question"), "embedding")
    asked = rows.where("question_id % 20 = 0").withColumn("embedding", F.array().cast("array<float>"))
    return qa_cache.lookup(asked, entries, by="doc_id").select("question_id", "how")


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first from events")
def json_salvage(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n``` done"))
    bare = T.salvage_json(fenced)
    value = F.from_json(bare, "map<string,string>")
    key = F.get(F.json_object_keys(bare), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(value, key).alias("first"))


@query("select doc_id, 'f' as label, case when doc_id % 3 = 0 then 'img/a' || doc_id || '.png' when doc_id % 3 = 1 then 'other/a' || doc_id || '.jpg' end as resolved_path from documents")
def figure_resolve(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = F.col("doc_id").cast("string")
    figs = docs.select("doc_id", F.lit("f").alias("label"), F.concat(F.lit("a"), n).alias("tex_path"))
    files = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("img/a"), n, F.lit(".png"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("other/a"), n, F.lit(".jpg"))).otherwise("none.txt").alias("path"))
    folders = S.graphics_paths(docs.withColumn("text", F.lit("\\graphicspath{{img/}{pics}}")))
    return S.resolve_figures(figs, files, folders).select("doc_id", "label", "resolved_path")


@query("select doc_id, 'Caption: ' || lang || ' | subject: ' || source || ' | numbers_visible: 1, 2' as description from documents")
def describe_flatten(spark, sf_dir):
    d = F.struct(F.col("source").alias("subject"), F.lit("").alias("axes_or_layout"), F.lit(None).cast("string").alias("takeaway"), F.array().cast("array<string>").alias("key_visual_elements"), F.array(F.lit("1"), F.lit("2")).alias("numbers_visible"))
    return table(spark, sf_dir, "documents").select("doc_id", T.flatten_description(F.col("lang"), d).alias("description"))


@query("select page_id, base64(encode(html)) as data from pages")
def base64_plain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.plain_base64(F.encode("html", "utf-8")).alias("data"))


# ---------------------------------------------------------------- the whole path


@query()
def answer_two_pass(spark, sf_dir):
    """A question of every document whose id is divisible by 20, answered from that document's chunks; half of them name a section's title."""
    from loomspan.plans.answering import answer

    p = materialize(structure.parse(tex(spark, sf_dir).where("doc_id % 20 = 0"), parts=C.PARTS, keep_text=True), "asked-of")
    sections = p.select("doc_id", F.inline("sections")).select("doc_id", "number", "title")
    asked = p.select("doc_id", F.col("doc_id").alias("question_id"), F.lit(1).alias("slot"), F.lit(1).alias("idx"), F.concat(F.lit("What shows "), F.substring("text", 30, 60)).alias("question"))
    return answer(asked, C.all_chunks(p), sections, limits=retrieval.Limits(least=0.1)).select("question_id", "slot", "how", "deferred", "fallback_used", F.size("doc_ids").alias("n_sources"), F.length("answer").alias("n_chars"))
