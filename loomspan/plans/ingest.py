"""Ingest: from source files to stored structure, chunks, figures and maps. Only documents whose fingerprint is new are read."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import chunks as C
from loomspan.operators import digest, latex, providers, structure
from loomspan.operators import services as S
from loomspan.plans.shared import materialize, release
from loomspan.sources import files as files_
from loomspan.sources.store import Store, log_run
from loomspan.sources.tables import KeyedTable

ENTITIES = ("structure", "chunks", "figures", "images", "maps", "glossary")


@dataclass
class Artifacts:
    """Tables of ingested documents."""

    structure: DataFrame
    chunks: DataFrame
    figures: DataFrame
    images: DataFrame
    maps: DataFrame
    glossary: DataFrame
    #: How many documents are new, changed, same and deleted.
    counts: dict[str, int] = field(default_factory=dict)
    timings: dict[str, float] = field(default_factory=dict)

    @property
    def reused(self) -> bool:
        return not set(self.counts) - {"same"}


def read_folder(spark: SparkSession, folder: str, doc_id: int = 0) -> DataFrame:
    """(doc_id, path, content) of one article's folder, paths relative to its TeX root; a folder without a .tex file is an error."""
    rows = files_.listing(spark, folder)
    base = F.regexp_replace(F.lit(folder.rstrip("/")), "^[a-z]+:/*", "/")
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rows = rows.select(F.lit(doc_id).cast("long").alias("doc_id"), F.substr(path, F.length(base) + 2).alias("path"), "content")
    roots = materialize(files_.tex_root(rows), "roots")
    if roots.isEmpty():
        raise FileNotFoundError(f"no .tex file in {folder}")
    return files_.under_root(rows, roots)


def sources(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expanded and cleaned texts (doc_id, text), and the macros that documents define (doc_id, name, last)."""
    decoded = files.where(F.col("path").rlike(r"\.(?:tex|sty)$")).select("doc_id", "path", files_.decode("content").alias("text"))
    tex = decoded.where(F.col("path").endswith(".tex"))
    entries = files_.entry_point(tex)
    raw = materialize(latex.expand_inputs(tex, entries), "expanded")
    every = files_.macro_sources(decoded, entries).unionByName(raw.select("doc_id", F.lit("4").alias("turn"), "text"))
    defined = materialize(latex.glossary(latex.macros(every, order_col="turn")), "macros")
    known = defined.where("first_plain is not null").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "name", "first_plain"))), lambda m: F.struct(m["name"].alias("name"), m["first_plain"].alias("body"))).alias("known"))
    none = F.array().cast("array<struct<name:string,body:string>>")
    cleaned = raw.join(known, "doc_id", "left").select("doc_id", latex.clean(F.col("text"), F.coalesce("known", none)).alias("text"))
    return cleaned, defined.select("doc_id", "name", "last")


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, article, path, content) of every article below ``root``, one folder each, paths relative to its TeX root. The id is a hash of
    the folder's name, so it stays when articles come and go; folders without a .tex file have no row."""
    rows = files_.listing(spark, root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    path = F.substr(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.length(base) + 2)
    rows = rows.select(F.split_part(path, F.lit("/"), F.lit(1)).alias("article"), path.alias("path"), "content").where(F.col("path") != F.col("article"))
    rows = rows.select(F.xxhash64("article").alias("doc_id"), "article", F.substr("path", F.length("article") + 2).alias("path"), "content")
    return files_.under_root(rows, materialize(files_.tex_root(rows), "roots"))


def ingest(files: DataFrame, store: Store, summarize: S.Chat | None = None, vision: S.Vision | None = None, vision_seconds: float = S.VISION_TOTAL_S) -> Artifacts:
    """Everything from ``files`` (doc_id, path, content). Documents whose .tex files have the fingerprint that the manifest holds aren't read
    again; new and changed ones are parsed and stand for what was stored of them, and what is stored of others that are gone, goes. A
    run that breaks off leaves the manifest as it was, so the next one takes up the same documents."""
    took: dict[str, float] = {}
    keyed = lambda name: store.keyed(name, ["doc_id"])
    with S.measured("ingest_s", took):
        prints = materialize(files_.fingerprint(files.where(F.col("path").endswith(".tex"))), "fingerprints")
        changes = materialize(store.changes(prints, list(ENTITIES), files_.SCHEMA_VERSION), "changes")
        counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
        todo = changes.where("change in ('new', 'changed')").select("doc_id")
        gone = changes.where("change <> 'same'").select("doc_id")
        if set(counts) - {"same"}:
            _reingest(files.join(todo, "doc_id", "left_semi"), gone, keyed, took, summarize, vision, vision_seconds)
            # last: a broken run is not taken for a finished one
            fresh = prints.join(todo, "doc_id", "left_semi").withColumns({"version": F.lit(files_.SCHEMA_VERSION), "ts": F.lit(time.time())})
            keyed("manifest").upsert(fresh, gone)
            for name in (*ENTITIES, "manifest"):
                keyed(name).compact()
                keyed(name).vacuum()
            log_run(store.spark, f"{store.root}/log", took)
        release(prints, changes)
    return Artifacts(*(store.load(n) for n in ENTITIES), counts=counts, timings=took)


def _reingest(files: DataFrame, gone: DataFrame, keyed: Callable[[str], KeyedTable], took: dict[str, float], summarize: S.Chat | None, vision: S.Vision | None, vision_seconds: float) -> None:
    """Stores all entities of the documents of ``files`` in place of those of the documents of ``gone``."""
    held: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        held.append(materialize(df, name))
        return held[-1]

    def put(name: str, df: DataFrame) -> DataFrame:
        """The rows of these documents, to go on with."""
        keyed(name).upsert(kept(df, name), gone)
        return held[-1]

    with S.measured("structure_s", took):
        texts, macros = sources(files)
        glossary = put("glossary", macros)
        parsed = put("structure", structure.parse(texts, parts=(*structure.WHOLE, "bodies", "surroundings")))
    with S.measured("figures_s", took):
        raw = parsed.select("doc_id", F.inline(F.arrays_zip(F.col("figures").alias("f"), F.col("surroundings").alias("s")))).select("doc_id", "f.label", "f.tex_path", "f.caption", "f.char_pos", F.col("f.section_title").alias("section_path"), "s.*")
        resolved = kept(files_.resolve_figures(raw, files, files_.graphics_paths(parsed)).select("doc_id", "label", "resolved_path").dropDuplicates(["doc_id", "label"]), "resolved")
        images = files_.images(resolved, files).join(raw.select("doc_id", "label", "caption").dropDuplicates(["doc_id", "label"]), ["doc_id", "label"])
        images = put("images", images)
        described = providers.describe(raw, images, vision, deadline=S.Deadline.after(vision_seconds))
        figures = put("figures", described.join(resolved, ["doc_id", "label"], "left"))
    with S.measured("chunks_s", took):
        summarized = kept(providers.summaries(parsed, summarize), "summaries")
        put("chunks", C.all_chunks(parsed, summarized, figures))
    with S.measured("maps_s", took):
        put("maps", digest.article_map(parsed, figures, glossary))
    release(*held)
