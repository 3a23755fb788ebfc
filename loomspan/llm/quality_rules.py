"""Quality rules: a base of fixed rules, then robust multivariate outliers.

For each language and source the minimum covariance determinant (Rousseeuw & Van Driessen, 1999) of transformed
statistics is estimated by concentration steps from two fixed starts, reweighted, and documents beyond a chi-square
bound of Mahalanobis distance are rejected. Everything runs in DataFrame and SQL expressions.

Statistics are whole thousandths and their sums and cross products are exact, so estimates don't depend on the order of
partitions. A concentration step is one pass: documents are binned by distance to the current estimate, counts and sums
are aggregated by group and bin (with map-side combining; a few hundred bins a group), the bins up to the one that
completes the wanted share become the new subset. No group's rows are brought together, so a hot source costs no more
than others. Every document is judged: groups with fewer than ``MIN_GROUP`` documents are pooled by language; where that pool is
small too they are judged by the estimate of their whole language over all sources, or of the whole corpus if the language is small.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import named
from loomspan.plans.shared import materialize, release

MIN_WORDS, MAX_REPEAT = 50, 50
#: Share of a group in the subset of least determinant, concentration steps, documents below which groups are pooled.
SHARE, STEPS, MIN_GROUP = 0.75, 5, 100
#: Least standard deviation of each statistic, in thousandths: the regularisation that keeps constant statistics apart from zero.
FLOORS = (40, 60, 15, 40, 250)
#: Chi-square probabilities (5 degrees of freedom) of reweighting and rejection; tails are heavier than normal, so the latter is far out.
REWEIGHT_P, REJECT_BOUND = 0.975, 120.0
#: Groups up to which estimates are broadcast (5 means and 15 factors each); beyond it they are joined by an exchange.
BROADCAST_GROUPS = 50_000
D = 5
_SPACE = r"[\x20\x09-\x0D]+"


def _chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function of k / 2 at x / 2, by its series."""
    from math import exp, lgamma, log

    a, t = k / 2, x / 2
    if t <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= t / n
        total += term
    return total * exp(-t + a * log(t) - lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return lo


def consistency(share: float, k: int) -> float:
    """Factor that makes the covariance of the central ``share`` of normal data consistent."""
    return share / _chi2_cdf(chi2_quantile(share, k), k + 2)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper (all long, of the whole text; null counts as empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Built-in array functions are compiled; a lambda is called for each word, so there is one only for the windows.
    rows = docs.withColumn("__w", F.array_remove(F.split(text, _SPACE), ""))
    words = F.col("__w")
    window = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.withColumn("__h", F.when(F.size(words) >= 3, window))
    h = F.col("__h")
    # Only texts with a repeated window are sorted, with their positions.
    rows = rows.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("__s")
    twice = F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda x: x.isNotNull())
    rows = rows.withColumn("__p", F.sort_array(twice))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("__l", lines)
    plain = F.translate(text, "#*$%&|<>", "")
    return rows.select(
        *docs.columns,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(plain)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


#: Transformed statistics in thousandths, as SQL over the columns of ``with_statistics``.
VECTOR = (
    "cast(round(1000 * ln(word_chars / cast(n_words as double))) as bigint)",
    "cast(round(1000 * ln(1 + 10 * n_symbols / cast(n_words as double))) as bigint)",
    "cast(round(1000 * n_upper / cast(word_chars as double)) as bigint)",
    "cast(round(1000 * n_repeat_words / cast(n_words as double)) as bigint)",
    "cast(round(1000 * ln(1 + cast(n_dup_lines as double))) as bigint)",
)


def mcd_sql(source: str, exact: str, hint: str = "") -> tuple[list[tuple[str, str]], str]:
    """Named queries, each on the ones before, from ``source`` (g, row key, x1..x5) to ``verdict_estimate`` (g, means, factors). ``exact``: a SQL template that casts a
    whole number so that its sums are exact in the dialect at hand."""
    pairs = [(i, j) for i in range(1, D + 1) for j in range(1, i + 1)]
    sums = ", ".join([f"sum({exact.format(f'x{i}')}) as s{i}" for i in range(1, D + 1)] + [f"sum({exact.format(f'x{i} * x{j}')}) as s{i}{j}" for i, j in pairs])
    names = [f"s{i}" for i in range(1, D + 1)] + [f"s{i}{j}" for i, j in pairs]
    again = ", ".join(f"sum({x}) as {x}" for x in names)

    def estimate(factor: float) -> str:
        out = [f"cast(s{i} as double) / n as m{i}" for i in range(1, D + 1)]
        for i, j in pairs:
            ridge = f" + {FLOORS[i - 1] ** 2}" if i == j else ""
            out.append(f"{factor!r}e0 * (cast(s{i}{j} as double) / n - m{i} * m{j}){ridge} as v{i}{j}")
        for j in range(1, D + 1):  # Cholesky factor
            less = "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
            out.append(f"sqrt(greatest(v{j}{j}{less}, 1e0)) as l{j}{j}")
            for i in range(j + 1, D + 1):
                less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
                out.append(f"(v{i}{j}{less}) / l{j}{j} as l{i}{j}")
        out.append(" + ".join(f"ln(l{i}{i})" for i in range(1, D + 1)) + " as logdet")
        return ", ".join(out)

    def distance() -> str:
        out = []
        for i in range(1, D + 1):
            less = "".join(f" - l{i}{k} * z{k}" for k in range(1, i))
            out.append(f"(x{i} - m{i}{less}) / l{i}{i} as z{i}")
        return ", ".join(out) + ", " + " + ".join(f"z{i} * z{i}" for i in range(1, D + 1)) + " as d2"

    keep = ", ".join([f"m{i}" for i in range(1, D + 1)] + [f"l{i}{j}" for i, j in pairs] + ["logdet"])
    xs = ", ".join(f"x{i}" for i in range(1, D + 1))
    ctes = [("a0", f"select g, count(*) as n, {sums} from {source} group by g"), ("e0", f"select g, 1 as start, {keep} from (select g, n, {estimate(1.0)} from a0) t")]
    # Second start: the documents within a standard deviation of the mean in every coordinate.
    near = " and ".join(f"abs(x{i} - m{i}) <= 1e0 * sqrt(l{i}1 * l{i}1{''.join(f' + l{i}{k} * l{i}{k}' for k in range(2, i + 1))})" for i in range(1, D + 1))
    ctes.append(("a1", f"select {hint.format('e')} p.g, count(*) as n, {sums} from {source} p join e0 e on p.g = e.g where {near} group by p.g having count(*) >= {4 * D}"))
    ctes.append(("c0", f"select * from e0 union all select g, 2 as start, {keep} from (select g, n, {estimate(1.0)} from a1) t"))
    for k in range(1, STEPS + 1):
        ctes.append((f"d{k}", f"select g, start, {xs}, cast(floor(64 * ln(1 + d2)) as int) as bin from (select {hint.format('e')} p.g, start, {xs}, {distance()} from {source} p join c{k - 1} e on p.g = e.g) t"))
        ctes.append((f"b{k}", f"select g, start, bin, count(*) as n, {sums} from d{k} group by g, start, bin"))
        ctes.append((f"w{k}", f"select *, sum(n) over (partition by g, start order by bin) - n as before, sum(n) over (partition by g, start) as total from b{k}"))
        ctes.append((f"h{k}", f"select g, start, sum(n) as n, {again} from w{k} where before < {SHARE}e0 * total group by g, start"))
        ctes.append((f"c{k}", f"select g, start, {keep} from (select g, start, n, {estimate(1.0)} from h{k}) t"))
    last = f"c{STEPS}"
    # The start of least determinant; its covariance made consistent, then estimated anew from what lies within the bound.
    raw = consistency(SHARE, D)
    within = chi2_quantile(REWEIGHT_P, D) * raw
    ctes.append(("best", f"select * from (select *, row_number() over (partition by g order by logdet, start) as place from {last}) t where place = 1"))
    ctes.append(("rd", f"select g, {xs}, d2 from (select {hint.format('e')} p.g, {xs}, {distance()} from {source} p join best e on p.g = e.g) t"))
    ctes.append(("ra", f"select g, count(*) as n, {sums} from rd where d2 <= {within!r}e0 group by g"))
    ctes.append(("verdict_estimate", f"select g, {keep} from (select g, n, {estimate(consistency(REWEIGHT_P, D))} from ra) t"))
    return ctes, distance()


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``g``, the group whose estimate judges a row, and the rows of estimates: each group's own; for a small language's
    leftovers ("L") all rows of it, for those of languages that are small themselves ("a") all rows."""
    rows = rows.withColumns({"gl": F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")), "gs": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))})
    counts = materialize(rows.groupBy("gl", "gs").agg(F.count(F.lit(1)).alias("k")), "counts")
    by_lang = counts.groupBy("gl").agg(F.coalesce(F.sum(F.when(F.col("k") < MIN_GROUP, F.col("k"))), F.lit(0)).alias("kl"), F.sum("k").alias("kt"))
    g = F.when(F.col("k") >= MIN_GROUP, F.concat_ws(" ", F.lit("s"), "gl", "gs")).when(F.col("kl") >= MIN_GROUP, F.concat_ws(" ", F.lit("l"), "gl")).when(F.col("kt") >= MIN_GROUP, F.concat_ws(" ", F.lit("L"), "gl")).otherwise("a")
    names = materialize(counts.join(by_lang, "gl").select("gl", "gs", g.alias("g")), "groups")
    side = F.broadcast(names) if names.count() <= BROADCAST_GROUPS else names
    named_rows = materialize(rows.join(side, ["gl", "gs"]), "vectors")
    values = [f"x{i}" for i in range(1, D + 1)]
    estimated = named_rows.where("substring(g, 1, 1) in ('s', 'l')").select("g", *values)
    wide = names.where("substring(g, 1, 1) = 'L'").select("gl", "g").distinct()
    if not wide.isEmpty():
        estimated = estimated.unionByName(named_rows.drop("g").join(wide, "gl").select("g", *values))
    if not names.where("g = 'a'").isEmpty():
        estimated = estimated.unionByName(named_rows.select(F.lit("a").alias("g"), *values))
    release(counts)
    return named_rows.drop("gl", "gs"), estimated


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept) for every row. Null languages
    and sources are groups of their own; rows that failed the base, as null and empty texts do, aren't judged (d2 is null) nor estimated
    from. Long texts are read whole; rows that repeat an id, or have none, are documents each; of tied estimates the first start counts.
    Only the four named columns are read, so no other name clashes; an empty table gives no row."""
    spark: SparkSession = docs.sparkSession
    picked = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).cast("string").alias("lang"), named(source_col).cast("string").alias("source"))
    own = materialize(with_statistics(picked).drop("text").withColumn("base_failed", base_failed()), "statistics")
    good = own.where("not base_failed")
    good, estimated = _groups(good.select("*", *[F.expr(x).alias(f"x{i}") for i, x in enumerate(VECTOR, 1)]))
    name = f"loomspan_vectors_{uuid.uuid4().hex}"
    estimated.createOrReplaceTempView(name)
    few = good.select("g").distinct().count() <= BROADCAST_GROUPS
    hint = "/*+ BROADCAST({}) */" if few else ""
    steps, distance = mcd_sql(name, "cast({} as decimal(20, 0))", hint)
    views = {}
    for step, query in steps:
        for known, view in views.items():
            query = re.sub(rf"\b(from|join) {known}\b", rf"\1 {view}", query)
        estimate = spark.sql(query)
        if step[0] in "ecv":  # estimates, one row a group and start: written, so that plans stay short
            estimate = materialize(estimate, "estimates")
        views[step] = f"{name}_{step}"
        estimate.createOrReplaceTempView(views[step])
    for view in (name, *views.values()):
        spark.catalog.dropTempView(view)
    judged = good.join(F.broadcast(estimate) if few else estimate, "g", "left")
    for part in _split(distance):
        expr, alias = part.rsplit(" as ", 1)
        judged = judged.withColumn(alias, F.expr(expr))
    columns = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = judged.select(*columns, F.expr("cast(d2 as double)").alias("d2"), (F.coalesce(F.col("d2"), F.lit(0.0)) <= REJECT_BOUND).alias("kept"))
    failed = own.where("base_failed").select(*columns, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)


def _split(distance: str) -> list[str]:
    return distance.split(", ")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, the five statistics, base_failed and kept for every document."""
    from loomspan.llm.common import table

    return judge(table(spark, sf_dir, "documents")).drop("d2").withColumnRenamed("id", "doc_id")


def op2_sql() -> str:
    base = r"""
with w as (
  select doc_id, lang, source, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select doc_id, count(distinct p) as n_repeat_words from (
  select doc_id, unnest([i, i + 1, i + 2]) as p from (select doc_id, i, count(*) over (partition by doc_id, s) as c from win) where c > 1) group by doc_id),
ls as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w),
stat as (
  select doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%%&|<>', '')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    cast(length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) as bigint) as n_upper
  from w join ls using (doc_id) left join rep using (doc_id)),
own as (select *, n_words < %d or 100 * n_repeat_words > %d * n_words as base_failed from stat),
keyed as (select *, coalesce('=' || lang, '-') as gl, coalesce('=' || source, '-') as gs from own where not base_failed),
counts as (select gl, gs, count(*) as k from keyed group by gl, gs),
by_lang as (select gl, coalesce(sum(k) filter (where k < %d), 0) as kl, sum(k) as kt from counts group by gl),
names as (select gl, gs, case when k >= %d then 's ' || gl || ' ' || gs when kl >= %d then 'l ' || gl when kt >= %d then 'L ' || gl else 'a' end as g from counts join by_lang using (gl)),
vectors as (select keyed.*, g, %s from keyed join names using (gl, gs)),
estimated as (
  select g, x1, x2, x3, x4, x5 from vectors where g[1] in ('s', 'l')
  union all select w.g, x1, x2, x3, x4, x5 from vectors v join (select distinct gl, g from names where g[1] = 'L') w using (gl)
  union all select 'a', x1, x2, x3, x4, x5 from vectors where exists (select 1 from names where g = 'a')),
""" % (MIN_WORDS, MAX_REPEAT, *[MIN_GROUP] * 4, ", ".join(f"{x} as x{i}" for i, x in enumerate(VECTOR, 1)))  # fmt: skip
    ctes, distance = mcd_sql("estimated", "cast({} as hugeint)")
    end = f"""
,judged as (select v.*, {distance} from vectors v left join verdict_estimate e on v.g = e.g)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(d2, 0) <= {REJECT_BOUND!r}e0 as kept from judged
union all
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, false from own where base_failed
"""
    return base + ",\n".join(f"{name} as ({query})" for name, query in ctes) + end
