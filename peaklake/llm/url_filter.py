"""Operator 3: URL filter by a path-template tree.

The paths of each host form a tree of segments. Level by level, variable segments become wildcards (numbers and long
hex names ``#``; where a node's children have hardly any page each, those without enough pages or labels of their own
``*``), and sibling branches whose labelled shares of good pages do not differ significantly are merged into one. What
remains are templates; one is rejected if its smoothed share of good labelled pages is below a threshold. A given rule
list goes first.

Everything works on a table of distinct (host, path) with counts: the groups are combined before they are shuffled, and
a node hands one row per smoothed purity to the window that merges, at most as many as pairs of counts can share its
labels. There are as many levels as the deepest path has segments; each reads only the rows that go on.

Defined results: a null url or one without ``://`` has empty host and path and, like any other host, a template of its
own; null and repeated page ids give one row each; labels of unknown pages count for nothing, several labels of one page
all count; without any labels nothing is rejected; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peaklake.llm.common import workspace
from peaklake.llm.licenses import LOWER, UPPER

NAMED = 64  # branches merged from more segments are named by the first of them, their number and a hash
FEW = 8  # from so many children on, fewer than two pages each are a variable segment; so many pages or labels support a child
STRENGTH = 8.0  # pseudo-labels at the global share
DIFFERENT = 1.96  # two-proportion z
THRESHOLD = 0.5
NUMBER = r"^[0-9]+([.][a-z0-9]+)?$|^[0-9a-f-]{16,}$"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed by the contract of the query.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule], field) -> Column:
    """``field(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(field(r))).otherwise(out)
    return out


def _segment(path: Column, level: int) -> Column:
    part = F.split_part(path, F.lit("/"), F.lit(level + 2))
    return F.when(part.rlike(NUMBER), "#").when(part != "", part)


def _levels(path: Column) -> Column:
    """Number of segments up to the last one that is not empty."""
    kept = F.rtrim(path, F.lit("/"))
    return F.length(kept) - F.length(F.replace(kept, F.lit("/"), F.lit("")))


def templates(sites: DataFrame) -> DataFrame:
    """(host, path, template, purity) of ``sites``: host, path, n, lab, good, staged."""
    work = workspace(sites.sparkSession, "url-templates")
    totals = sites.agg(F.sum("lab").alias("lab"), F.sum("good").alias("good"), F.max(_levels(F.col("path"))).alias("deepest")).first()
    prior = totals["good"] / totals["lab"] if totals["lab"] else 1.0
    rows = sites.select("host", "path", "n", "lab", "good", _levels(F.col("path")).alias("levels"), F.lit("").alias("t"))
    ended = [rows.where("levels = 0")]
    for level in range(totals["deepest"] or 0):
        going = rows.where(F.col("levels") > level).withColumn("seg", _segment(F.col("path"), level))
        rows = work.stage(_generalise(going, prior).drop("seg"), f"level{level}")
        ended.append(rows.where(F.col("levels") == level + 1))
    rows = reduce(DataFrame.unionByName, ended)
    purity = ((F.sum("good") + STRENGTH * prior) / (F.sum("lab") + STRENGTH)).alias("purity")
    judged = rows.groupBy("host", "t").agg(purity)
    return rows.select("host", "path", "t").join(judged, ["host", "t"]).withColumnRenamed("t", "template")


def _generalise(rows: DataFrame, prior: float) -> DataFrame:
    """Extend the template ``t`` by the segment ``seg``."""
    node = ["host", "t"]
    kids = rows.where("seg IS NOT NULL").groupBy(*node, "seg").agg(*[F.sum(c).alias(c) for c in ("n", "lab", "good")])
    sizes = kids.where("seg <> '#'").groupBy(*node).agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("pages"))
    sparse = sizes.select(*node, ((F.col("kids") >= FEW) & (F.col("pages") < 2 * F.col("kids"))).alias("sparse"))
    supported = (F.col("n") >= FEW) | (F.col("lab") >= FEW)
    plain = kids.where("seg <> '#'").join(sparse, node).where(~F.col("sparse") | supported)
    weight = F.col("lab") + STRENGTH
    plain = plain.select(*node, "seg", weight.alias("w"), (F.col("good") + STRENGTH * prior).alias("g"))
    # segments of one purity are never cut; the first and the last of them meet the neighbours
    pure = plain.groupBy(*node, (F.col("g") / F.col("w")).alias("p")).agg(
        *[by(c, "seg").alias(f"{c}{end}") for c in "gw" for by, end in ((F.min_by, "1"), (F.max_by, "9"))]
    )
    near = Window.partitionBy(*node).orderBy("p")
    w0, g0 = F.lag("w9").over(near), F.lag("g9").over(near)
    pooled = (F.col("g1") + g0) / (F.col("w1") + w0)
    z = (F.col("g1") / F.col("w1") - g0 / w0) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("w1") + 1 / w0))
    cut = pure.withColumn("cut", F.when(z >= DIFFERENT, 1).otherwise(0))
    cut = cut.select(*node, "p", F.sum("cut").over(near.rowsBetween(Window.unboundedPreceding, 0)).alias("branch"))
    branch = plain.select(*node, "seg", (F.col("g") / F.col("w")).alias("p")).join(cut, [*node, "p"])
    size = branch.groupBy(*node, "branch").agg(
        F.count(F.lit(1)).alias("size"), F.min("seg").alias("first"), F.bit_xor(F.xxhash64("seg")).alias("hash")
    )
    branch = branch.join(size, [*node, "branch"])
    whole = branch.where(F.col("size") <= NAMED).groupBy(*node, "branch").agg(F.array_join(F.array_sort(F.collect_list("seg")), "|").alias("whole"))
    short = F.concat("first", F.lit("|+"), F.col("size") - 1, F.lit(":"), F.lower(F.hex("hash")))
    names = branch.join(whole, [*node, "branch"], "left").select(*node, "seg", F.coalesce("whole", short).alias("name"))
    step = F.when(F.col("seg") == "#", "#").otherwise(F.coalesce("name", F.lit("*")))
    return (
        rows.join(names, [*node, "seg"], "left")
        .withColumn("t", F.when(F.col("seg").isNull(), F.col("t")).otherwise(F.concat("t", F.lit("/"), step))).drop("name")
    )


def judge(
    pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[UrlRule] = RULES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template and purity.

    ``labelled``: (host, path, good 0/1) of known pages, several rows of a path count each.
    """
    work = workspace(pages.sparkSession, "url-filter")
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    counted = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    known = labelled.groupBy("host", "path").agg(F.count(F.lit(1)).alias("lab"), F.sum("good").alias("good"))
    sites = counted.join(known, ["host", "path"], "left").fillna(0, ["lab", "good"])
    found = templates(work.stage(sites, "sites"))
    by_rule = rule_of(F.col("host"), F.col("path"), rules, lambda r: r.verdict)
    return urls.join(found, ["host", "path"]).select(
        id_col, "host", "path", rule_of(F.col("host"), F.col("path"), rules, lambda r: r.host + r.path).alias("rule"),
        F.coalesce(by_rule, F.when(F.col("purity") < threshold, "block").otherwise("allow")).alias("verdict"),
        F.concat("host", "template").alias("template"), F.round("purity", 9).alias("purity"),
    )


def labels_by_number(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of documents for pages that name the document by the last number of the path."""
    path = path_of(F.col("url"))
    number = F.regexp_extract(path, "([0-9]{1,18})[^0-9]*$", 1)
    named = pages.select(host_of(F.col("url")).alias("host"), path.alias("path"), number.try_cast("bigint").alias("doc_id"))
    good = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    return named.join(labels.select("doc_id", good.alias("good")).where("good is not null"), "doc_id").select("host", "path", "good")


#: Where the SQL ends: it knows so many levels, the last one with the rest of the path, and so many children.
DEPTH, MAX_CHILDREN = 4, 64


def oracle_sql() -> str:
    """The rule for paths of up to ``DEPTH`` segments, nodes of up to ``MAX_CHILDREN`` and no supported child in a sparse one."""
    def rule(field) -> str:
        out = "NULL"
        for r in sorted(RULES, key=lambda r: len(r.host + r.path)):
            out = f"CASE WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{field(r)}' ELSE {out} END"
        return out

    parts = [f"split_part(path, '/', {i + 2})" for i in range(DEPTH - 1)]
    parts.append("regexp_extract(path, '(?s)^" + "[^/]*/" * DEPTH + "(.*)$', 1)")
    segs = ", ".join(f"CASE WHEN regexp_matches({p}, '{NUMBER}') THEN '#' WHEN {p} <> '' THEN {p} END AS s{i}" for i, p in enumerate(parts))
    more = ", ".join(f"s{i}" for i in range(DEPTH))
    ctes = []
    for i in range(DEPTH):
        ctes.append(f"""k{i} AS (SELECT host, t, s{i} AS seg, sum(n) AS n, sum(lab) AS lab, sum(good) AS good FROM r{i} WHERE s{i} IS NOT NULL GROUP BY ALL),
z{i} AS (SELECT host, t, count(*) > {MAX_CHILDREN} OR (count(*) >= {FEW} AND sum(n) < 2 * count(*)) AS wild FROM k{i} WHERE seg <> '#' GROUP BY ALL),
p{i} AS (SELECT host, t, seg, lab + CAST({STRENGTH} AS DOUBLE) AS w, good + {STRENGTH} * prior AS g FROM k{i} JOIN z{i} USING (host, t), q WHERE seg <> '#' AND NOT wild),
c{i} AS (SELECT *, CASE WHEN (g / w - lag(g) OVER o / lag(w) OVER o) / sqrt((g + lag(g) OVER o) / (w + lag(w) OVER o) * (1 - (g + lag(g) OVER o) / (w + lag(w) OVER o)) * (1 / w + 1 / lag(w) OVER o)) >= {DIFFERENT}
  THEN 1 ELSE 0 END AS cut FROM p{i} WINDOW o AS (PARTITION BY host, t ORDER BY g / w, seg)),
b{i} AS (SELECT *, sum(cut) OVER (PARTITION BY host, t ORDER BY g / w, seg ROWS UNBOUNDED PRECEDING) AS branch FROM c{i}),
n{i} AS (SELECT host, t, seg, string_agg(seg, '|') OVER (PARTITION BY host, t, branch ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS name FROM b{i}),
r{i + 1} AS (SELECT r.host, r.path, r.n, r.lab, r.good, {more},
  CASE WHEN s{i} IS NULL THEN r.t ELSE r.t || '/' || CASE WHEN s{i} = '#' THEN '#' WHEN wild THEN '*' ELSE name END END AS t
  FROM r{i} r LEFT JOIN z{i} z ON r.host = z.host AND r.t = z.t LEFT JOIN n{i} m ON r.host = m.host AND r.t = m.t AND r.s{i} = m.seg)""")
    return f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT host, path, count(*) AS lab, sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
  FROM u JOIN labels ON TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) = labels.doc_id WHERE quality IS NOT NULL GROUP BY ALL),
q AS (SELECT coalesce(sum(good) / CAST(sum(lab) AS DOUBLE), 1.0) AS prior FROM (SELECT DISTINCT host, path FROM u) JOIN l USING (host, path)),
r0 AS (SELECT host, path, n, coalesce(lab, 0) AS lab, coalesce(good, 0) AS good, {segs}, '' AS t FROM (SELECT host, path, count(*) AS n FROM u GROUP BY ALL) LEFT JOIN l USING (host, path)),
{', '.join(ctes)},
j AS (SELECT host, t, (sum(good) + {STRENGTH} * any_value(prior)) / (sum(lab) + {STRENGTH}) AS purity FROM r{DEPTH}, q GROUP BY ALL)
SELECT page_id, host, path, {rule(lambda r: r.host + r.path)} AS rule,
  coalesce({rule(lambda r: r.verdict)}, CASE WHEN purity < {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  host || t AS template, round(CAST(purity AS DOUBLE), 9) AS purity
FROM u JOIN r{DEPTH} USING (host, path) JOIN j USING (host, t)"""
