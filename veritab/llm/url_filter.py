"""URL filters: path rules, then link-graph propagation for hosts without a rule.

DataFrame functions only. A url's verdict is its longest fitting rule's. For the others
the host decides: trust flows from hosts with allowed pages along links
(personalised PageRank), distrust flows from hosts with blocked pages
against links, so that who links to a blocked host shares its distrust. Seeds have the
share of their pages that a rule allows or blocks.

Scores are in units of what a jump gives to a host whose pages are all allowed (or blocked): a host has its own share,
and ``damping`` of what its neighbours pass on. What a host without further links would pass on goes back to
the seeds, which in these units changes nothing; so it piles up nowhere. A host is blocked when its distrust
reaches ``cut`` and exceeds its trust: a quarter of its own pages, say, or links of its own to a
blocked host that has up to three hosts linking to it. Steps go on until no score changes by more than ``tolerance``, 40 of them at most
(what is then still to come is 0.85 ** 40 of what was passed on).

Edges are the distinct pairs of hosts with a link between, weighted by the share of
the linking (or linked) pages. Pages are aggregated to hosts before anything is joined, each iteration writes its
small table to the shared folder, and hosts to block are sent to all tasks only when few.

Defined results: a null url or one without :// has an empty host and path and no rule, and
is allowed. Null html has no links. Repeated rows weigh as pages of their own. Empty tables
give no rows. Extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import staged

#: Verdict, host and path of each rule of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Hosts to block up to which they are sent to every task.
SMALL = 200_000
#: Hosts in links of a page that name one.
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
#: Digits behind the point to which scores are compared.
DIGITS = 6


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def with_host_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path of the url; columns of these names are replaced."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.withColumns({"host": lower_ascii(host), "path": path})


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))


def longest_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) as columns, null where none fits; rules are tried from the longest on."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = [(fits(F.col("host"), F.col("path"), h, p), h + p, v) for v, h, p in ordered]
    pick = lambda k: F.coalesce(*[F.when(c[0], F.lit(c[k])) for c in cases], F.lit(None).cast("string"))
    return pick(1), pick(2)


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, pages): distinct pairs of different hosts, and how many pages link so."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)), lower_ascii))).alias("dst"))
    return links.where("src != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def flows(edges: DataFrame) -> DataFrame:
    """(at, to, trust, distrust): shares that a host passes on; trust along links, distrust against them."""
    out = edges.groupBy("src").agg(F.sum("pages").alias("total"))
    along = edges.join(out, "src").select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("pages") / F.col("total")).alias("trust"), F.lit(0.0).alias("distrust"))
    into = edges.groupBy("dst").agg(F.sum("pages").alias("total"))
    against = edges.join(into, "dst").select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("trust"), (F.col("pages") / F.col("total")).alias("distrust"))
    return along.unionByName(against)


def propagate(seeds: DataFrame, edges: DataFrame, iterations: int = 40, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """(host, trust, distrust) when no score changes by more than the tolerance, or after all steps. seeds: (host, trust, distrust)."""
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    nodes = linked.join(seeds, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    nodes = staged(nodes, "hosts")
    if edges.isEmpty():
        return nodes  # every host keeps what it has
    passed = staged(flows(edges), "flows")
    own = nodes.withColumnsRenamed({"trust": "own_trust", "distrust": "own_distrust"})
    scores = nodes
    for _ in range(iterations):
        sent = passed.withColumnsRenamed({"trust": "t", "distrust": "d"}).join(scores.withColumnRenamed("host", "at").select("at", "trust", "distrust"), "at")
        got = sent.groupBy(F.col("to").alias("host")).agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        last = scores.select("host", F.col("trust").alias("last_trust"), F.col("distrust").alias("last_distrust"))
        scores = own.join(got, "host", "left").join(last, "host").select(
            "host",
            (F.col("own_trust") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (F.col("own_distrust") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
            "last_trust",
            "last_distrust",
        )
        scores = staged(scores, "scores")
        change = F.greatest(F.abs(F.col("trust") - F.col("last_trust")), F.abs(F.col("distrust") - F.col("last_distrust")))
        if scores.agg(F.max(change)).first()[0] <= tolerance:
            break
    return scores.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, cut: float = 0.25, iterations: int = 40, damping: float = 0.85, id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) of each page."""
    rule, ruled = longest_rule(rules)
    judged = with_host_path(pages.select(id_col, "url", "html")).withColumns({"rule": rule, "ruled": ruled})
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    seeds = judged.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    edges = staged(host_edges(judged), "edges")
    scores = propagate(seeds, edges, iterations, damping)
    distrust, trust = F.round("distrust", DIGITS), F.round("trust", DIGITS)
    bad = staged(scores.where((distrust >= cut) & (distrust > trust)).select("host", F.lit("block").alias("by_host")), "blocked")
    if bad.count() <= SMALL:
        bad = F.broadcast(bad)
    verdict = F.coalesce("ruled", "by_host", F.lit("allow"))
    return judged.drop("url", "html").join(bad, "host", "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"))


def duckdb_sql(cut: float = 0.25, iterations: int = 40, damping: float = 0.85) -> str:
    """The same over RULES in DuckDB SQL, with the steps written out."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    case = lambda k: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[k]}'" for v, h, p in ordered) + " END"
    steps = "".join(
        f""",
s{i + 1} AS MATERIALIZED (SELECT n.host, n.trust + {damping} * coalesce(g.t, 0) AS trust, n.distrust + {damping} * coalesce(g.d, 0) AS distrust
      FROM n LEFT JOIN (SELECT f."to", sum(f.t * s.trust) AS t, sum(f.d * s.distrust) AS d FROM f JOIN s{i} s ON s.host = f."at" GROUP BY 1) g ON g."to" = n.host)"""
        for i in range(iterations)
    )
    lower = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, html, {lower("raw")} AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
j AS (SELECT *, {case(0)} AS rule, {case(1)} AS ruled FROM p),
l AS (SELECT DISTINCT page_id, host AS src, {lower("dst")} AS dst FROM (SELECT page_id, host, unnest(regexp_extract_all(html, 'href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1, 'i')) AS dst FROM j)),
e AS MATERIALIZED (SELECT src, dst, count(*) AS pages FROM l WHERE src <> '' AND src <> dst GROUP BY 1, 2),
seeds AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM j WHERE host <> '' GROUP BY 1),
n AS MATERIALIZED (SELECT host, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM (SELECT src AS host FROM e UNION SELECT dst FROM e) x FULL JOIN seeds USING (host)),
f AS MATERIALIZED (SELECT src AS "at", dst AS "to", pages / sum(pages) OVER (PARTITION BY src) AS t, 0.0 AS d FROM e
      UNION ALL SELECT dst, src, 0.0, pages / sum(pages) OVER (PARTITION BY dst) FROM e),
s0 AS (SELECT * FROM n){steps}
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.ruled, CASE WHEN round(s.distrust, {DIGITS}) >= {cut} AND round(s.distrust, {DIGITS}) > round(s.trust, {DIGITS}) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s{iterations} s ON s.host = j.host
"""
