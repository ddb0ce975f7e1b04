"""URL filters by link-graph propagation, with DataFrame functions only.

A rule (host, path, verdict) fits a URL if its host is the rule's or a subdomain of it
and its path starts with the rule's; the longest fitting rule wins. Hosts with allowed
pages seed trust, hosts with blocked pages seed distrust, in proportion to those pages.
Trust follows links (personalised PageRank); distrust follows them backwards, to the
hosts that link to what is blocked. A host is blocked if its distrust exceeds its trust
by more than the distrust that blocking half of its own pages would seed; its pages
that no rule fits get the host's verdict.

Masses are integers (floor division), so every order of summation gives the same
result and the rounds reach a fixed point, where they end. Links are absolute or protocol-relative hrefs; several links between two hosts
are one edge, links inside a host none.

Null url, or one without "://": empty host and path, no rule, verdict of the empty host.
Null html has no links. Repeated rows count repeatedly as seeds. An empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm.common import LOWER, MAX_BROADCAST_ROWS, UPPER, checkpoint_dir, hot_join, lowered, saved, table

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SCALE = 10**12
DAMPING = 85  # per cent
#: Rounds between two checkpoints; a mass below 1 is none, so some 170 rounds are the most there can be.
ROUNDS = 5
#: Up to so many rules are literals of the plan; more are a joined table.
LITERAL_RULES = 1000
#: Parts that the links of a host are dealt to.
SALTS = 8
#: Steps that the SQL oracle takes: the given tables hold no cycle of links, so it is at the fixed point.
SQL_ROUNDS = 20
HREF = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]*)"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def with_host_path(pages: DataFrame) -> DataFrame:
    rest = F.coalesce(after_scheme(F.col("url")), F.lit(""))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.col("_rest").substr(F.length("_host") + 1, F.length("_rest")), r"^[^?#]*", 0)
    return pages.withColumn("_rest", rest).withColumn("_host", host).withColumn("path", path).withColumn("host", lowered(F.col("_host"))).drop("_rest", "_host")


_FIT = "struct<length:int,host:string,path:string,verdict:string>"


def fitting(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits host and path (of equally long ones the last by code point), or null."""
    out = F.lit(None).cast(_FIT)
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        own = F.struct(F.lit(len(host) + len(path)).alias("length"), F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, own).otherwise(out)
    return out


def with_fit(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows (host, path, ...) with _fit."""
    if len(rules) <= LITERAL_RULES:
        return rows.withColumn("_fit", fitting(rules))
    # a host's rules are those of the suffixes of its name that begin at a label
    table_ = rows.sparkSession.createDataFrame(rules, "_of string, _path string, _verdict string")
    hosts = rows.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = hosts.select("host", F.explode(suffixes).alias("_of")).join(table_, "_of")
    one = F.struct((F.length("_of") + F.length("_path")).alias("length"), F.col("_of").alias("host"), F.col("_path").alias("path"), F.col("_verdict").alias("verdict"))
    own = own.groupBy("host").agg(F.collect_list(one).alias("_rules"))
    fits = F.array_max(F.filter("_rules", lambda r: F.col("path").startswith(r["path"])))
    return hot_join(rows, own, ["host"], "left").withColumn("_fit", fits).drop("_rules")


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links (kind, a, b, deg): forwards for trust, backwards for distrust."""
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), 1))).alias("dst"))
    linked = linked.withColumn("dst", lowered(F.col("dst"))).where("dst <> '' and dst <> src").distinct()
    linked = saved(pages.sparkSession, linked, "links")
    out = hot_join(linked, linked.groupBy("src").agg(F.count("*").alias("deg")), ["src"]).select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "deg")
    back = hot_join(linked, linked.groupBy("dst").agg(F.count("*").alias("deg")), ["dst"]).select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "deg")
    return out.unionByName(back)


def propagate(seeds: DataFrame, edges: DataFrame, damping: int = DAMPING) -> DataFrame:
    """Masses (kind, host, mass) at the fixed point."""
    checkpoint_dir(seeds.sparkSession)
    edges, mass = edges.checkpoint(), seeds.checkpoint()
    if edges.isEmpty():
        return mass
    seeds, total = mass, None
    # a hub's many links: its hosts' masses are copied to SALTS parts of them
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))).checkpoint()
    salts = F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))).alias("salt")
    while True:
        for _ in range(ROUNDS):
            spread = mass.select("kind", F.col("host").alias("a"), "mass", salts)
            passed = spread.join(edges, ["kind", "a", "salt"]).select("kind", F.col("b").alias("host"), F.expr(f"(mass * {damping} div 100) div deg").alias("mass"))
            mass = seeds.unionByName(passed).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        mass = mass.checkpoint()
        # masses never shrink from round to round, so an equal total is a fixed point
        now = mass.agg(F.sum("mass")).first()[0]
        if now == total:
            return mass
        total = now


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], damping: int = DAMPING) -> DataFrame:
    """pages (page_id, url, html) with host, path, rule and verdict."""
    parsed = with_host_path(pages.select("page_id", "url", "html"))
    rows = with_fit(parsed, rules)
    known = F.col("_fit")["verdict"]
    hosts = rows.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count_if(known == "allow").alias("allowed"),
        F.count_if(known == "block").alias("blocked"),
    )
    checkpoint_dir(pages.sparkSession)
    hosts = hosts.checkpoint()
    sums = hosts.agg(F.sum("allowed"), F.sum("blocked")).first()
    unit = [SCALE * (100 - damping) // 100 // max(1, n or 0) for n in sums]
    seeds = hosts.where("allowed > 0").select(F.lit("trust").alias("kind"), "host", (F.col("allowed") * unit[0]).alias("mass")).unionByName(
        hosts.where("blocked > 0").select(F.lit("distrust").alias("kind"), "host", (F.col("blocked") * unit[1]).alias("mass"))
    )
    mass = propagate(seeds, host_edges(parsed), damping)
    by_host = mass.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0)).alias(k) for k in ("trust", "distrust")))
    scored = hosts.join(by_host, "host", "left").select(
        "host",
        ((F.coalesce("distrust", F.lit(0)) - F.coalesce("trust", F.lit(0))) * 2 > F.col("pages") * unit[1]).alias("_bad"),
    )
    bad = saved(pages.sparkSession, scored.where("_bad"), "blocked")
    few = bad.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    judged = rows.join(F.broadcast(bad), "host", "left") if few else hot_join(rows, bad, ["host"], "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.concat(F.col("_fit")["host"], F.col("_fit")["path"]).alias("rule"),
        F.coalesce(known, F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


def op3_sql() -> str:
    cases = {"rule": "", "verdict": ""}
    for host, path, verdict in sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        when = f" WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN "
        cases["rule"] += f"{when}'{host + path}'"
        cases["verdict"] += f"{when}'{verdict}'"
    href = HREF.replace("'", "''")
    share = SCALE * (100 - DAMPING) // 100
    steps = "".join(
        f"""
x{k} AS MATERIALIZED (
  SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
    SELECT kind, host, mass FROM seeds UNION ALL
    SELECT x.kind, e.b, (x.mass * {DAMPING} // 100) // e.deg FROM {f"x{k - 1}" if k else "seeds"} x JOIN edges e ON e.kind = x.kind AND e.a = x.host)
  GROUP BY kind, host),"""
        for k in range(SQL_ROUNDS)
    )
    return f"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
rows AS (
  SELECT page_id, html, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM cut)),
ruled AS (SELECT *, CASE{cases["rule"]} END AS rule, CASE{cases["verdict"]} END AS known FROM rows),
hosts AS (
  SELECT host, count(*) AS pages, count(*) FILTER (known = 'allow') AS allowed, count(*) FILTER (known = 'block') AS blocked
  FROM ruled GROUP BY host),
units AS (SELECT {share} // greatest(1, sum(allowed))::BIGINT AS t, {share} // greatest(1, sum(blocked))::BIGINT AS d FROM hosts),
linked AS (
  SELECT DISTINCT host AS src, translate(l, '{UPPER}', '{LOWER}') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS l FROM rows)
  WHERE l <> '' AND translate(l, '{UPPER}', '{LOWER}') <> host),
edges AS (
  SELECT 'trust' AS kind, src AS a, dst AS b, count(*) OVER (PARTITION BY src) AS deg FROM linked UNION ALL
  SELECT 'distrust', dst, src, count(*) OVER (PARTITION BY dst) FROM linked),
seeds AS (
  SELECT 'trust' AS kind, host, allowed * t AS mass FROM hosts, units WHERE allowed > 0 UNION ALL
  SELECT 'distrust', host, blocked * d FROM hosts, units WHERE blocked > 0),{steps}
bad AS (
  SELECT h.host FROM hosts h JOIN x{SQL_ROUNDS - 1} x ON x.host = h.host, units u
  GROUP BY h.host, h.pages, u.d
  HAVING 2 * sum(CASE x.kind WHEN 'trust' THEN -x.mass ELSE x.mass END) > h.pages * u.d)
SELECT page_id, host, path, rule,
       coalesce(known, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""
