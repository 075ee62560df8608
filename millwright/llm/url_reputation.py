"""URL filtering by rules, and by the reputation of hosts where no rule fits.

A rule is a host and a path prefix; it fits that host and all its subdomains if the address's path starts with the
prefix; the longest fitting rule wins (of equal lengths the first in order).

Reputation comes from labelled pages (bad or not). The share of bad pages of a suffix, of a registered domain and of a
host is shrunk towards the level above: its prior is a beta distribution around the parent's posterior mean, whose weight is
estimated from how far the groups of that level lie apart beyond chance (method of moments for the beta-binomial). A
host is blocked if its bad share, less ``z`` posterior standard deviations, is over ``limit``.

Cases: an address that is NULL or has no ``://`` has empty host and path, and no rule fits it. Hosts without labelled pages have their domain's posterior,
unknown domains their suffix's, and so on up. Without any labelled page nothing is blocked by reputation. NULL outcomes are left
out. Repeated rows count and are judged one by one. Empty tables give empty results. Extra columns of pages are kept by ``judge``, but for
those named as its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import ascii_lower, written

RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]
#: Public suffixes of two labels that are told apart by default; any other last label is a suffix.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in")
LIMIT, Z = 0.3, 1.645
#: Bounds of a prior's weight, in pages.
LEAST, MOST = 1.0, 1000.0
OWN = ("host", "path", "rule", "verdict", "bad_share", "bad_bound")


def parts(url: Column | str) -> tuple[Column, Column]:
    """Host and path of an address."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def levels(host: Column | str, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; the host itself where it has too few labels."""
    listed = "|".join(s.replace(".", r"\.") for s in suffixes)
    suffix = F.regexp_extract(host, rf"(?:^|\.)({listed}|[^.]*)$", 1)
    domain = F.regexp_extract(host, rf"([^.]+\.(?:{listed}|[^.]+))$", 1)
    return F.when(domain == "", F.col(host) if isinstance(host, str) else host).otherwise(domain), suffix


def _weight(groups: DataFrame) -> DataFrame:
    """One row: the prior's weight ``k`` for groups (parent, n, bad, pn, pbad), pn and pbad being their parent's sums."""
    p = F.col("pbad") / F.col("pn")
    by_parent = groups.where("n > 0").groupBy("parent", "pn", "pbad").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2)).alias("s"),
        (F.count("*") - 1).alias("free"),
        F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("own"),
    )
    q = p * (1 - p)
    apart = by_parent.agg(
        F.sum(F.col("s") - q * F.col("free")).alias("over"),
        F.sum(q * (F.col("pn") - F.col("own") - F.col("free"))).alias("room"),
    )
    rho = F.col("over") / F.col("room")
    k = F.when((F.col("room") > 0) & (F.col("over") > 0), (1 - rho) / rho).otherwise(F.lit(MOST))
    return apart.select(F.least(F.greatest(k, F.lit(LEAST)), F.lit(MOST)).alias("k"))


def reputation(outcomes: DataFrame, hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, bad_share, bad_bound without z: mean and sd) for every one of ``hosts``.

    ``outcomes`` has (host, bad); all is added up by host first, so the higher levels read one row a host.
    """
    counted = outcomes.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"))
    domain, suffix = levels("host", suffixes)
    base = written(
        hosts.join(counted, "host", "left").select(
            "host", domain.alias("domain"), suffix.alias("suffix"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")
        ),
        "hosts",
    )
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    by_domain = base.groupBy("suffix", "domain").agg(*sums)
    by_suffix = base.groupBy("suffix").agg(*sums)
    total = base.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pn"), F.coalesce(F.sum("bad"), F.lit(0)).alias("pbad"))
    # One row each; the joins below without a key add one row's figures to every row.
    k_suffix = _weight(by_suffix.crossJoin(F.broadcast(total)).withColumn("parent", F.lit(0)))
    above = by_suffix.select("suffix", F.col("n").alias("pn"), F.col("bad").alias("pbad"))
    k_domain = _weight(by_domain.join(above, "suffix").withColumn("parent", F.col("suffix")))
    above = by_domain.select("suffix", "domain", F.col("n").alias("pn"), F.col("bad").alias("pbad"))
    k_host = _weight(base.join(above, ["suffix", "domain"]).withColumn("parent", F.concat_ws("\n", "suffix", "domain")))
    known = total.select(F.when(F.col("pn") > 0, F.col("pbad") / F.col("pn")).alias("m"))
    m1 = by_suffix.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(k_suffix)).select("suffix", _mean("m").alias("m1"))
    m2 = by_domain.join(m1, "suffix").crossJoin(F.broadcast(k_domain)).select("suffix", "domain", _mean("m1").alias("m2"))
    m3 = base.join(m2, ["suffix", "domain"]).crossJoin(F.broadcast(k_host))
    mean = _mean("m2")
    spread = F.sqrt(mean * (1 - mean) / (F.col("n") + F.col("k") + 1))
    return m3.select("host", mean.alias("bad_share"), spread.alias("spread"))


def _mean(prior: str) -> Column:
    return (F.col(prior) * F.col("k") + F.col("bad")) / (F.col("k") + F.col("n"))


def host_rules(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, rules): the rules whose host part is the host or one above it, longest first."""
    spark = hosts.sparkSession
    made = [(r.partition("/")[0].lower(), "/" + r.partition("/")[2], r, v, -len(r), n) for n, (r, v) in enumerate(rules)]
    table = spark.createDataFrame(made, "at string, prefix string, rule string, verdict string, minus int, place int")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("host", F.explode(above).alias("at")).join(table, "at")
    return found.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("minus", "place", "prefix", "rule", "verdict"))).alias("rules"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] | None = None, url: str = "url", limit: float = LIMIT, z: float = Z
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, bad_share and bad_bound; ``outcomes`` has (url, bad)."""
    host, path = parts(url)
    there = pages.drop(*[c for c in OWN if c != url]).withColumn("host", host).withColumn("path", path)
    seen_host, _ = parts("url")
    seen = outcomes.select(seen_host.alias("host"), "bad")
    hosts = written(there.select("host").distinct(), "hosts")
    ranks = reputation(seen, hosts.union(seen.select("host")).distinct())
    facts = hosts.join(host_rules(hosts, RULES if rules is None else rules), "host", "left").join(ranks, "host", "left")
    joined = there.join(facts, "host", "left")
    first = F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"]))
    fits = F.get(first, F.lit(0))
    bound = F.col("bad_share") - z * F.col("spread")
    own = F.when(bound > limit, "block").otherwise("allow")
    return (
        joined.withColumn("_fit", fits).withColumn("bad_bound", bound)
        .select(
            *[c for c in there.columns if c not in ("host", "path")], "host", "path",
            F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), own).alias("verdict"), "bad_share", "bad_bound",
        )
    )


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query. A page's outcome is the label of its number: bad if toxic or of quality 0."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    outcomes = pages.select("page_id", "url").join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id")
    return judge(pages.select("page_id", "url"), outcomes.select("url", "bad")).select("page_id", "host", "path", "rule", "verdict")


#: The same for DuckDB.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
o AS (SELECT host, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
      FROM u JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL OR toxic = 1 OR quality = 0 GROUP BY host),
h AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, regexp_extract(host, '(?:^|\.)(co\.uk|org\.uk|ac\.uk|com\.au|co\.jp|com\.br|co\.in|[^.]*)$', 1) AS suffix,
         CASE WHEN regexp_extract(host, '([^.]+\.(?:co\.uk|org\.uk|ac\.uk|com\.au|co\.jp|com\.br|co\.in|[^.]+))$', 1) = '' THEN host
              ELSE regexp_extract(host, '([^.]+\.(?:co\.uk|org\.uk|ac\.uk|com\.au|co\.jp|com\.br|co\.in|[^.]+))$', 1) END AS domain
  FROM (SELECT DISTINCT host FROM u) LEFT JOIN o USING (host)),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
t AS (SELECT sum(n) AS n, sum(bad) AS bad FROM h),
g AS (
  SELECT 1 AS level, '' AS parent, s.n, s.bad, t.n AS pn, t.bad AS pbad FROM s, t
  UNION ALL SELECT 2, suffix, d.n, d.bad, s.n, s.bad FROM d JOIN s USING (suffix)
  UNION ALL SELECT 3, suffix || chr(10) || domain, h.n, h.bad, d.n, d.bad FROM h JOIN d USING (suffix, domain)),
a AS (
  SELECT level, pbad / pn AS p, pn, sum(n * pow(bad / n - pbad / pn, 2)) AS s, count(*) - 1 AS free, sum(n * n / pn) AS own
  FROM g WHERE n > 0 GROUP BY level, parent, pn, pbad),
b AS (SELECT level, sum(s - p * (1 - p) * free) AS beyond, sum(p * (1 - p) * (pn - own - free)) AS room FROM a GROUP BY level),
k AS (SELECT level, least(greatest(CASE WHEN room > 0 AND beyond > 0 THEN (1 - beyond / room) / (beyond / room) ELSE 1000 END, 1), 1000) AS k FROM b),
m1 AS (SELECT suffix, (t.bad / t.n * k + s.bad) / (k + s.n) AS m FROM s, t, k WHERE level = 1),
m2 AS (SELECT suffix, domain, (m * k + bad) / (k + n) AS m FROM d JOIN m1 USING (suffix), k WHERE level = 2),
m3 AS (SELECT host, n, k, (m * k + bad) / (k + n) AS m FROM h JOIN m2 USING (suffix, domain), k WHERE level = 3),
r(rule, verdict, owner, prefix) AS (VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN r ON (host = owner OR ends_with(host, '.' || owner)) AND starts_with(path, prefix) GROUP BY page_id)
SELECT page_id, u.host, path, rule,
  coalesce(verdict, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (n + k + 1)) > 0.3 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (page_id) LEFT JOIN m3 ON m3.host = u.host
"""
