"""Url rules and empirical-Bayes host reputation, with DataFrame functions only.

Labelled pages give each host a share of bad pages. The share is shrunk towards its registered
domain's, that towards its suffix's and that towards the corpus', each by a beta-binomial prior whose
strength is estimated from the spread of the children around their parents. A host is blocked
when the lower bound of its posterior is above the corpus share by a margin.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.session import cut

# (action, host, path prefix), as the query contract fixes them.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# Suffixes of two labels under which names are registered; all others have one label.
LONG_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za"]
# A host is blocked if its bound lies above the corpus share of bad labels by more than this.
MARGIN = 0.02
Z = 1.645
WEAKEST, STRONGEST = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffix(host: Column, long_suffixes: list[str] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def host_domain(host: Column, long_suffixes: list[str] = LONG_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits, else null."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        action = F.when(fits, act).otherwise(action)
    return text, action


def share(k: Column, n: Column) -> Column:
    return F.coalesce(k / F.when(n > 0, n), F.lit(0.0))


def strength(children: DataFrame) -> Column:
    """Prior strength of a level by moments, as a scalar: ``children`` has n, k and the prior ``mean``."""
    v = F.col("mean") * (1 - F.col("mean"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * v)
    rho = F.sum((F.col("k") - F.col("n") * F.col("mean")) ** 2 - F.col("n") * v) / F.when(pairs > 0, pairs)
    s = F.when(rho <= 0, F.lit(STRONGEST)).otherwise(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / rho - 1)))
    return children.agg(F.coalesce(s, F.lit(WEAKEST)).alias("s")).scalar()


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, labelled, bad, bad_mean, bad_bound) for every host of ``pages`` (page_id, host).

    ``outcomes`` holds one row (page_id, bad 0 or 1) per labelled page. A parent's prior leaves out the child's
    own labels, so that each label counts once. Hosts without labels get their domain's prior. Without
    any label every mean is 0.
    """
    hosts = cut(
        pages.join(outcomes.hint("merge"), "page_id", "left").groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("k"))
        .select("host", host_domain(F.col("host")).alias("domain"), host_suffix(F.col("host")).alias("suffix"), "n", "k"),
        "hosts",
    )
    sums = F.sum("n").alias("n"), F.sum("k").alias("k")
    domains = cut(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), *sums), "domains")
    suffixes = cut(domains.groupBy("suffix").agg(*sums).select("suffix", F.col("n").alias("sn"), F.col("k").alias("sk")), "suffixes")
    total = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("n"), F.coalesce(F.sum("sk"), F.lit(0)).alias("k"))
    all_n, all_k = total.select("n").scalar(), total.select("k").scalar()
    s = suffixes.select("*", all_n.alias("an"), all_k.alias("ak"))
    outer = F.when(F.col("an") > F.col("sn"), share(F.col("ak") - F.col("sk"), F.col("an") - F.col("sn"))).otherwise(share(F.col("ak"), F.col("an")))
    s = s.select("suffix", "sn", "sk", F.col("sn").alias("n"), F.col("sk").alias("k"), outer.alias("mean"))
    s = cut(s.select("suffix", "sn", "sk", "mean", strength(s).alias("s1")), "suffixes")
    of_suffix = (F.col("sk") - F.col("k") + F.col("s1") * F.col("mean")) / (F.col("sn") - F.col("n") + F.col("s1"))
    d = domains.join(s, "suffix").select("domain", "n", "k", of_suffix.alias("mean"))
    d = cut(d.select("domain", F.col("n").alias("dn"), F.col("k").alias("dk"), F.col("mean").alias("prior"), strength(d).alias("s2")), "domains")
    of_domain = (F.col("dk") - F.col("k") + F.col("s2") * F.col("prior")) / (F.col("dn") - F.col("n") + F.col("s2"))
    h = hosts.join(d, "domain").select("host", "n", "k", of_domain.alias("mean"))
    h = h.select("host", "n", "k", F.col("mean").alias("m"), strength(h).alias("s"))
    h = h.withColumn("bad_mean", (F.col("k") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s")))
    spread = F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("n") + F.col("s") + 1))
    h = h.select("host", F.col("n").alias("labelled"), F.col("k").alias("bad"), "bad_mean", (F.col("bad_mean") - z * spread).alias("bad_bound"))
    return cut(h, "reputation")


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, margin: float = MARGIN, z: float = Z,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: the id, ``host``, ``path``, ``rule``, ``verdict``, ``bad_bound``.

    ``outcomes`` has an id column named as the pages' and ``bad`` (0, 1, or null: not labelled); several
    rows of one id count as one, bad if any is. The verdict is the longest fitting rule's, else block
    if the host's posterior bound is above the share of bad labels among all labelled pages by more than ``margin``, a tie
    allows: a host that differs from nobody is never blocked. A null url or one without ``://`` has an empty
    host and path; such pages share the reputation of the empty host. Repeated pages give a row each,
    pages with a null id are unlabelled, other columns are ignored, no pages give no rows.
    """
    u = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).alias("page_id"), url_host(u).alias("host"), url_path(u).alias("path"))
    o = outcomes.select(F.col(id_col).alias("page_id"), F.col("bad").cast("int").alias("bad")).where("page_id is not null and bad is not null")
    o = o.groupBy("page_id").agg(F.max("bad").alias("bad"))
    rep = host_reputation(p.select("page_id", "host"), o, z)
    limit = rep.agg(share(F.sum("bad"), F.sum("labelled")).alias("share")).scalar() + margin
    rep = rep.select("host", "bad_bound")
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    out = p.join(rep.hint("merge"), "host", "left")
    verdict = F.coalesce(action, F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return out.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_bound")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND coalesce(quality, toxic) IS NOT NULL GROUP BY 1),
h AS (SELECT host, list_reverse(string_split(host, '.')) AS parts, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM p LEFT JOIN o USING (page_id) GROUP BY 1, 2),
hs AS (SELECT host, n, k, CASE WHEN len(parts) > 1 AND parts[2] || '.' || parts[1] IN ('co.uk','org.uk','ac.uk','com.au','net.au','co.jp','co.nz','com.br','co.in','co.za') THEN 2 ELSE 1 END AS s, parts FROM h),
hd AS (SELECT host, n, k, array_to_string(list_reverse(parts[1:s]), '.') AS suffix, array_to_string(list_reverse(parts[1:s + 1]), '.') AS domain FROM hs),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hd GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
g AS (SELECT coalesce(sum(n), 0) AS an, coalesce(sum(k), 0) AS ak FROM s),
sj AS (SELECT suffix, n, k, CASE WHEN an > n THEN coalesce((ak - k) / nullif(an - n, 0), 0) ELSE coalesce(ak / nullif(an, 0), 0) END AS mean FROM s, g),
s1 AS (SELECT CASE WHEN rho IS NULL THEN 1 WHEN rho <= 0 THEN 1000 ELSE greatest(1, least(1000, 1 / rho - 1)) END AS s1 FROM (SELECT sum((k - n * mean) * (k - n * mean) - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0) AS rho FROM sj)),
dj AS (SELECT domain, d.n, d.k, (sj.k - d.k + s1 * mean) / (sj.n - d.n + s1) AS mean FROM d JOIN sj USING (suffix), s1),
s2 AS (SELECT CASE WHEN rho IS NULL THEN 1 WHEN rho <= 0 THEN 1000 ELSE greatest(1, least(1000, 1 / rho - 1)) END AS s2 FROM (SELECT sum((k - n * mean) * (k - n * mean) - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0) AS rho FROM dj)),
hj AS (SELECT host, hd.n, hd.k, (dj.k - hd.k + s2 * mean) / (dj.n - hd.n + s2) AS mean FROM hd JOIN dj USING (domain), s2),
s3 AS (SELECT CASE WHEN rho IS NULL THEN 1 WHEN rho <= 0 THEN 1000 ELSE greatest(1, least(1000, 1 / rho - 1)) END AS s3 FROM (SELECT sum((k - n * mean) * (k - n * mean) - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0) AS rho FROM hj)),
hm AS (SELECT host, n, s3, (k + s3 * mean) / (n + s3) AS m FROM hj, s3),
r AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (n + s3 + 1)) AS bound FROM hm),
j AS (SELECT page_id, p.host, path, bound, CASE
  WHEN (p.host = 'www.example.com' OR p.host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p JOIN r ON r.host = p.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > coalesce((SELECT sum(k) / sum(n) FROM h WHERE n > 0), 0) + 0.02 THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
