"""Host reputation by empirical Bayes, from labelled pages, and a filter of pages by its lower bound.

Outcomes (good or not) of labelled pages are counted by host, registered domain and suffix. Each level is shrunk
towards the one above it, host to domain to suffix to all pages, by a beta-binomial prior: its mean is the posterior
mean of the level above, its strength is fitted to the level's own scatter by the method of moments. A page is kept
if the lower posterior bound of its host, mean - z * deviation of the beta posterior, reaches `least`.

Counts by host are the only aggregation; hosts without a labelled page have their domain's posterior, domains without
their suffix's. Everything is an SQL expression, so it runs at any number of pages and hosts.

Defined cases: a url that is null or has no host belongs to the host, domain and suffix ''; a numeric address is its
own domain, its suffix 'ip'. A null outcome is no outcome; the outcomes of repeated label rows of an id are averaged
and count as good from one half. Without any outcome the prior mean is one half. Repeated page rows are treated alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_TWO = r"(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}"
SUFFIX = rf"(?:^|\.)({_TWO}|[^.]+)$"
DOMAIN = rf"([^.]+\.(?:{_TWO}|[^.]+))$"
DOC_ID = r"://[^/?#]+/[a-z]{2}/([0-9]{1,18})(?:[^0-9]|$)"


def names(url: Column, suffixes: Sequence[str] | None = None) -> dict[str, Column]:
    """host, domain and suffix of a url.

    suffixes are the public suffixes of two labels and more, such as co.uk or github.io, of which the longest counts;
    without them the customary second levels (ac.xx, co.xx and so on) stand in. Any last label is a suffix.
    """
    host = F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))
    number = host.rlike(r"^[0-9.]+$")
    domain, suffix = F.regexp_extract(host, DOMAIN, 1), F.regexp_extract(host, SUFFIX, 1)
    if suffixes is not None:
        labels, n = F.split(host, r"\."), lambda k: F.least(F.lit(k), F.size(F.split(host, r"\.")))
        last = lambda k: F.array_join(F.slice(labels, F.size(labels) - n(k) + 1, n(k)), ".")
        suffix, domain = last(1), last(2)
        for k in sorted({x.count(".") + 1 for x in suffixes} - {1}):
            own = last(k).isin([x for x in suffixes if x.count(".") + 1 == k])
            suffix, domain = F.when(own, last(k)).otherwise(suffix), F.when(own, last(k + 1)).otherwise(domain)
    return {"host": host, "domain": F.when(number | (domain == ""), host).otherwise(domain), "suffix": F.when(number, "ip").otherwise(suffix)}


def _shrunk(units: DataFrame, weakest: float, strongest: float) -> DataFrame:
    """units (s, n, p) of a level, p being the mean above, with kappa, the prior's strength there."""
    spread = F.sum(F.pow(F.col("s") - F.col("n") * F.col("p"), 2) - F.col("n") * F.col("p") * (1 - F.col("p")))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * F.col("p") * (1 - F.col("p")))
    rho = units.agg(F.when(pairs > 0, F.least(F.greatest(spread / pairs, F.lit(1 / (strongest + 1))), F.lit(1 / (weakest + 1)))).otherwise(F.lit(1 / (strongest + 1))).alias("rho"))
    return units.crossJoin(F.broadcast(rho)).withColumn("kappa", 1 / F.col("rho") - 1).drop("rho")


def reputation(pages: DataFrame, labels: DataFrame, id_pattern: str = DOC_ID, outcome: str = "quality", weakest: float = 1.0, strongest: float = 1000.0, suffixes: Sequence[str] | None = None) -> DataFrame:
    """(host, domain, suffix, pages, n, s, a, b): posterior beta(a, b) of every host; n of its pages are labelled, s of them good.

    A page's label is that of the document whose id the url holds.
    """
    from_url = F.regexp_extract(F.coalesce("url", F.lit("")), id_pattern, 1)
    own = pages.select(*[c.alias(k) for k, c in names(F.col("url"), suffixes).items()], F.when(from_url != "", from_url.cast("bigint")).alias("id"))
    good = labels.filter(F.col(outcome).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("id")).agg((F.avg(outcome) >= 0.5).cast("bigint").alias("good"))
    hosts = own.join(good, "id", "left").groupBy("host", "domain", "suffix").agg(F.count("*").alias("pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("s"))
    hosts = written(hosts, "hosts")  # every level above is read from these counts
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "domains")
    top = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    top = written(top, "suffixes")
    every = top.agg(((F.coalesce(F.sum("s"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("p"))
    mean = (F.col("s") + F.col("kappa") * F.col("p")) / (F.col("n") + F.col("kappa"))
    top = _shrunk(top.crossJoin(F.broadcast(every)), weakest, strongest).select("suffix", mean.alias("p"))
    domains = _shrunk(domains.join(top, "suffix"), weakest, strongest).select("domain", "suffix", mean.alias("p"))
    hosts = _shrunk(hosts.join(domains, ["domain", "suffix"]), weakest, strongest)
    return hosts.select("host", "domain", "suffix", "pages", "n", "s", (F.col("s") + F.col("kappa") * F.col("p")).alias("a"), (F.col("n") - F.col("s") + F.col("kappa") * (1 - F.col("p"))).alias("b"))


def bound(z: float) -> Column:
    a, b = F.col("a"), F.col("b")
    return F.greatest(F.lit(0.0), a / (a + b) - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1))))


def filter_pages(pages: DataFrame, labels: DataFrame, least: float = 0.5, z: float = 1.645, **how) -> DataFrame:
    """(page_id, host, domain, suffix, n, s, mean, lower, keep) of every page."""
    scored = reputation(pages, labels, **how).select("host", "domain", "suffix", "n", "s", F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("mean"), F.round(bound(z), 6).alias("lower"))
    own = pages.select("page_id", names(F.col("url"))["host"].alias("host"))
    return own.join(scored, "host").select("page_id", "host", "domain", "suffix", "n", "s", "mean", "lower", (F.col("lower") >= least).alias("keep"))


def _level(name: str, source: str) -> str:
    return f"""{name}_rho AS (
  SELECT CASE WHEN sum(n * (n - 1) * p * (1 - p)) > 0 THEN
    least(greatest(sum(pow(s - n * p, 2) - n * p * (1 - p)) / sum(n * (n - 1) * p * (1 - p)), 1 / 1001.0::DOUBLE), 1 / 2.0::DOUBLE)
    ELSE 1 / 1001.0::DOUBLE END AS rho FROM {source}
), {name}_k AS (SELECT {source}.*, 1 / rho - 1 AS kappa FROM {source} CROSS JOIN {name}_rho)"""


ORACLE = rf"""
WITH h AS (
  SELECT page_id, rtrim(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '.') AS host,
         try_cast(nullif(regexp_extract(coalesce(url, ''), '{DOC_ID}', 1), '') AS BIGINT) AS id FROM pages
), own AS (
  SELECT page_id, id, host, CASE WHEN regexp_matches(host, '^[0-9.]+$') OR regexp_extract(host, '{DOMAIN}', 1) = '' THEN host
         ELSE regexp_extract(host, '{DOMAIN}', 1) END AS domain,
         CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN 'ip' ELSE regexp_extract(host, '{SUFFIX}', 1) END AS suffix FROM h
), good AS (
  SELECT doc_id AS id, CASE WHEN avg(quality) >= 0.5 THEN 1 ELSE 0 END AS good FROM labels
  WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT host, domain, suffix, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS s FROM own LEFT JOIN good USING (id) GROUP BY ALL
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM domains GROUP BY ALL
), s1 AS (SELECT *, (SELECT (sum(s) + 0.5) / (sum(n) + 1) FROM suffixes) AS p FROM suffixes
), {_level("s", "s1")},
d1 AS (SELECT domains.*, (s_k.s + kappa * p) / (s_k.n + kappa) AS p FROM domains JOIN s_k USING (suffix)
), {_level("d", "d1")},
h1 AS (SELECT hosts.*, (d_k.s + kappa * p) / (d_k.n + kappa) AS p FROM hosts JOIN d_k USING (domain, suffix)
), {_level("h", "h1")},
ab AS (SELECT *, s + kappa * p AS a, n - s + kappa * (1 - p) AS b FROM h_k
), scored AS (
  SELECT host, domain, suffix, n::BIGINT AS n, s::BIGINT AS s, round(a / (a + b), 6) AS mean,
         round(greatest(0.0, a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1)))), 6) AS lower FROM ab
)
SELECT page_id, host, domain, suffix, n, s, mean, lower, lower >= 0.5 AS keep FROM own JOIN scored USING (host, domain, suffix)
"""
