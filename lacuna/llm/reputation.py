"""URL filters: block and allow rules first, then empirical-Bayes host reputation. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_narrow, materialise, table

#: (verdict, host, path prefix)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Second-level labels that form a public suffix with a country's two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")
#: Domains below which anyone may register: suffixes like those of countries.
SHARED_DOMAINS = ("blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com")
#: A host is blocked if its good rate lies, with at least this posterior chance, below this part of the rate of all outcomes.
CHANCE, PART_OF_BASE = 0.9, 0.95
#: Nodes of the integral on each side of the cut, and standard deviations that it reaches to.
NODES, REACH = 64, 10.0
#: Bounds of the estimated prior strengths, in pseudo-outcomes.
STRENGTH = (2.0, 200.0)
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_SUFFIX = rf"(?:^|\.)((?:{'|'.join(x.replace('.', '[.]') for x in SHARED_DOMAINS)}|(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]*))$"


def host_of(url: Column) -> Column:
    """The host of a url, A-Z lower-cased; empty for null or without '://'."""
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 1), UPPER, LOWER_CASE)


def path_of(url: Column) -> Column:
    """The path of a url up to '?' or '#'; empty for null or without '://'."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _URL, 2)


def suffix_of(host: Column) -> Column:
    """Last label, or the last two where they are a country's second-level suffix or one of SHARED_DOMAINS; an address of digits is its own."""
    return F.when(host.rlike(r"^[\d.:]+$"), host).otherwise(F.regexp_extract(host, _SUFFIX, 1))


def chance_below(a: Column, b: Column, cut: float) -> Column:
    """The chance that a beta(a, b) variable is below cut (0 to 1), to about three places; a and b are taken as 0.5 at least.

    With rate = sin(x)^2 the density becomes sin(x)^(2a-1) cos(x)^(2b-1), close to a normal one of deviation 1 / (2 sqrt(a+b)). It is summed at NODES
    midpoints on each side of the cut, within REACH deviations of its centre, and divided by its whole sum, so no gamma function is needed.
    """
    a, b = F.greatest(a, F.lit(0.5)), F.greatest(b, F.lit(0.5))
    centre = F.asin(F.sqrt(a / (a + b)))
    reach = F.lit(REACH) / (2 * F.sqrt(a + b))
    low, high = F.greatest(F.lit(0.0), centre - reach), F.least(F.lit(math.pi / 2), centre + reach)
    at = F.least(F.greatest(F.lit(math.asin(math.sqrt(cut))), low), high)
    log = lambda x: (2 * a - 1) * F.ln(F.sin(x)) + (2 * b - 1) * F.ln(F.cos(x))
    part = lambda lo, hi: (hi - lo) * F.aggregate(F.sequence(F.lit(0), F.lit(NODES - 1)), F.lit(0.0), lambda s, i: s + F.exp(log(lo + (hi - lo) * (i + 0.5) / NODES) - log(centre)))
    below, above = part(low, at), part(at, high)
    return below / (below + above)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label before it, or the host if there is none."""
    suffix = suffix_of(host)
    rest = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(suffix) >= F.length(host), host).otherwise(F.concat_ws(".", F.substring_index(rest, ".", -1), suffix))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest fitting rule, both null without one.

    A rule fits its host and all subdomains where the path starts with its path. Ties in length: longer host,
    then text order. The rules are a parameter list and become one ordered conditional expression.
    """
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def prior_strength(groups: DataFrame, bounds: tuple[float, float] = STRENGTH) -> tuple[float, float]:
    """(mean, strength) of the beta prior behind groups' outcomes (columns good, n), by moments; one row reaches the driver."""
    total = groups.where("n > 0").agg(F.sum("good").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("good").cast("double") * F.col("good") / F.col("n")).alias("kk")).first()
    if not total.n:
        return 0.5, bounds[0]
    mean = total.k / total.n
    spread = total.kk - total.n * mean * mean - (total.g - 1) * mean * (1 - mean)
    room = mean * (1 - mean) * (total.n - total.nn / total.n - (total.g - 1))
    rho = spread / room if room > 0 else 0.0
    return mean, min(max(1 / rho - 1, bounds[0]), bounds[1]) if rho > 0 else bounds[1]


def reputations(visits: DataFrame, bounds: tuple[float, float] = STRENGTH, part_of_base: float = PART_OF_BASE) -> DataFrame:
    """(host, n, good, mean, chance): the posterior good rate of every host in visits (columns host, good; good null: not labelled), and the chance that it is below part_of_base times the rate of all outcomes.

    The prior of a suffix is that of all outcomes, of a domain its suffix's posterior mean, of a host its domain's; each with
    the strength that the spread between such groups shows. Counts are summed by host before any join, so a hot
    host is one row. No outcomes at all give 0.5 everywhere; the empty host is a host like any other.
    """
    hosts = visits.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good"))
    hosts = materialise(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    mean, top = prior_strength(suffixes, bounds)
    (_, mid), (_, low) = prior_strength(domains, bounds), prior_strength(hosts, bounds)
    rate = lambda prior, s: (prior * s + F.col("good")) / (F.lit(s) + F.col("n"))
    suffixes = suffixes.select("suffix", rate(F.lit(mean), top).alias("of_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", rate(F.col("of_suffix"), mid).alias("of_domain"))
    out = hosts.join(domains, "domain").withColumn("mean", rate(F.col("of_domain"), low)).withColumn("weight", F.lit(low) + F.col("n"))
    chance = chance_below(F.col("mean") * F.col("weight"), (1 - F.col("mean")) * F.col("weight"), part_of_base * mean)
    return materialise(out.select("host", "n", "good", "mean", chance.alias("chance")))


def filter_urls(pages: DataFrame, outcomes: DataFrame, id_col: str, url_col: str, rules=RULES, chance: float = CHANCE, part_of_base: float = PART_OF_BASE) -> DataFrame:
    """(id, host, path, rule, verdict, mean, chance), one row per row of pages.

    outcomes has columns id and good (0, 1 or null): labelled outcomes of pages, several per page averaged to
    the majority (a tie is good). Where no rule fits, a page is blocked if its host's good rate is below part_of_base times
    that of all outcomes with a posterior chance of at least `chance`; hosts whose outcomes differ no more than chance would have it are all allowed. Null urls have the empty host and path. Pages meet
    their host's one row in a broadcast of measured size, or dealt by host and salt.
    """
    src = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    votes = outcomes.where("id IS NOT NULL").groupBy("id").agg((F.avg(F.col("good").cast("double")) >= 0.5).cast("int").alias("good"))
    rep = reputations(src.join(votes, "id", "left").select("host", "good"), part_of_base=part_of_base)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = join_narrow(src, rep.select("host", "mean", "chance"), "host", "left").withColumn("rule", rule)
    judged = F.when(F.col("chance") >= chance, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("id", "host", "path", "rule", F.coalesce(verdict, judged).alias("verdict"), "mean", "chance")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled outcomes of pages: the quality of the document whose number ends the url's path."""
    number = F.regexp_extract(path_of(F.col("url")), r"^/[^/]*/(\d{1,18})(?:\D|$)", 1)
    by_doc = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("quality").alias("good")).where("doc IS NOT NULL")
    return pages.select(F.col("page_id").alias("id"), number.try_cast("long").alias("doc")).join(by_doc, "doc").select("id", "good")


def op9_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages; null urls have the empty host and path, repeated rows stay."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), "page_id", "url")
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _oracle() -> str:
    low, high = STRENGTH
    prior = lambda name, of: f"""
{name}_m AS (SELECT sum(good) / sum(n) AS p, sum(n) AS n, count(*) AS g, sum(CAST(n AS DOUBLE) * n) AS nn, sum(CAST(good AS DOUBLE) * good / n) AS kk FROM {of} WHERE n > 0),
{name}_r AS (SELECT p, (kk - n * p * p - (g - 1) * p * (1 - p)) / nullif(p * (1 - p) * (n - nn / n - (g - 1)), 0) AS rho, p * (1 - p) * (n - nn / n - (g - 1)) AS room, n FROM {name}_m),
{name}_p AS (SELECT CASE WHEN n IS NULL THEN 0.5 ELSE p END AS mean, CASE WHEN n IS NULL THEN {low} WHEN room > 0 AND rho > 0 THEN least(greatest(1 / rho - 1, {low}), {high}) ELSE {high} END AS s FROM {name}_r)"""  # noqa: E731
    log = lambda x: f"((2 * a - 1) * ln(sin({x})) + (2 * b - 1) * ln(cos({x})))"
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:]))
    fits = [(k, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for k, h, p in rules]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[i]}'" for f in fits) + " END"
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER_CASE}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
o AS (SELECT page_id, CASE WHEN avg(quality) >= 0.5 THEN 1 WHEN avg(quality) IS NULL THEN NULL ELSE 0 END AS good
  FROM (SELECT page_id, TRY_CAST(regexp_extract(path, '^/[^/]*/(\d{{1,18}})(?:\D|$)', 1) AS BIGINT) AS doc_id FROM u) JOIN labels USING (doc_id) WHERE page_id IS NOT NULL GROUP BY page_id),
h0 AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good, CASE WHEN regexp_matches(host, '^[\d.:]+$') THEN host ELSE regexp_extract(host, '{_SUFFIX}', 1) END AS suffix
  FROM u LEFT JOIN o USING (page_id) GROUP BY host),
h AS (SELECT *, CASE WHEN length(suffix) >= length(host) THEN host ELSE split_part(substr(host, 1, length(host) - length(suffix) - 1), '.', -1) || '.' || suffix END AS domain FROM h0),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),{prior("s", "s")},{prior("d", "d")},{prior("h", "h")},
sp AS (SELECT suffix, ((SELECT mean FROM s_p) * (SELECT s FROM s_p) + good) / ((SELECT s FROM s_p) + n) AS m FROM s),
dp AS (SELECT domain, (sp.m * (SELECT s FROM d_p) + good) / ((SELECT s FROM d_p) + n) AS m FROM d JOIN sp USING (suffix)),
hp AS (SELECT host, (dp.m * (SELECT s FROM h_p) + good) / ((SELECT s FROM h_p) + n) AS m, (SELECT s FROM h_p) + n AS w FROM h JOIN dp USING (domain)),
hb AS (SELECT host, greatest(m * w, 0.5) AS a, greatest((1 - m) * w, 0.5) AS b FROM hp),
hx AS (SELECT host, a, b, asin(sqrt(a / (a + b))) AS c, {REACH} / (2 * sqrt(a + b)) AS r, asin(sqrt({PART_OF_BASE} * (SELECT mean FROM s_p))) AS x FROM hb),
hy AS (SELECT host, a, b, c, greatest(0, c - r) AS lo, least({math.pi / 2}, c + r) AS hi, least(greatest(x, greatest(0, c - r)), least({math.pi / 2}, c + r)) AS x FROM hx),
hz AS (SELECT host, (x - lo) * sum(exp({log("lo + (x - lo) * (i + 0.5) / %d" % NODES)} - {log("c")})) AS below, (hi - x) * sum(exp({log("x + (hi - x) * (i + 0.5) / %d" % NODES)} - {log("c")})) AS above
  FROM hy, range(0, {NODES}) t(i) GROUP BY host, a, b, c, lo, hi, x)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN below / (below + above) >= {CHANCE} THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN hz USING (host)
"""


ORACLE_SQL = _oracle()
