"""URL filters: rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix.  At
each level a beta-binomial prior is fitted by nested analysis of variance, and
a node's bad rate is shrunk towards its parent's: suffix towards the corpus,
domain towards its suffix, host towards its domain.  A page is blocked when
the lower posterior bound of its host's bad rate exceeds a limit.

Nulls and odd input: a null url, or one without ``://``, has an empty host and
path, fits no rule and is judged by the reputation of the empty host.  A null
outcome is no outcome.  Repeated rows are counted and returned as often as they
come; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table, written

#: Public suffixes of two labels that are common on the web.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "org.au", "org.uk")

#: From how many rules on the rules are joined instead of being one expression.
RULES_INLINE = 64


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix: two labels for those in ``suffixes``, else one (port and user dropped)."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict``: of the rules that fit, the longest (block before allow, then by name)."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    if len(rules) <= RULES_INLINE:
        name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in reversed(ranked):
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
        return df.withColumns({"rule": name, "rule_verdict": verdict})
    spark = df.sparkSession
    known = spark.createDataFrame([(r.host, r.path, r.name, r.verdict, i) for i, r in enumerate(ranked)], "rule_host string, rule_path string, rule string, rule_verdict string, rule_rank int")
    places = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = places.withColumn("rule_host", F.explode(ends)).join(known, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fit.groupBy("host", "path").agg(F.min_by(F.struct("rule", "rule_verdict"), "rule_rank").alias("r"))
    return df.join(best.select("host", "path", "r.*"), ["host", "path"], "left")


def _strength(children: DataFrame, parents: DataFrame, link: str) -> float:
    """Prior weight, in pages, of a parent's rate for its children, by nested analysis of variance, in [1, 1000]."""
    c = children.where("n > 0").join(parents.select(link, F.col("n").alias("pn"), F.col("x").alias("px")), link)
    row = c.agg(
        F.count(F.lit(1)).alias("k"), F.count_distinct(link).alias("d"), F.sum("n").alias("n"), F.sum(F.col("x") * F.col("x") / F.col("n")).alias("own"),
        F.sum(F.col("n") * (F.col("px") / F.col("pn")) * (F.col("px") / F.col("pn"))).alias("up"), F.sum("x").alias("x"), F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("sq"),
    ).first()
    k, d, n = row["k"] or 0, row["d"] or 0, row["n"] or 0
    if k <= d or n <= k:
        return 1000.0
    between, within, size = (row["own"] - row["up"]) / (k - d), (row["x"] - row["own"]) / (n - k), (n - row["sq"]) / (k - d)
    rho = (between - within) / (between + (size - 1) * within) if between + (size - 1) * within > 0 else 0.0
    return min(1000.0, max(1.0, 1 / rho - 1)) if rho > 0 else 1000.0


def reputations(counts: DataFrame, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, x, rate, sd) of every host of ``counts`` (host, n outcomes, x bad ones).

    The hosts with their domains are written once; all that follows reads them.
    """
    hosts = written(counts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).withColumn("all", F.lit(0))
    total = tops.groupBy("all").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = total.first()
    n, x = (whole["n"], whole["x"]) if whole else (0, 0)
    top = (x + 0.5) / (n + 1.0)
    weights = [_strength(tops, total, "all"), _strength(domains, tops, "suffix"), _strength(hosts, domains, "domain")]
    rate = lambda up, w: (F.col("x") + F.lit(w) * up) / (F.col("n") + F.lit(w))
    s = tops.select("suffix", rate(F.lit(top), weights[0]).alias("suffix_rate"))
    d = domains.join(s, "suffix").select("domain", rate(F.col("suffix_rate"), weights[1]).alias("domain_rate"))
    h = hosts.join(d, "domain").withColumn("rate", rate(F.col("domain_rate"), weights[2]))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(weights[2] + 1)))
    return h.select("host", "n", "x", "rate", sd.alias("sd"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float = 0.5, z: float = 1.645, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) by ``rules`` and by ``outcomes`` (page_id, bad boolean).

    Gives page_id, host, path, rule, rate, bound, verdict; blocked by method
    where ``rate - z * sd > limit``.  Several outcomes of a page count each.
    ``suffixes`` are the public suffixes of two labels; sites under one that
    is not listed count as one domain.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = outcomes.where("bad is not null").select(F.col("page_id"), F.col("bad").cast("int").alias("bad")).groupBy("page_id").agg(F.count("bad").alias("m"), F.sum("bad").alias("b"))
    labelled = urls.select("page_id", "host").join(seen, "page_id", "left")
    counts = labelled.groupBy("host").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("x"))
    known = reputations(counts, suffixes).select("host", "rate", (F.col("rate") - z * F.col("sd")).alias("bound"))
    ruled = with_rule(urls, rules).join(known, "host", "left")
    by_method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_method).alias("verdict"), "rate", "bound")


#: The rules of the query.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def op10_url_reputation(spark, sf_dir) -> DataFrame:
    """Judge all pages; a page is labelled by the row of ``labels`` with its number: bad if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels, RULES).select("page_id", "host", "path", "rule", "verdict")


def _sql_strength(children: str, parents: str, link: str) -> str:
    return f"""(SELECT CASE WHEN k <= d OR n <= k OR rho IS NULL OR rho <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, 1 / rho - 1)) END FROM (SELECT k, d, n, CASE WHEN bt + (sz - 1) * wi > 0 THEN (bt - wi) / (bt + (sz - 1) * wi) ELSE 0 END AS rho FROM
    (SELECT k, d, n, (own - up) / nullif(k - d, 0) AS bt, (x - own) / nullif(n - k, 0) AS wi, (n - sq) / nullif(k - d, 0) AS sz FROM
    (SELECT count(*) AS k, count(DISTINCT c.{link}) AS d, sum(c.n)::DOUBLE AS n, sum(c.x * c.x / c.n) AS own, sum(c.n * (p.x / p.n) * (p.x / p.n)) AS up, sum(c.x)::DOUBLE AS x, sum(c.n * c.n / p.n) AS sq FROM {children} c JOIN {parents} p ON c.{link} = p.{link} WHERE c.n > 0))))"""


SQL = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
y AS (SELECT u.host, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 OR l.quality = 0 THEN 1 ELSE 0 END AS bad FROM u LEFT JOIN labels l ON l.doc_id = u.page_id),
h0 AS (SELECT host, count(bad)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS x, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b FROM y GROUP BY host),
h1 AS (SELECT *, string_split(b, '.') AS t FROM h0),
h2 AS (SELECT *, array_to_string(t[greatest(1, len(t) - 1):], '.') AS two, array_to_string(t[greatest(1, len(t) - 2):], '.') AS three, t[-1] AS one FROM h1),
hs AS (SELECT host, n, x, 0 AS everything, CASE WHEN two IN {TWO_LABEL_SUFFIXES} THEN three ELSE two END AS domain, CASE WHEN two IN {TWO_LABEL_SUFFIXES} THEN two ELSE one END AS suffix FROM h2),
ds AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(x)::BIGINT AS x FROM hs GROUP BY domain, suffix), ss AS (SELECT suffix, 0 AS everything, sum(n)::BIGINT AS n, sum(x)::BIGINT AS x FROM ds GROUP BY suffix),
al AS (SELECT 0 AS everything, sum(n)::BIGINT AS n, sum(x)::BIGINT AS x FROM ss),
w AS (SELECT {_sql_strength("ss", "al", "everything")} AS w0, {_sql_strength("ds", "ss", "suffix")} AS w1, {_sql_strength("hs", "ds", "domain")} AS w2),
r0 AS (SELECT suffix, (ss.x + w0 * ((al.x + 0.5) / (al.n + 1.0))) / (ss.n + w0) AS r FROM ss, al, w), r1 AS (SELECT domain, (ds.x + w1 * r) / (ds.n + w1) AS r FROM ds JOIN r0 USING (suffix), w),
r2 AS (SELECT host, n, (hs.x + w2 * r) / (hs.n + w2) AS r FROM hs JOIN r1 USING (domain), w), z AS (SELECT host, r - 1.645 * sqrt(r * (1 - r) / (n + w2 + 1)) AS bound FROM r2, w),
v AS (SELECT page_id, host, path, bound, CASE {" ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.name}'" for r in sorted(RULES, key=lambda r: (-len(r.name), r.verdict != "block", r.name)))} END AS hit FROM u JOIN z USING (host))
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 1) WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM v
"""
