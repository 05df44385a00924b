"""URL filters by empirical-Bayes host reputation, with explicit rules before it.

Labelled page outcomes (bad or not) are counted by host. A host's rate is shrunk towards that
of its registered domain, the domain's towards its suffix, and the suffix's towards the whole,
each by a beta-binomial prior whose strength is fitted to the level by the method of moments.
A host is blocked if its posterior mean less ``WIDTH`` posterior standard deviations exceeds
``MOST_BAD``. (By Cantelli's inequality that bound holds for any posterior with probability
0.8; for one that is nearly normal, with 0.977.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: Fixed values: (verdict, rule) of the production query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Labels below which a two-letter country suffix registers names.
SECOND_LEVEL = [
    "ac", "ad", "adv", "art", "asn", "asso", "biz", "cn", "co", "com", "ed", "edu", "eng", "firm", "gen", "go", "gob", "gouv", "gov", "govt", "gr", "gub", "id", "ind", "inf", "info", "k12", "lg", "ltd", "me", "med",
    "mil", "mod", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "pro", "re", "res", "sch", "school", "tm", "web",
]
MOST_BAD, WIDTH = 0.3, 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _bare(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


_ADDRESS = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"


def suffix_of(host: Column, second_level: list[str] | None = None) -> Column:
    """The host's public suffix: its last label, or two where a country registers names below a second level, by
    a rule over ``second_level`` and any two-letter label. Addresses have the suffix ``(address)``."""
    bare = _bare(host)
    two = r"(?:^|\.)((?:" + "|".join(second_level or SECOND_LEVEL) + r")\.[a-z]{2})$"
    return F.when(bare.rlike(_ADDRESS), "(address)").when(bare.rlike(two), F.regexp_extract(bare, two, 1)).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, second_level: list[str] | None = None) -> Column:
    """The registered domain: one label more than the suffix, or the whole host, as for an address."""
    bare = _bare(host)
    two = r"((?:^|[^.]+\.)(?:" + "|".join(second_level or SECOND_LEVEL) + r")\.[a-z]{2})$"
    return F.when(bare.rlike(_ADDRESS), bare).when(bare.rlike(two), F.regexp_extract(bare, two, 1)).otherwise(F.substring_index(bare, ".", -2))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a domain above it and starts the path; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.find("/")
        name, start = rule[:at], rule[at:]
        out = F.when(((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start)), F.lit(rule)).otherwise(out)
    return out


def _strength(counts: DataFrame) -> DataFrame:
    """One row: the prior's strength for rows (n, bad, mean), from their spread around their means."""
    m = F.col("mean")
    spread = F.sum((F.col("bad") - F.col("n") * m) * (F.col("bad") - F.col("n") * m) / F.col("n") / (m * (1 - m)))
    rho = F.least(F.lit(0.5), F.greatest(F.lit(0.001), (spread - F.count("*")) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))))
    return counts.where("n > 0").agg(F.when(F.count("*") == 0, F.lit(1.0)).otherwise(1 / rho - 1).alias("strength"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (host, n, bad: labelled pages and bad ones) gives (host, n, mean, bound) for all."""
    hosts = materialise(outcomes.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    whole = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean"))
    level = hosts.groupBy("suffix").agg(*sums).crossJoin(F.broadcast(whole))  # one row
    shrunk = (F.col("bad") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))
    level = materialise(level.crossJoin(F.broadcast(_strength(level))).select("suffix", shrunk.alias("mean")), "suffixes")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(*sums).join(level, "suffix"), "domains")
    domains = materialise(domains.crossJoin(F.broadcast(_strength(domains))).select("domain", "suffix", shrunk.alias("mean")), "domains")
    last = materialise(hosts.join(domains, ["domain", "suffix"]), "hosts")
    weight = F.col("n") + F.col("strength")
    mean = F.col("posterior")
    return (
        last.crossJoin(F.broadcast(_strength(last)))
        .select("host", "n", shrunk.alias("posterior"), weight.alias("weight"))
        .select("host", "n", mean.alias("mean"), (mean - WIDTH * F.sqrt(mean * (1 - mean) / (F.col("weight") + 1))).alias("bound"))
    )


def judge(pages: DataFrame, labels: DataFrame, *, page_label: Column, rules: list[tuple[str, str]] | None = None, most_bad: float = MOST_BAD) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled) for every row of ``pages``.

    ``page_label`` is the key of a page's label in ``labels`` (label_id, bad). A url that is null
    or has no ``://`` has an empty host, judged by what is known of such urls. Pages without a
    label, tables without labels and repeated rows are fine; labels of one key that differ all
    count. With no label at all, the mean is a half and every host has the widest posterior. Page ids may
    be null and repeated, urls very long; an empty table gives no rows. Other columns of ``pages`` aren't kept.
    """
    rules = RULES if rules is None else rules
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), page_label.alias("label_id"))
    counted = urls.select("host", "label_id").join(labels, "label_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = materialise(reputations(counted), "reputations")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    says = F.lit(None).cast("string")
    for verdict, name in rules:
        says = F.when(F.col("rule") == name, verdict).otherwise(says)
    own = F.when(F.col("bound") > most_bad, "block").otherwise("allow")
    return urls.drop("label_id").withColumn("rule", rule).join(known, "host").select("page_id", "host", "path", "rule", F.coalesce(says, own).alias("verdict"), F.col("n").alias("n_labelled"))


def page_labels(labels: DataFrame) -> DataFrame:
    """(label_id, bad): a page is bad if its document is toxic or of no quality."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    return labels.where("doc_id is not null").select(F.col("doc_id").alias("label_id"), bad.cast("long").alias("bad"))


def document_of() -> Column:
    """The document that a page holds: the number that ends its path."""
    return F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("long")


def _rule_sql() -> str:
    out = "CAST(NULL AS VARCHAR)"
    for _, rule in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        at = rule.find("/")
        out = f"CASE WHEN (host = '{rule[:at]}' OR ends_with(host, '.{rule[:at]}')) AND starts_with(path, '{rule[at:]}') THEN '{rule}' ELSE {out} END"
    return out


def _strength_sql(rel: str) -> str:
    return f"""(SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE 1 / least(0.5, greatest(0.001, (sum((bad - n * mean) * (bad - n * mean) / n / (mean * (1 - mean))) - count(*)) / greatest(sum(n - 1), 1))) - 1 END FROM {rel} WHERE n > 0)"""


_SECOND = "|".join(SECOND_LEVEL)
ORACLE = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT *, TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html|/)?$', 1) AS BIGINT) AS label_id, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM u),
l AS (SELECT doc_id AS label_id, CAST(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 AS BIGINT) AS bad FROM labels WHERE doc_id IS NOT NULL),
h AS (SELECT host, any_value(CASE WHEN regexp_matches(bare, '{_ADDRESS}') THEN '(address)' WHEN regexp_matches(bare, '(?:^|\\.)(?:{_SECOND})\\.[a-z]{{2}}$') THEN regexp_extract(bare, '(?:^|\\.)((?:{_SECOND})\\.[a-z]{{2}})$', 1) ELSE string_split(bare, '.')[-1] END) AS suffix,
  any_value(CASE WHEN regexp_matches(bare, '{_ADDRESS}') THEN bare WHEN regexp_matches(bare, '(?:^|[^.]+\\.)(?:{_SECOND})\\.[a-z]{{2}}$') THEN regexp_extract(bare, '((?:^|[^.]+\\.)(?:{_SECOND})\\.[a-z]{{2}})$', 1) ELSE array_to_string(string_split(bare, '.')[-2:], '.') END) AS domain,
  count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM v LEFT JOIN l USING (label_id) GROUP BY host),
w AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT mean FROM w) AS mean FROM h GROUP BY suffix),
s AS (SELECT suffix, (bad + k * mean) / (n + k) AS mean FROM (SELECT *, {_strength_sql("s0")} AS k FROM s0)),
d0 AS (SELECT domain, h.suffix, sum(n) AS n, sum(bad) AS bad, any_value(s.mean) AS mean FROM h JOIN s ON h.suffix = s.suffix GROUP BY domain, h.suffix),
d AS (SELECT domain, suffix, (bad + k * mean) / (n + k) AS mean FROM (SELECT *, {_strength_sql("d0")} AS k FROM d0)),
h0 AS (SELECT host, n, bad, d.mean FROM h JOIN d ON h.domain = d.domain AND h.suffix = d.suffix),
r AS (SELECT host, n, m - {WIDTH} * sqrt(m * (1 - m) / (n + k + 1)) AS bound FROM (SELECT *, (bad + k * mean) / (n + k) AS m FROM (SELECT *, {_strength_sql("h0")} AS k FROM h0))),
j AS (SELECT page_id, v.host, path, {_rule_sql().replace("host", "v.host")} AS rule, n, bound FROM v JOIN r ON v.host = r.host)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{b}' THEN '{a}'" for a, b in RULES)} WHEN bound > {MOST_BAD} THEN 'block' ELSE 'allow' END AS verdict, CAST(n AS BIGINT) AS n_labelled FROM j
"""
