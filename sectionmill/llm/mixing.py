"""Mixing sources to target weights, by hierarchical budgeting.

Budgets flow down a tree of domains, languages and sources in proportion to weights. A
node can take no more tokens than its documents hold times ``max_epochs``; what it can't take
goes to its siblings by their weights, and a parent whose children can't take its share
is itself a short child one level up. A leaf's budget is filled with whole epochs and
a token prefix of one more epoch, whose order is a hash of seed, epoch, id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import RUN, materialise, run_starts

#: Production weights; a domain, language or source that isn't named weighs 1.
DOMAIN_WEIGHTS = {"web": 4.0, "news": 3.0, "forum": 2.0, "reference": 1.0}
LANGUAGE_WEIGHTS = {"en": 3.0}
BUDGET, MAX_EPOCHS, SEED = 0.8, 2, 20260
NONE = "(none)"
LEAF = ["domain", "language", "site"]


def domain_of(source: Column) -> Column:
    """The production tree: the number that ends a source's name gives its domain."""
    digit = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    return (
        F.when(digit.isin("0", "4", "8"), "web").when(digit.isin("1", "5", "9"), "news").when(digit.isin("2", "6"), "forum").otherwise("reference")
    )


def _weight(name: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(F.col(name) == k, F.lit(float(v))).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Share ``budget`` (same in all rows of a parent) among children by ``weight`` up to ``cap``.

    Children in order of cap/weight fill up first; the level at which the rest share is the
    greatest of (budget - caps before) / (weights from here on). For the upper levels of the tree, whose
    parents have few children.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), child)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.max("level").over(Window.partitionBy(*parent))
    return nodes.withColumn("level", (F.col("budget") - before) / ahead).withColumn("share", F.least(F.col("cap").cast("double"), F.greatest(F.lit(0.0), level * F.col("weight")))).drop("level", "weight", "budget")


def share_out_wide(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """The same shares where a parent may have millions of children, by aggregates alone.

    Each round takes the children that are full at the level so far out of the budget and lets the others
    share what is left, which raises the level; it ends when a round fills no other child.
    """
    nodes = materialise(nodes, "nodes")
    whole = nodes.groupBy(*parent).agg(F.min("budget").alias("budget"), F.sum("weight").alias("weights"))
    levels = materialise(whole.select(*parent, "budget", (F.col("budget") / F.col("weights")).alias("level")), "levels")
    full = F.col("cap") <= F.col("level") * F.col("weight")
    filled = -1
    while True:
        now = nodes.drop("budget").join(levels, parent).groupBy(*parent).agg(
            F.min("budget").alias("budget"), F.min("level").alias("level"), F.count_if(full).alias("full"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        )
        now = materialise(now.select(*parent, "budget", F.coalesce((F.col("budget") - F.col("caps")) / F.col("weights"), "level").alias("level"), "full"), "levels")
        count = now.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("n")).first()["n"]
        levels = now.drop("full")
        if count == filled:
            break
        filled = count
    return nodes.drop("budget").join(levels, parent).withColumn("share", F.least(F.col("cap").cast("double"), F.greatest(F.lit(0.0), F.col("level") * F.col("weight")))).drop("level", "weight", "budget")


def leaf_budgets(
    leaves: DataFrame, budget: float, *, max_epochs: int = MAX_EPOCHS, domain_weights: dict[str, float] | None = None, language_weights: dict[str, float] | None = None, source_weights: dict[str, float] | None = None
) -> DataFrame:
    """``leaves`` (domain, language, site, tokens) with ``share`` tokens of ``budget`` x all tokens."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total))  # one row
    domains = domains.select("domain", "cap", F.lit(0).alias("root"), (F.col("all_tokens") * F.lit(float(budget))).alias("budget"), _weight("domain", domain_weights or {}).alias("weight"))
    domains = share_out(domains, ["root"], "domain").select("domain", F.col("share").alias("budget"))
    languages = caps.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(domains, "domain").withColumn("weight", _weight("language", language_weights or {}))
    languages = share_out(languages, ["domain"], "language").select("domain", "language", F.col("share").alias("budget"))
    sites = caps.join(languages, ["domain", "language"]).withColumn("weight", _weight("site", source_weights or {}))
    return share_out_wide(sites, ["domain", "language"])


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, domain: Column | None, keep: Column) -> DataFrame:
    return docs.select(
        keep.alias("kept"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
        (domain_of(F.col(source_col)) if domain is None else domain).alias("domain"),
        F.coalesce(F.col(lang_col), F.lit(NONE)).alias("language"),
        F.coalesce(F.col(source_col), F.lit(NONE)).alias("site"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long").alias("tokens"),
    )


def _copies(rows: DataFrame, counted: DataFrame, budget: float, max_epochs: int, seed: int, weights: list[dict[str, float] | None]) -> DataFrame:
    """``rows`` with ``copies``; ``counted`` are the same rows without what only passes through."""
    leaves = materialise(counted.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    shares = leaf_budgets(leaves, budget, max_epochs=max_epochs, domain_weights=weights[0], language_weights=weights[1], source_weights=weights[2])
    full = F.col("share") >= F.col("cap")
    epochs = F.when(F.col("tokens") == 0, 0).when(full, max_epochs).otherwise(F.floor(F.col("share") / F.col("tokens") + 1e-9)).cast("long")
    shares = shares.select(*LEAF, epochs.alias("epochs"), "share", F.col("tokens").alias("leaf_tokens"), F.floor(F.col("n") / RUN + 1).alias("runs"), full.alias("full"))
    shares = materialise(shares.select(*LEAF, "epochs", "runs", F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("share") - F.col("epochs") * F.col("leaf_tokens")).alias("rest")), "shares")
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), "digest"))
    run = F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * F.col("runs") / (1 << 28))
    place = lambda df: df.join(shares, LEAF).withColumn("key", key).withColumn("run", run).drop("runs")
    sums = place(counted).groupBy(*LEAF, "run").agg(F.sum("tokens").alias("run_tokens"))
    starts = materialise(run_starts(sums, LEAF, "run_tokens"), "starts")
    within = Window.partitionBy(*LEAF, "run").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    return place(rows).join(starts, [*LEAF, "run"]).withColumn("copies", F.col("epochs") + (before < F.col("rest")).cast("long"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, domain: Column | None = None, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
    domain_weights: dict[str, float] | None = None, language_weights: dict[str, float] | None = None, source_weights: dict[str, float] | None = None,
) -> DataFrame:
    """(id, domain, language, site, tokens, copies) for every row of ``docs``.

    ``copies`` tells how often the mix takes the document, 0 if it doesn't. Tokens are runs
    of characters other than blanks, tabs and line ends; a null or empty text has none, a very long one is counted
    whole. Null languages and sources are leaves named ``(none)``; ids may be null, repeated and of any type. A
    document is in a leaf's last prefix if fewer tokens than the rest of the budget stand before it, in the order of
    a hash of seed, epoch, id and text: only rows equal in id and text tie there, and one of these is
    as good as the other. An empty table gives an empty result. Other columns aren't read.
    """
    rows = materialise(_rows(docs, id_col, text_col, lang_col, source_col, domain, F.lit(0)), "tokens")
    weights = [DOMAIN_WEIGHTS if domain_weights is None else domain_weights, LANGUAGE_WEIGHTS if language_weights is None else language_weights, source_weights]
    return _copies(rows, rows, budget, max_epochs, seed, weights).select(F.col("id").alias(id_col), *LEAF, "tokens", "copies")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, domain: Column | None = None, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
    domain_weights: dict[str, float] | None = None, language_weights: dict[str, float] | None = None, source_weights: dict[str, float] | None = None,
) -> DataFrame:
    """The mix itself: each row of ``docs``, with its columns, as often as :func:`mix` takes it.

    Rows go through the last ordering whole, so nothing is joined by id. ``docs`` is read twice and must
    be the same rows both times, as a written table is.
    """
    rows = _rows(docs, id_col, text_col, lang_col, source_col, domain, F.struct(*[F.col(c) for c in docs.columns]))
    counted = materialise(rows.drop("kept"), "tokens")
    weights = [DOMAIN_WEIGHTS if domain_weights is None else domain_weights, LANGUAGE_WEIGHTS if language_weights is None else language_weights, source_weights]
    taken = _copies(rows, counted, budget, max_epochs, seed, weights).where("copies > 0")
    return taken.select("kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("kept.*")


def _case(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1.0 END"


def _share_sql(nodes: str, parent: str, child: str) -> str:
    """The same water-filling over a relation with budget, cap and weight."""
    return f"""SELECT *, least(CAST(cap AS DOUBLE), greatest(0.0, max(level) OVER (PARTITION BY {parent}) * weight)) AS share FROM (
    SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ({nodes}))"""


def oracle_sql(relation: str = "documents", budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL for :func:`mix` with the production weights."""
    digit = "regexp_extract(coalesce(source, ''), '([0-9])$', 1)"
    return f"""
WITH tok AS (
  SELECT doc_id, CASE WHEN {digit} IN ('0','4','8') THEN 'web' WHEN {digit} IN ('1','5','9') THEN 'news'
      WHEN {digit} IN ('2','6') THEN 'forum' ELSE 'reference' END AS domain,
    coalesce(lang, '{NONE}') AS language, coalesce(source, '{NONE}') AS site, coalesce(text, '') AS text,
    CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS BIGINT) AS tokens FROM {relation}
), leaf AS (
  SELECT domain, language, site, sum(tokens) AS tokens, sum(tokens) * {max_epochs} AS cap FROM tok GROUP BY ALL
), d AS (
  {_share_sql(f"SELECT domain, sum(cap) AS cap, (SELECT sum(tokens) FROM leaf) * {budget} AS budget, {_case('domain', DOMAIN_WEIGHTS)} AS weight FROM leaf GROUP BY domain", "1", "domain")}
), l AS (
  {_share_sql(f"SELECT leaf.domain, language, sum(leaf.cap) AS cap, any_value(d.share) AS budget, {_case('language', LANGUAGE_WEIGHTS)} AS weight FROM leaf JOIN d ON leaf.domain = d.domain GROUP BY leaf.domain, language", "domain", "language")}
), s AS (
  {_share_sql("SELECT leaf.domain, leaf.language, site, tokens, leaf.cap, l.share AS budget, 1.0 AS weight FROM leaf JOIN l ON leaf.domain = l.domain AND leaf.language = l.language", "domain, language", "site")}
), e AS (
  SELECT *, CAST(CASE WHEN tokens = 0 THEN 0 WHEN share >= cap THEN {max_epochs} ELSE floor(share / tokens + 1e-9) END AS BIGINT) AS epochs FROM s
), k AS (
  SELECT tok.*, epochs, CASE WHEN share >= cap THEN 0.0 ELSE share - epochs * e.tokens END AS rest,
    md5('{seed}-' || epochs || '-' || doc_id || '-' || md5(text)) AS key
  FROM tok JOIN e ON tok.domain = e.domain AND tok.language = e.language AND tok.site = e.site
)
SELECT doc_id, domain, language, site, tokens, epochs + CAST(coalesce(sum(tokens) OVER
    (PARTITION BY domain, language, site ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest AS BIGINT) AS copies FROM k
"""
