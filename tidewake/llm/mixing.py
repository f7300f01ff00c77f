"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree (domain, language, source).  At each node it is dealt to the children by weight; a
child gets no more than its whole subtree can give (its tokens times max_epochs), and what it leaves is dealt to its
siblings.  A shortage therefore stays among siblings and reaches the parent's siblings only when a whole subtree is
short.  Each leaf then takes whole epochs of its rows and, in the last one, a prefix in that epoch's seeded order.
Budgets are integers and exact: DECIMAL(38,0) arithmetic in windows, no iteration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, draw52, small, stored, table

LEVELS = ("domain", "lang", "source")
DEC = "decimal(38,0)"
#: Runs of a leaf at most; a window adds them up.
MOST_RUNS = 100_000


def deal(nodes: DataFrame, parent: list[str], budget: str = "parent_budget") -> DataFrame:
    """nodes with columns supply, weight (positive integers) and their parent's budget -> the same with `budget`.

    Children are taken by supply/weight, the scarcest first.  With B and W the budget and weights left by the children
    before it, a child is short if supply * W <= B * weight; the short ones are a prefix of that order and give all they
    have, the others get weight / W of what the short ones leave, rounded down.
    """
    w = W.partitionBy(*parent).orderBy((F.col("supply").cast("double") / F.col("weight")).asc(), "name")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*parent)
    d = lambda c: F.col(c).cast(DEC)
    out = (
        nodes.withColumn("_b", d(budget) - F.coalesce(F.sum("supply").over(past), F.lit(0)).cast(DEC))
        .withColumn("_w", (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(past), F.lit(0))).cast(DEC))
        .withColumn("_short", F.col("supply").cast("decimal(19,0)") * F.col("_w").cast("decimal(19,0)") <= F.col("_b").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)"))
        # the first child that isn't short has the most budget a weight still to deal
        .withColumn("_rb", F.first(F.when(~F.col("_short"), F.col("_b")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("_rw", F.first(F.when(~F.col("_short"), F.col("_w")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    share = F.expr("cast((cast(_rb as decimal(19,0)) * cast(weight as decimal(19,0))) div cast(_rw as decimal(19,0)) as bigint)")
    return out.withColumn("budget", F.when(F.col("_short"), F.col("supply")).otherwise(share).cast("long")).drop("_b", "_w", "_short", "_rb", "_rw")


def budgets(leaves: DataFrame, fraction: float, weights: dict[str, Column], max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens -> with budget (tokens).  weights: for each level a positive integer column over the labels down to it (1 where missing); the total is `fraction` of all tokens, rounded down."""
    weigh = lambda level: weights.get(level, F.lit(1)).cast("long")
    leaf = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    lang = leaf.groupBy(*LEVELS[:2]).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
    dom = lang.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
    total = F.floor(F.sum("tokens").over(W.partitionBy("root")).cast("double") * F.lit(float(fraction))).cast("long")
    dom = deal(dom.withColumn("root", F.lit(0)).withColumn("parent_budget", total).withColumn("weight", weigh("domain")).withColumn("name", F.col("domain")), ["root"])
    dom = dom.select("domain", F.col("budget").alias("parent_budget"))
    lang = deal(lang.join(dom, "domain").withColumn("weight", weigh("lang")).withColumn("name", F.col("lang")), ["domain"])
    lang = lang.select("domain", "lang", F.col("budget").alias("parent_budget"))
    leaf = deal(leaf.join(lang, ["domain", "lang"]).withColumn("weight", weigh("source")).withColumn("name", F.col("source")), ["domain", "lang"])
    return leaf.drop("supply", "weight", "name", "parent_budget")


def mix(docs: DataFrame, domain: Column, weights: dict[str, Column], fraction: float, max_epochs: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", run_rows: int = 2_000) -> DataFrame:
    """The chosen rows: all columns of docs in the struct `row`, then domain, lang, source, tokens, epoch, cum_before, leaf_budget.

    fraction: the budget as a part of all tokens (words).  weights: see budgets().  Null
    labels are the label '(none)'.  A row is chosen in an epoch if the tokens before it in the leaf's order of that epoch
    are fewer than the leaf's budget left for it; so the last row may cross the budget, and rows without tokens follow the
    rows before them.  A null text has no tokens.  Rows equal in id have equal places in the order, by tokens then.  An
    empty table gives no rows.  run_rows: about so many rows of a leaf are ordered in one task, and a MOST_RUNS-th of the leaf
    at least.  Runs are stretches of the seeded order, so their number changes no result.
    """
    none = F.lit("(none)")
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("_id"), F.coalesce(domain.cast("string"), none).alias("domain"), F.coalesce(docs[lang_col].cast("string"), none).alias("lang"), F.coalesce(docs[source_col].cast("string"), none).alias("source"), F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)).cast("long").alias("tokens"))
    leaves = stored(base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mix-leaves")
    plan = budgets(leaves, fraction, weights, max_epochs).withColumn("last", F.expr("case when tokens > 0 then budget div tokens else 0 end").cast("int"))
    plan = plan.withColumn("rest", (F.col("budget") - F.col("last") * F.col("tokens")).cast("long")).withColumn("runs", F.least(F.ceil(F.col("docs") / F.lit(float(run_rows))).cast("long"), F.lit(MOST_RUNS)))
    plan = stored(plan.select(*LEVELS, "budget", "last", "rest", "runs"), "mix-plan")
    few = plan.count()
    at = base.join(small(plan, few), list(LEVELS))
    at = at.withColumn("spot", draw52(seed, F.col("last"), F.col("_id"))).withColumn("run", F.expr("spot div (4503599627370496 div runs + 1)"))  # 2**52
    per = at.where("rest > 0").groupBy(*LEVELS, "run").agg(F.sum("tokens").alias("run_tokens"))
    before = per.select(*LEVELS, "run", (F.sum("run_tokens").over(W.partitionBy(*LEVELS).orderBy("run")) - F.col("run_tokens")).alias("before"))
    order = W.partitionBy(*LEVELS, "run").orderBy("spot", F.col("_id").asc_nulls_first(), "tokens")
    ranked = at.withColumn("in_run", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens"))
    ranked = ranked.join(before, [*LEVELS, "run"], "left").withColumn("cum_before", F.col("before") + F.col("in_run"))
    tail = (F.col("rest") > 0) & (F.col("cum_before") < F.col("rest"))
    epochs = F.when(tail, F.sequence(F.lit(0), F.col("last"))).when(F.col("last") > 0, F.sequence(F.lit(0), F.col("last") - 1))
    chosen = ranked.withColumn("epoch", F.explode(epochs))
    return chosen.select("row", *LEVELS, "tokens", F.col("epoch").cast("int").alias("epoch"), F.when(F.col("epoch") == F.col("last"), F.col("cum_before")).cast("long").alias("cum_before"), F.col("budget").alias("leaf_budget"))


def production(docs: DataFrame, max_epochs: int, fraction: float) -> DataFrame:
    """The mix that the query and the pipeline use: four domains (the source's number modulo 4), languages weighted 4 (en), 3 (de, fr) and 2, equal domains and sources."""
    number = F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int)")
    domain = F.coalesce(F.concat(F.lit("domain"), (number % 4).cast("string")), F.lit("domain-"))
    by_lang = F.when(F.col("lang") == "en", 4).when(F.col("lang").isin("de", "fr"), 3).otherwise(2)
    return mix(docs, domain, {"lang": by_lang}, fraction, max_epochs)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return production(docs, max_epochs=2, fraction=0.9).select("row.doc_id", *LEVELS, "tokens", "epoch", "cum_before", "leaf_budget")


def mix_sql(docs: str, max_epochs: int, fraction: float) -> str:
    """DuckDB SQL with the chosen rows of the relation `docs` under production()."""

    def dealt(name: str, nodes: str, parent: str, label: str) -> str:
        order = f"PARTITION BY {parent} ORDER BY supply::DOUBLE / weight, {label}"
        past = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        rest = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return f"""
{name}_a AS (SELECT *, parent_budget::HUGEINT - coalesce(sum(supply) {past}, 0)::HUGEINT AS b, (sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) {past}, 0))::HUGEINT AS w FROM ({nodes})),
{name}_b AS (SELECT *, supply::HUGEINT * w <= b * weight AS short FROM {name}_a),
{name}_c AS (SELECT *, first_value(CASE WHEN NOT short THEN b END IGNORE NULLS) {rest} AS rb, first_value(CASE WHEN NOT short THEN w END IGNORE NULLS) {rest} AS rw FROM {name}_b),
{name} AS (SELECT * EXCLUDE (b, w, short, rb, rw), CASE WHEN short THEN supply ELSE ((rb * weight) // rw)::BIGINT END AS budget FROM {name}_c)"""

    return f"""
WITH base AS (
  SELECT *, coalesce('domain' || (TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT) % 4)::VARCHAR, 'domain-') AS l_domain,
         coalesce(lang, '(none)') AS l_lang, coalesce(source, '(none)') AS l_source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
  FROM ({docs})),
leaves AS (SELECT l_domain, l_lang, l_source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {max_epochs})::BIGINT AS supply FROM base GROUP BY ALL),
langs AS (SELECT l_domain, l_lang, sum(supply)::BIGINT AS supply, sum(tokens)::BIGINT AS tokens FROM leaves GROUP BY ALL),
doms AS (SELECT l_domain, sum(supply)::BIGINT AS supply, sum(tokens)::BIGINT AS tokens FROM langs GROUP BY ALL),{dealt("d", f"SELECT *, 0 AS root, 1 AS weight, floor((SELECT sum(tokens) FROM doms)::DOUBLE * {fraction}::DOUBLE)::BIGINT AS parent_budget FROM doms", "root", "l_domain")},{dealt("l", "SELECT x.*, CASE WHEN l_lang = 'en' THEN 4 WHEN l_lang IN ('de', 'fr') THEN 3 ELSE 2 END AS weight, d.budget AS parent_budget FROM langs x JOIN d USING (l_domain)", "l_domain", "l_lang")},{dealt("s", "SELECT x.*, 1 AS weight, l.budget AS parent_budget FROM leaves x JOIN l USING (l_domain, l_lang)", "l_domain, l_lang", "l_source")},
plan AS (SELECT l_domain, l_lang, l_source, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END::INT AS last, (budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens)::BIGINT AS rest FROM s),
spots AS (SELECT base.*, budget, last, rest, ('0x' || substr(md5('mix|' || last::VARCHAR || '|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS spot FROM base JOIN plan USING (l_domain, l_lang, l_source)),
ranked AS (SELECT *, (sum(tokens) OVER (PARTITION BY l_domain, l_lang, l_source ORDER BY spot, doc_id NULLS FIRST, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens)::BIGINT AS before FROM spots),
chosen AS (SELECT *, unnest(range(CASE WHEN rest > 0 AND before < rest THEN last + 1 ELSE last END))::INT AS epoch FROM ranked)"""


SQL = mix_sql("SELECT doc_id, text, lang, source FROM documents", 2, 0.9) + """
SELECT doc_id, l_domain AS domain, l_lang AS lang, l_source AS source, tokens, epoch, CASE WHEN epoch = last THEN before END AS cum_before, budget AS leaf_budget FROM chosen
"""
