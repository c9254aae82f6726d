"""Mixing of sources to target weights under a token budget."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, write_table

LEVELS = ("domain", "lang", "source")
#: How often a leaf's documents may be repeated at most.
MAX_EPOCHS = 4
#: Production weights of the query; a node that isn't named has weight 1.
WEIGHTS = {("domain0",): 5, ("domain1",): 3, ("domain2",): 2, ("domain0", "en"): 6, ("domain1", "en"): 4, ("domain1", "fr"): 2}


def _weight(weights: Mapping[tuple[str, ...], int], keys: list[str]) -> Column:
    own = {path: w for path, w in weights.items() if len(path) == len(keys)}
    out = F.lit(1)
    for path, w in own.items():
        out = F.when(F.array(*keys) == F.array(*map(F.lit, path)), F.lit(w)).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``grant`` to rows of (parent columns, name, cap, weight, budget of the parent).

    Each child gets its share by weight, but no more than ``cap``; what a child can't use goes to its
    siblings in proportion to their weights, until all are full. Grants are whole numbers and sum
    up to the smaller of budget and caps. A child of weight 0 gets nothing. Equal children go by name.
    """
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = of.orderBy((F.col("cap") / F.nullif(F.col("weight"), F.lit(0))).asc_nulls_last(), "name")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), lambda c: c.cast("decimal(38,0)")
    filled = F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(of) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = children.withColumn("full", (F.col("weight") > 0) & (whole(F.col("cap")) * rest <= whole(F.col("budget") - filled) * F.col("weight")))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(of), F.lit(0))
    free = F.when(F.col("full"), 0).otherwise(F.col("weight"))
    rows = rows.withColumns({"left": left, "free": F.sum(free).over(of), "upto": F.sum(free).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    cut = lambda w: F.expr(f"cast(cast(left as decimal(38,0)) * ({w}) div greatest(free, 1) as bigint)")
    return rows.withColumn("grant", F.when(F.col("full"), F.col("cap")).otherwise(cut("upto") - cut("upto - weight"))).drop("full", "left", "free", "upto")


def leaf_budgets(leaves: DataFrame, budget: int, weights: Mapping[tuple[str, ...], int], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``budget`` to rows of (levels, tokens): the tree's budget handed down level by level.

    A subtree's cap is all its leaves can give in ``max_epochs``. As a parent only gets what its
    subtree can use, shortages go to siblings first and only what a whole subtree lacks goes to its
    parent's siblings.
    """
    held = None
    for depth in range(1, len(LEVELS) + 1):
        keys = list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys).agg(F.sum(F.col("tokens") * max_epochs).alias("cap")).withColumn("name", F.col(keys[-1])).withColumn("weight", _weight(weights, keys))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if held is None else nodes.join(held, keys[:-1])
        held = share_out(nodes, keys[:-1]).select(*keys, F.col("grant").alias("budget"))
    return leaves.join(held, list(LEVELS))


def mix(docs: DataFrame, budget: int | None = None, weights: Mapping[tuple[str, ...], int] = WEIGHTS, seed: int = 17, max_epochs: int = MAX_EPOCHS, part: float = 0.5) -> DataFrame:
    """doc_id, epoch, domain, lang, source, n_tokens, take_tokens: one row for each use of a document.

    ``docs`` has doc_id, text, domain, lang and source. Tokens are words; the budget is a count of
    them, or ``part`` of all. Each leaf's documents are put in an order of their own for every epoch (by
    a hash of seed, epoch and doc_id); the leaf's budget is a prefix of the epochs' tokens one after another.
    A document whose tokens begin before the budget ends is used; of the last one, take_tokens
    may be less than n_tokens.

    Null lang, source or domain are a node named ``none``. Documents without words are never used.
    Rows of one doc_id each count, rows with a null doc_id too. Other columns are not read; an empty table gives an empty one. The place in a leaf is found from sums over hash ranges first,
    so no leaf is sorted in one task.
    """
    keys = [F.coalesce(F.col(k), F.lit("none")).alias(k) for k in LEVELS]
    rows = docs.select("doc_id", *keys, F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens")).filter("n_tokens > 0")
    rows = write_table(rows, "counts")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * part)
    plan = leaf_budgets(leaves, budget, weights, max_epochs).select(*LEVELS, F.expr("budget div tokens").alias("turns"), F.expr("budget % tokens").alias("rest"))
    rows = rows.join(plan, list(LEVELS))
    whole = rows.filter("turns > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("turns") - 1).cast("int")))).withColumn("take_tokens", F.col("n_tokens"))
    last = rows.filter("rest > 0").withColumn("epoch", F.col("turns").cast("int"))
    last = last.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "doc_id").cast("binary"))).withColumn("range", F.substring("h", 1, 3))
    ranges = last.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("t"))
    ranges = ranges.withColumn("offset", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("range")) - F.col("t")).drop("t")
    own = Window.partitionBy(*LEVELS, "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = last.join(ranges, [*LEVELS, "range"]).filter("offset < rest")
    last = last.withColumn("begin", F.col("offset") + F.sum("n_tokens").over(own) - F.col("n_tokens")).filter("begin < rest")
    last = last.withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("begin")))
    names = ["doc_id", "epoch", *LEVELS, "n_tokens", "take_tokens"]
    return whole.select(*names).union(last.select(*names))


def domain_of(source: Column) -> Column:
    """The query's tree: a source's number mod 4 is its domain."""
    n = F.regexp_extract(source, "([0-9]+)", 1)
    return F.when(n != "", F.concat(F.lit("domain"), F.substring(n, -4, 4).cast("int") % 4))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uses of all documents under half of all words as budget, by WEIGHTS."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "text", "lang", "source", domain_of(F.col("source")).alias("domain")))


def _level_sql(depth: int) -> str:
    keys, up = LEVELS[:depth], LEVELS[: depth - 1]
    k, of = ", ".join(keys), f"PARTITION BY {', '.join(up)}" if up else ""
    own = [(p, w) for p, w in WEIGHTS.items() if len(p) == depth]
    weight = "CASE " + " ".join(f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(keys, p))} THEN {w}" for p, w in own) + " ELSE 1 END" if own else "1"
    parent = f"JOIN g{depth - 1} USING ({', '.join(up)})" if up else "CROSS JOIN (SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) AS budget FROM leaves)"
    order = f"{of} ORDER BY cap / nullif(weight, 0) NULLS LAST, {keys[-1]}"
    return f"""
n{depth} AS (SELECT c.*, budget, CAST({weight} AS HUGEINT) AS weight FROM (SELECT {k}, CAST(sum(tokens * {MAX_EPOCHS}) AS HUGEINT) AS cap FROM leaves GROUP BY {k}) c {parent}),
f{depth} AS (SELECT *, weight > 0 AND cap * (sum(weight) OVER ({of}) - coalesce(sum(weight) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  <= (budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled FROM n{depth}),
s{depth} AS (SELECT *, budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({of}), 0) AS rest, sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({of}) AS free,
  sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f{depth}),
g{depth} AS (SELECT {k}, CASE WHEN filled THEN cap ELSE rest * upto // greatest(free, 1) - rest * (upto - weight) // greatest(free, 1) END AS budget FROM s{depth}),"""


def mix_sql(table: str, source: str = "source", seed: int = 17) -> str:
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH rows AS (SELECT doc_id, coalesce(CASE WHEN regexp_extract({source}, '[0-9]+') <> '' THEN 'domain' || (CAST(right(regexp_extract({source}, '[0-9]+'), 4) AS INT) % 4) END, 'none') AS domain,
  coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, len(regexp_extract_all(text, '{word}')) AS n_tokens FROM {table} WHERE len(regexp_extract_all(text, '{word}')) > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM rows GROUP BY ALL),{_level_sql(1)}{_level_sql(2)}{_level_sql(3)}
plan AS (SELECT domain, lang, source, budget // tokens AS turns, budget % tokens AS rest FROM leaves JOIN g3 USING (domain, lang, source)),
r AS (SELECT * FROM rows JOIN plan USING (domain, lang, source)),
w AS (SELECT doc_id, e AS epoch, domain, lang, source, n_tokens, n_tokens AS take_tokens FROM r, unnest(range(0, CAST(turns AS BIGINT))) AS t(e)),
l AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || turns || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM r)
SELECT doc_id, CAST(epoch AS BIGINT) AS epoch, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(take_tokens AS BIGINT) AS take_tokens FROM w
UNION ALL
SELECT doc_id, CAST(turns AS BIGINT), domain, lang, source, CAST(n_tokens AS BIGINT), CAST(least(n_tokens, rest - start) AS BIGINT) FROM l WHERE start < rest
"""


OP3_SQL = mix_sql("documents")
