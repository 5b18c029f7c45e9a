"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A token budget goes down from the root: every
node shares its budget among its children by weight. A child that cannot use its share
(its documents, read ``max_epochs`` times, hold less) passes the rest to its siblings;
only what all siblings together cannot use stays with the ancestors' other branches,
because a child's own limit is what its whole subtree holds.

A leaf reads its documents in epochs, each in an order of its own given by a keyed hash.
It takes whole epochs while its budget lasts and then a prefix of the next order, whose
last document may be cut. The cut is found from token sums per order block (``65,536``
per leaf and epoch) and a window over the one block it lies in, so no leaf is ever
sorted as a whole. Everything is aggregates and small joins; the final pass over the
documents is a filter against one row per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.llm.common import SPACES, bounded, pieces, row_hash
from sparktrail.session import materialize

SEED = "mix-1"
MAX_EPOCHS = 2
#: Share of all tokens that the registered query asks for.
BUDGET_PERCENT = 60
#: Most leaves whose limits are broadcast.
BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")


def n_tokens(text: Column) -> Column:
    """Words between ASCII blanks; null text has none."""
    return F.size(pieces(text, SPACES + "+")).cast("long")


def _name_hash(name: Column) -> Column:
    head = F.substring(F.md5(F.coalesce(name, F.lit(""))), 1, 6)
    return F.conv(head, 16, 10).cast("long")


def default_domain(source: Column) -> Column:
    """Three domains by a hash of the source's name, where no mapping is given."""
    return F.concat(F.lit("domain"), (_name_hash(source) % 3).cast("string"))


def default_weight(name: Column) -> Column:
    """1 to 4 from the node's name, so that siblings differ."""
    return 1 + _name_hash(name) % 4


def order_key(epoch: Column, doc_id: Column, seed: str) -> Column:
    text = F.concat_ws("/", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.md5(text)


def _share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Share ``budget`` of each parent among its children ``(weight, capacity)`` as ``allotted``.

    Children fill up in the order of capacity by weight. One is full if its capacity is
    below its share of what the ones before left; the others share the rest by weight.
    All in whole tokens: shares are differences of rounded running sums.
    """
    node = nodes.columns[len(parents)]
    wide = "decimal(38,0)"
    w, c, b = (F.col(x).cast(wide) for x in ("weight", "capacity", "budget"))
    group = Window.partitionBy(*parents)
    by_need = group.orderBy((F.col("capacity") / F.col("weight")), node)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast(wide)
    nodes = nodes.withColumn("left", b - F.coalesce(F.sum(c).over(before), zero)).withColumn(
        "weights", F.sum(w).over(from_here)
    )
    nodes = nodes.withColumn("full", c * F.col("weights") <= w * F.col("left"))
    # From the first child that is not full on, none is.
    nodes = nodes.withColumn("open", F.max(F.when(~F.col("full"), 1).otherwise(0)).over(by_need) == 1)
    rest = F.max(F.when(F.col("open"), F.col("left"))).over(group)
    total = F.max(F.when(F.col("open"), F.col("weights"))).over(group)
    upto = F.sum(F.when(F.col("open"), w).otherwise(zero)).over(by_need.rowsBetween(Window.unboundedPreceding, 0))
    nodes = nodes.withColumn("rest", rest).withColumn("total", total).withColumn("upto", upto)
    share = F.expr("rest * upto div total - rest * (upto - weight) div total")
    return nodes.withColumn("allotted", F.when(F.col("open"), share).otherwise(F.col("capacity")).cast("long")).drop(
        "left", "weights", "full", "open", "rest", "total", "upto"
    )


def allot(leaves: DataFrame, budget: int, max_epochs: int, weight=default_weight) -> DataFrame:
    """Leaves ``domain, lang, source, tokens`` with the ``allotted`` tokens of each."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    above = None
    for depth in range(1, len(LEVELS) + 1):
        path, parents = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        if above is None:
            nodes = nodes.withColumn("budget", F.least(F.lit(budget), F.sum("capacity").over(Window.partitionBy())))
        else:
            held = above.select(*(F.col(p).alias(f"_{p}") for p in parents), F.col("allotted").alias("budget"))
            same = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parents]
            nodes = nodes.join(held, same).drop(*(f"_{p}" for p in parents))
        nodes = nodes.withColumn("weight", weight(F.col(path[-1])))
        nodes = nodes.select(*parents, path[-1], "weight", "capacity", "budget")
        above = _share(nodes, parents)
    return above.select(*LEVELS, "allotted")


def _narrow_columns(domain=default_domain) -> list[Column]:
    return [
        F.col("doc_id"),
        row_hash(F.col("text")).alias("text_hash"),
        domain(F.col("source")).alias("domain"),
        F.col("lang"),
        F.col("source"),
        n_tokens(F.col("text")).alias("n_tokens"),
    ]


def _narrow(documents: DataFrame, domain) -> DataFrame:
    return documents.select(*_narrow_columns(domain))


def _on_leaf(left: DataFrame, right: DataFrame, how: str = "inner", small: bool = False) -> DataFrame:
    """Join on the leaf, null-safe. ``right`` has at most one row per leaf and its own columns."""
    named = right.select(*(F.col(c).alias(f"_{c}") if c in LEVELS else F.col(c) for c in right.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LEVELS]
    named = F.broadcast(named) if small else named
    return left.join(named, same, how).drop(*(f"_{c}" for c in LEVELS))


def plan(spark, narrow: DataFrame, budget: int | None, max_epochs: int, seed: str, weight=default_weight):
    """One row per leaf: tokens, allotted, whole epochs, what is left for the prefix, and where it ends.

    Documents of the next epoch are taken up to ``(cut_key, cut_id, cut_hash)``; the one there
    gives ``cut_take`` tokens.
    """
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = materialize(spark, leaves, "leaves")
    if budget is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
        budget = total * BUDGET_PERCENT // 100
    small = bounded(leaves, BROADCAST_LEAVES)
    shares = _on_leaf(leaves, allot(leaves, budget, max_epochs, weight), small=small)
    shares = shares.withColumn("epochs", F.expr("if(tokens = 0, 0, allotted div tokens)")).withColumn(
        "prefix", F.col("allotted") - F.col("epochs") * F.col("tokens")
    )
    shares = materialize(spark, shares, "shares")

    cut = shares.filter("prefix > 0").select(*LEVELS, "epochs", "prefix")
    keyed = _on_leaf(narrow.filter("n_tokens > 0"), cut, small=small).withColumn(
        "key", order_key(F.col("epochs"), F.col("doc_id"), seed)
    )
    keyed = keyed.withColumn("block", F.conv(F.substring("key", 1, 4), 16, 10).cast("int"))
    sums = keyed.groupBy(*LEVELS, "prefix", "block").agg(F.sum("n_tokens").alias("tokens"))
    running = Window.partitionBy(*LEVELS).orderBy("block")
    ends = F.sum("tokens").over(running)
    found = sums.withColumn("ends", ends).withColumn("starts", F.col("ends") - F.col("tokens"))
    found = found.filter("starts < prefix AND ends >= prefix").select(*LEVELS, F.col("block").alias("cut_block"), "starts")
    inside = _on_leaf(keyed, found, small=small).filter("block = cut_block")
    order = Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "text_hash")
    inside = inside.withColumn("upto", F.col("starts") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.withColumn("before", F.col("upto") - F.col("n_tokens")).filter("before < prefix AND upto >= prefix")
    last = last.groupBy(*LEVELS).agg(
        F.min(F.struct("key", "doc_id", "text_hash", (F.col("prefix") - F.col("before")).alias("take"))).alias("cut")
    )
    whole = _on_leaf(shares, last, "left", small=small)
    return materialize(spark, whole, "limits"), small


def select(narrow: DataFrame, limits: DataFrame, small: bool, seed: str) -> DataFrame:
    """``narrow`` rows with ``epoch`` and ``taken`` tokens, once per epoch that takes them."""
    limits = limits.filter("allotted > 0").select(*LEVELS, "epochs", "prefix", "cut")
    rows = _on_leaf(narrow, limits, small=small)
    here = F.struct(
        order_key(F.col("epochs"), F.col("doc_id"), seed).alias("key"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash")
    )
    end = F.struct(F.col("cut.key").alias("key"), F.col("cut.doc_id").alias("doc_id"), F.col("cut.text_hash").alias("text_hash"))
    extra = F.when((F.col("prefix") > 0) & (here <= end), 1).otherwise(0)
    rows = rows.withColumn("times", F.col("epochs") + extra).filter("times > 0 AND n_tokens > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)))
    at_cut = (F.col("epoch") == F.col("epochs")) & (here == end)
    taken = F.when(at_cut, F.col("cut.take")).otherwise(F.col("n_tokens"))
    return rows.withColumn("taken", taken).drop("epochs", "prefix", "cut", "times")


def mix(
    documents: DataFrame,
    budget: int | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    domain=default_domain,
    weight=default_weight,
) -> DataFrame:
    """The chosen documents: ``doc_id, text_hash, domain, lang, source, n_tokens, epoch, taken``.

    ``budget`` counts tokens; None asks for BUDGET_PERCENT of all. A budget above what
    ``max_epochs`` readings hold takes everything. Null languages and sources are leaves of
    their own; texts without words are never chosen; rows with one id and text share
    their place in the order and are cut together. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    narrow = materialize(spark, _narrow(documents, domain), "narrow")
    limits, small = plan(spark, narrow, budget, max_epochs, seed, weight)
    return select(narrow, limits, small, seed)


def mix_documents(documents: DataFrame, percent: int, seed: str = SEED) -> DataFrame:
    """Whole rows of ``documents`` for ``percent`` of their tokens, each at most once.

    The document at a cut stays whole. Texts are not shuffled: the limits are joined to
    the rows.
    """
    spark = documents.sparkSession
    narrow = materialize(spark, _narrow(documents, default_domain), "narrow")
    total = narrow.agg(F.sum("n_tokens")).first()[0] or 0
    limits, small = plan(spark, narrow, total * percent // 100, 1, seed)
    columns = documents.columns
    rows = documents.select(F.struct(*columns).alias("row"), *_narrow_columns())
    return select(rows, limits, small, seed).select("row.*")


def op10_mixing(spark, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return mix(documents).drop("text_hash")



def _level_sql(name: str, parents: list[str], node: str, source: str, budget: str) -> str:
    """One level of the tree: children of every parent with their allotted tokens."""
    path = ", ".join([*parents, node])
    part = "PARTITION BY " + ", ".join(parents) + " " if parents else ""
    order = f"{part}ORDER BY capacity / weight, {node}"
    return f"""
{name}_nodes AS (
  SELECT n.*, {budget} AS budget,
    1 + ('0x' || substr(md5(coalesce({node}, '')), 1, 6))::BIGINT % 4 AS weight
  FROM (SELECT {path}, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY ALL) n {source}),
{name}_left AS (
  SELECT *, budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {name}_nodes),
{name}_open AS (
  SELECT *, max(CASE WHEN capacity * weights <= weight * remains THEN 0 ELSE 1 END) OVER ({order}) = 1 AS open FROM {name}_left),
{name}_rest AS (
  SELECT *, max(CASE WHEN open THEN remains END) OVER ({part}) AS rest,
    max(CASE WHEN open THEN weights END) OVER ({part}) AS total,
    sum(CASE WHEN open THEN weight ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM {name}_open),
{name} AS (
  SELECT {path}, CAST(CASE WHEN open THEN rest * upto // total - rest * (upto - weight) // total ELSE capacity END AS BIGINT) AS allotted
  FROM {name}_rest),"""


OP10_SQL = (
    r"""
WITH narrow AS (
  SELECT doc_id, 'domain' || (('0x' || substr(md5(coalesce(source, '')), 1, 6))::BIGINT % 3) AS domain, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
totals AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM narrow GROUP BY ALL),"""
    + f"""
leaves AS (SELECT *, tokens * {MAX_EPOCHS} AS capacity FROM totals),"""
    + _level_sql(
        "d", [], "domain", "", f"(SELECT least(CAST(sum(tokens) AS BIGINT) * {BUDGET_PERCENT} // 100, CAST(sum(capacity) AS BIGINT)) FROM leaves)"
    )
    + _level_sql("l", ["domain"], "lang", "JOIN d ON n.domain = d.domain", "d.allotted")
    + _level_sql(
        "s", ["domain", "lang"], "source", "JOIN l ON n.domain = l.domain AND n.lang IS NOT DISTINCT FROM l.lang", "l.allotted"
    )
    + f"""
shares AS (
  SELECT t.*, allotted // nullif(tokens, 0) AS epochs, allotted % nullif(tokens, 0) AS prefix
  FROM totals t JOIN s ON t.domain = s.domain AND t.lang IS NOT DISTINCT FROM s.lang AND t.source IS NOT DISTINCT FROM s.source),
rows AS (
  SELECT n.*, epochs, prefix, md5('{SEED}/' || epochs || '/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM narrow n JOIN shares t ON n.domain = t.domain AND n.lang IS NOT DISTINCT FROM t.lang
    AND n.source IS NOT DISTINCT FROM t.source WHERE n_tokens > 0),
running AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before FROM rows)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(n_tokens AS BIGINT) AS taken
FROM rows, unnest(range(epochs)) t(epoch)
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs AS INTEGER), CAST(least(n_tokens, prefix - before) AS BIGINT)
FROM running WHERE before < prefix
"""
)
