"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source. A token budget goes down from the root: at each node it is split among the children in
proportion to their weights, no child getting more than its subtree can give (its tokens times max_epochs). What a child lacks goes to
its siblings first, and only what a whole subtree lacks has gone to its own siblings one level up, because a node's capacity
is the sum of its leaves'. The split is water filling, computed with windows over the node table: children in order of capacity by
weight, those below the water level are filled, the rest share in proportion.

A leaf with budget b and t tokens gives each document floor(b / t) times and once more the prefix, in a seeded order, that
holds the rest of b: documents before which less than the rest has been taken. The order is that of md5(seed, epoch, document), so
that every epoch has an order of its own; the cut is found in two steps, over the sums of 4,096 ranges of the order and
then inside one range, so that no task sorts a whole leaf.

Defined results: null domain, language or source form nodes of their own; a null text has no tokens; a node without tokens has the budget 0; documents without tokens
belong to every whole epoch and to a prefix while it lasts; repeated rows share their place in the order and are taken together; an empty
table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.llm.common import unused, written

LEVELS = ("domain", "lang", "source")
SEED, MAX_EPOCHS, SMOOTH = 17, 3, 0.7


def domain_of(source: Column) -> Column:
    """The default domain of a source: four groups by the number in its name."""
    return F.concat(F.lit("domain"), F.pmod(F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint)"), F.lit(0)), F.lit(4)).cast("string"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent columns, name, weight, capacity, budget (the parent's). Replaces budget by the node's own share."""
    ratio = F.when(F.col("weight") > 0, F.try_divide("capacity", "weight")).otherwise(F.lit(float("inf")))
    order = W.partitionBy(*parent).orderBy(ratio, name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = F.try_divide(F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)), F.sum("weight").over(after))  # null where no weight is left
    full = F.col("weight") * level >= F.col("capacity")
    out = nodes.withColumn("_full", F.coalesce(full, F.lit(False))).withColumn("_taken", F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(W.partitionBy(*parent)), F.lit(0.0)))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(W.partitionBy(*parent))
    share = F.when(F.col("_full"), F.col("capacity")).when(F.col("weight") <= 0, F.lit(0.0)).otherwise(F.try_divide(F.greatest(F.lit(0.0), F.col("budget") - F.col("_taken")) * F.col("weight"), open_weight))
    return out.withColumn("budget", share).drop("_full", "_taken")


def budgets(leaves: DataFrame, total: float, weights: dict[str, DataFrame] | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves: domain, lang, source, tokens. weights: for a level, a table of its path columns and `weight`; else tokens ** SMOOTH.
    Returns the leaves with budget, whole (epochs) and rest (tokens of the last one)."""
    root = None
    for depth in range(1, len(LEVELS) + 1):
        path = list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("tokens").cast("double").alias("own"))
        nodes = nodes.withColumn("capacity", F.col("own") * max_epochs)
        same = lambda left, right, cols: [left[c].eqNullSafe(right[c]) for c in cols]
        if weights and LEVELS[depth - 1] in weights:
            given = weights[LEVELS[depth - 1]]
            nodes = nodes.join(given, same(nodes, given, path), "left").select(*[nodes[c] for c in path], "own", "capacity", F.coalesce(given["weight"], F.lit(0.0)).alias("weight"))
        else:
            nodes = nodes.withColumn("weight", F.pow("own", F.lit(SMOOTH)))
        if root is None:
            nodes = nodes.withColumn("budget", F.lit(float(total)))
        else:
            up = root.select(*[F.col(c).alias(f"_{c}") for c in path[:-1]], "budget")
            nodes = nodes.join(up, [nodes[c].eqNullSafe(up[f"_{c}"]) for c in path[:-1]]).select(*path, "own", "capacity", "weight", "budget")
        root = water_fill(nodes, path[:-1] or [F.lit(0)], path[-1])
    whole = F.coalesce(F.floor(F.try_divide("budget", "own") + 1e-9), F.lit(0)).cast("long")
    return root.select(*LEVELS, F.col("own").cast("long").alias("tokens"), F.round("budget", 3).alias("budget"), whole.alias("whole")).withColumn(
        "rest", F.greatest(F.lit(0.0), F.round(F.col("budget") - F.col("whole") * F.col("tokens"), 3))
    )


def appended(docs: DataFrame) -> tuple[str, str, str]:
    """The names that `mix` gives to domain, n_tokens and epoch."""
    return tuple(unused(c, docs) for c in ("domain", "n_tokens", "epoch"))


def mix(docs: DataFrame, share: float = 1.0, weights: dict[str, DataFrame] | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """The rows of docs once for each epoch that takes them, with domain, n_tokens and epoch (from 0) appended. Budget: share of all tokens.
    All columns of docs are kept; an appended name that is taken gets underscores before it (`appended`)."""
    _domain, _n, _doc, _taken = (unused(c, docs) for c in ("_domain_", "_n_", "_doc_", "_taken_"))
    keyed = docs.withColumns({_domain: domain(F.col("source")), _n: token_count(F.col("text")), _doc: F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))})
    slim = written(keyed.select(F.col(_domain).alias("domain"), "lang", "source", F.col(_n).alias("n"), F.col(_doc).alias("doc")), "mixing-rows")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    total = (slim.agg(F.sum("n")).first()[0] or 0) * share
    plan = written(budgets(leaves, total, weights, max_epochs), "mixing-plan")
    same = lambda a, b: [a[x].eqNullSafe(b[f"_p_{x}"]) for x in LEVELS]
    to_plan = plan.select(*[F.col(c).alias(f"_p_{c}") for c in LEVELS], "whole", "rest")
    order = lambda doc: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), doc))
    ranged = slim.join(to_plan, same(slim, to_plan)).withColumn("key", order(F.col("doc"))).withColumn("range", F.substring("key", 1, 3))
    sums = ranged.groupBy(*LEVELS, "range").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    leaf = [F.col(c) for c in LEVELS]
    upto = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(*leaf).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    last = upto.filter(F.col("before") < F.col("rest")).groupBy(*LEVELS).agg(F.max_by(F.struct("range", "before"), "range").alias("cut"))
    cut = last.select(*[F.col(c).alias(f"_c_{c}") for c in LEVELS], F.col("cut.range").alias("_range"), F.col("cut.before").alias("_before"))
    inside = ranged.join(cut, [ranged[c].eqNullSafe(cut[f"_c_{c}"]) for c in LEVELS] + [F.col("range") == F.col("_range")])
    inside = inside.groupBy(*LEVELS, "key", "_before", "rest").agg(F.sum("n").alias("n"))
    own = F.coalesce(F.sum("n").over(W.partitionBy(*leaf).orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = inside.withColumn("before", F.col("_before") + own).filter(F.col("before") < F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("cut_key"))
    ends = ends.select(*[F.col(c).alias(f"_e_{c}") for c in LEVELS], "cut_key")
    full = to_plan.join(ends, [to_plan[f"_p_{c}"].eqNullSafe(ends[f"_e_{c}"]) for c in LEVELS], "left")
    cuts = [unused(c, docs) for c in ("_p_domain", "_p_lang", "_p_source", "_whole_", "_cut_key_")]
    full = written(full.select(*[F.col(f"_p_{c}") for c in LEVELS], "whole", "cut_key").toDF(*cuts), "mixing-cuts")
    met = keyed.join(full, [keyed[a].eqNullSafe(full[b]) for a, b in zip((_domain, "lang", "source"), cuts, strict=False)])
    whole, cut_key = F.col(cuts[3]), F.col(cuts[4])
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), whole.cast("string"), F.col(_doc)))
    out = met.withColumn(_taken, whole + F.when(key <= cut_key, 1).otherwise(0)).filter(F.col(_taken) > 0)
    d, n, e = appended(docs)
    return out.select(*docs.columns, F.col(_domain).alias(d), F.col(_n).alias(n), F.explode(F.expr(f"sequence(0, cast(`{_taken}` AS int) - 1)")).alias(e))
