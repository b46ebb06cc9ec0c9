"""N-gram counts and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcount.functions import text as tx
from loomcount.functions.ordered import numbered
from loomcount.sources.tables import dealt, spread, written


def grams(words: Column, order: int) -> Column:
    """Space-joined n-grams of one order; none where there are fewer words."""
    n = F.size(words) - order + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, order), " "))).otherwise(F.array().cast("array<string>"))


def exploded(docs: DataFrame, words: Column, orders: list[int], *keep: str) -> DataFrame:
    """keep..., ord, gram: a row for each occurrence."""
    of = _occurrences(docs, words, orders, *keep)
    return of.select(*keep, _order(orders).alias("ord"), "gram")


def _occurrences(docs: DataFrame, words: Column, orders: list[int], *keep: str) -> DataFrame:
    """keep..., gram. A row for each word with the words that follow, then its grams: generators and concatenation are compiled, functions over array elements are not."""
    rest = lambda k: F.slice("_w", F.lit(k + 1), F.greatest(F.size("_w"), F.lit(0)))
    row = dealt(docs).select(*keep, words.alias("_w"))
    row = row.select(*keep, F.inline(F.arrays_zip(F.col("_w").alias("w0"), *[rest(k).alias(f"w{k}") for k in range(1, max(orders))])))
    gram = lambda n: F.concat(*[c for k in range(n) for c in ((F.lit(" "),) if k else ()) + (F.col(f"w{k}"),)])
    return row.select(*keep, F.explode(F.array(*[gram(n) for n in orders])).alias("gram")).filter("gram IS NOT NULL")  # null: fewer words follow


def _order(orders: list[int]) -> Column:
    """The number of a gram's words, which hold no space."""
    if len(orders) == 1:
        return F.lit(orders[0]).cast("bigint")
    return (F.length("gram") - F.length(F.replace(F.col("gram"), F.lit(" "), F.lit(""))) + 1).cast("bigint")


def head(gram: str = "gram", order: str = "ord") -> Column:
    """The gram without its last word; empty for single words."""
    return F.expr(f"substring_index({gram}, ' ', cast({order} - 1 as int))")


def tail(gram: str = "gram", order: str = "ord") -> Column:
    """The gram without its first word; empty for single words."""
    return F.expr(f"substring_index({gram}, ' ', cast(1 - {order} as int))")


def counts(docs: DataFrame, orders: list[int], *by: str, pad: bool = False, among: DataFrame | None = None, **tallies: Column) -> DataFrame:
    """by..., ord, gram, cnt; partial sums are made before the shuffle. among: of longer grams only those in this table (gram); single words are counted all the same.
    tallies: instead of cnt, how many occurrences stand in documents for which each of these conditions holds."""
    words = tx.tokens(F.col("text"))
    docs = docs.withColumns({f"_is_{n}": c for n, c in tallies.items()}) if tallies else docs
    rows = _occurrences(docs, tx.padded(words) if pad else words, orders, *by, *[f"_is_{n}" for n in tallies])
    met = None if among is None else asked(among)
    only = lambda x: x.join(met[0], "gram", "left_outer").filter("_asked OR NOT contains(gram, ' ')")
    rows = only(rows) if met and met[1] else rows
    got = [F.count_if(f"_is_{n}").alias(n) for n in tallies] or [F.count(F.lit(1)).alias("cnt")]
    of = rows.groupBy(*by, "gram").agg(*got)
    of = only(of) if met and not met[1] else of
    return of.select(*by, _order(orders).alias("ord"), "gram", *(list(tallies) or ["cnt"]))


#: A table of asked grams is sent to all tasks up to this many rows (about 200 MB), and joined by a shuffle beyond.
SENT = 1_000_000


def asked(grams_: DataFrame) -> tuple[DataFrame, bool]:
    """(gram, _asked) for a left join: the different grams of a table, and whether they are few, and so marked for broadcast."""
    one = written(grams_.select("gram").distinct().withColumn("_asked", F.lit(True)), "asked")
    few = one.count() <= SENT
    return (F.broadcast(one) if few else one), few


def rolled_up(count_table: DataFrame, *by: str) -> DataFrame:
    """Counts of a coarser key: sums of the finer table."""
    return count_table.groupBy(*by).agg(F.sum("cnt").alias("cnt"))


def top(count_table: DataFrame, n: int, start: int = 0) -> DataFrame:
    return count_table.orderBy(F.desc("cnt"), "gram").offset(start).limit(n)


def corpus_size(unigrams: DataFrame, *by: str) -> DataFrame:
    """Tokens without the sentence start."""
    return unigrams.filter(f"gram <> '{tx.BOS}'").groupBy(*by).agg(F.sum("cnt").alias("size"))


def tf_idf(docs: DataFrame) -> DataFrame:
    """doc_id, term, score = sqrt(tf) * (1 + ln(N / df + 1))."""
    words = dealt(docs, "doc_id").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    tf = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))  # texts are dealt by doc_id, so that words aren't
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return tf.join(df, "term").crossJoin(F.broadcast(n)).select("doc_id", "term", (F.sqrt("tf") * (1 + F.log(F.col("n") / F.col("df") + 1))).alias("score"))  # n is one row


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, id in order of first use: the smallest (doc_id, place). The start ids are those of OOV (0), <s> (1) and </s> (2)."""
    first = spread(docs).select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "word")).groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    ranked = numbered(first.withColumn("doc", F.col("at.doc_id")), "doc", "id", then=("at",))
    return ranked.select("word", (F.col("id") + 2).cast("bigint").alias("id"))


def level_stats(count_table: DataFrame) -> DataFrame:
    """For each order of contexts: contexts with more than 1, 3 and 10 children, the most children, and grams seen once."""
    kids = count_table.filter("ord > 1").withColumn("prefix", head()).groupBy("ord", "prefix").agg(F.count(F.lit(1)).alias("kids"), F.count_if(F.col("cnt") == 1).alias("once"))
    more = lambda n: F.count_if(F.col("kids") > n).alias(f"more_than_{n}")
    return kids.groupBy("ord").agg(more(1), more(3), more(10), F.max("kids").alias("most"), F.sum("once").alias("singletons"))
