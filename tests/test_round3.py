"""Findings of round 3: what failed before."""

import math
import re

from pyspark.sql import functions as F


def _beta(x, a, b):
    """The series for x, summed until its terms are nothing beside the sum."""
    term, total, k = 1.0, 1.0, 0
    while term > total * 1e-18 or x * (a + b + k) > a + k:
        k += 1
        term *= x * (a + b + k - 1) / (a + k)
        total += term
    return total * math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b))


def test_incomplete_beta_of_large_shapes_near_its_middle(spark):
    """the series stopped before its terms had faded where the largest one isn't the first."""
    from loomcount.functions.special import beta_i

    cases = [(x, a, b) for a, b in ((4985.5, 4945.0), (5021.0, 300.0), (40.0, 9000.0), (60000.0, 60010.0)) for x in (a / (a + b) * c for c in (0.98, 0.998, 1.0005, 1.002, 1.005))]
    got = spark.createDataFrame(cases, "x double, a double, b double").select("x", "a", "b", beta_i(F.col("x"), F.col("a"), F.col("b")).alias("p")).collect()
    assert len(got) == len(cases)
    for r in got:
        assert abs(r.p - _beta(r.x, r.a, r.b)) < 1e-8


def test_ngram_counts_are_neither_sorted_on_disk_nor_shuffled_twice(spark, tmp_path):
    """counts had one task for each large scan and a second shuffle for the sums by gram; functions over array elements made the grams."""
    from loomcount.functions import text as tx
    from loomcount.operators import ngrams as ng

    texts = ["A b, a b!", "", None, "b", "x y z x y z", "a  b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for t in texts:
        w = [y for y in (x.strip(tx.PUNCTUATION) for x in (t or "").lower().split()) if y]
        for n in (1, 2, 3):
            for g in zip(*[w[k:] for k in range(n)]):
                want[n, " ".join(g)] = want.get((n, " ".join(g)), 0) + 1
    got = ng.counts(docs, [1, 2, 3])
    assert {(r.ord, r.gram): r.cnt for r in got.collect()} == want
    again = got.groupBy("gram").agg(F.sum("cnt"))
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_only_asked_grams_are_counted_for_scores(spark):
    """scoring a few texts counted and joined every gram of the corpus."""
    from loomcount.operators import lm
    from loomcount.operators import ngrams as ng

    docs = spark.createDataFrame([(k, f"a b c d w{k} a b w{k} c") for k in range(50)], "doc_id long, text string")
    texts = spark.createDataFrame([(0, "a b c z"), (1, "w7 a b"), (2, "")], "item_id long, text string")
    whole = ng.counts(docs, [1, 2, 3], pad=True)
    part = ng.counts(docs, [1, 2, 3], pad=True, among=lm.asked(texts))
    assert part.filter("ord > 1").count() < 20 < whole.filter("ord > 1").count()
    scores = [sorted(map(tuple, lm.score(texts, ["item_id"], lm.with_prefix(c), lm.totals(c)).collect())) for c in (whole, part, lm.looked_up(whole, texts))]
    assert scores[0] == scores[1] == scores[2] and scores[0]


def test_leaves_of_an_order_are_not_joined_in_one_task(spark):
    """the leaves met the room of their order in a join by order, so in one task for each order."""
    from loomcount.operators import lmstate as st

    state = spark.createDataFrame([(f"a w{k}", 2, 1) for k in range(30)] + [("a", 1, 30)], "gram string, ord long, cnt long").withColumn("hit", F.lit(False))
    batch = spark.createDataFrame([(f"b w{k}", 2, 5) for k in range(4)], "gram string, ord long, cnt long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = st.period(state, batch, 3)
        assert got.count() == 31 and got.filter("hit").count() == 4
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[ord#\d+L\], ", plan)


def test_rules_of_long_pairs_have_a_probability(spark):
    """the base probability of a rule of about 110 words was 0 in doubles, and its logarithm an error."""
    from loomcount.operators import grammar as gr

    pair = tuple(f"s{k}" for k in range(90)), tuple(f"t{k}" for k in range(80))
    room = gr.Room({}, 0, 0, 0.1, 1.0, 2.0, 0.001)
    assert math.isclose(room.log_prob(pair), room.base(pair)) and room.base(pair) < -745
    pairs = spark.createDataFrame([("a", list(pair[0][:40]), list(pair[1][:52])), ("b", ["x"], ["y"])], "sid string, src array<string>, trg array<string>")
    got = gr.sampled(gr.started(pairs).cache(), 0, 1, most=2, shard_of=1).collect()
    assert sorted(r.sid for r in got) == ["a", "b"]
    for r in got:
        s, t = gr.read({x.k: (tuple(x.s), tuple(x.t)) for x in r.rules})
        assert (list(s), list(t)) == {"a": (list(pair[0][:40]), list(pair[1][:52])), "b": (["x"], ["y"])}[r.sid]


def test_links_of_a_pair_stay_where_the_pair_is(spark):
    """links were shuffled to be counted, for the smallest count, and for the sums of the first round."""
    from loomcount.operators import align as al

    pairs = spark.createDataFrame([("1", ["a", "b", "a"], ["x", "y"]), ("2", ["a"], ["x", "x"]), ("3", ["b", "<null>"], ["y"]), ("4", [], ["z"]), ("5", ["c"], [])], "sid string, src array<string>, trg array<string>")
    made = []
    links = al.word_links(pairs, F.col("src"), F.col("trg"))

    def kept(df):
        made.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return spark.createDataFrame(df.collect(), df.schema)

    got = {(r.s, r.t): r.p for r in al.model1(links, 2, kept).collect()}
    assert made[0] == 2  # pairs by sid, partial sums by words
    rows = [(["<null>", *r.src], r.trg) for r in pairs.collect()]
    p = {}
    for _ in range(2):
        c = {}
        for s, t in rows:
            for y in t:
                z = sum(p.get((x, y), 1.0) for x in s)
                for x in s:
                    c[x, y] = c.get((x, y), 0.0) + p.get((x, y), 1.0) / z * (min(s.count(w) for w in s))
        p = {(x, y): v / sum(u for (w, _), u in c.items() if w == x) for (x, y), v in c.items()}
    assert got.keys() == p.keys() and all(abs(got[k] - p[k]) < 1e-12 for k in p)
