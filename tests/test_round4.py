"""Findings of round 4."""

import numpy as np
from pyspark.sql import functions as F

from loomcount.operators import align as al
from loomcount.operators import grammar as g
from loomcount.operators import model1 as m1
from loomcount.sources.tables import written

P = g.NONTERMINAL


def test_shards_are_walked_in_many_tasks(spark):
    """The rows of a round are few bytes, which were put into one task."""
    df = spark.createDataFrame([(f"{i}", ["a", f"b{i % 7}"], ["x", f"y{i % 5}"]) for i in range(256)], "sid string, src array<string>, trg array<string>")
    got = g.sampled(written(g.started(df)), 0, 1, shard_of=8).select(F.spark_partition_id().alias("task"), "sid").collect()
    assert len(got) == 256 and len({r["task"] for r in got}) >= 4


def test_weights_of_splits_are_those_of_their_rules():
    """Weights by lengths and by names made of joined parts equal those of the rules that are made, with counted and uncounted rules and places on both sides."""
    rng = np.random.default_rng(7)
    for n in range(60):
        room = g.Room({}, 3, 2, 0.1, 1.0, 2.0, 0.01)
        s = [str(x) for x in rng.choice(list("abc"), rng.integers(1, 6))]
        t = [str(x) for x in rng.choice(list("xyz"), rng.integers(1, 6))]
        for k in range(n % 3):
            s.insert(int(rng.integers(0, len(s) + 1)), f"{P}{k + 3}")
            t.insert(int(rng.integers(0, len(t) + 1)), f"{P}{k + 3}")
        rule = tuple(s), tuple(t)
        cuts = [(i, j, u, v) for i in range(len(s)) for j in range(i + 1, len(s) + 1) for u in range(len(t)) for v in range(u + 1, min(len(t), u + 3) + 1)]
        right = [c for c in cuts if g.is_part(rule[0][c[0] : c[1]], rule[1][c[2] : c[3]], rule)]
        for c in [right[i] for i in rng.permutation(len(right))[: len(right) // 2]]:
            for x in (g.split(rule, *c, f"{P}9"), (rule[0][c[0] : c[1]], rule[1][c[2] : c[3]])):
                room.add(x, int(rng.integers(1, 4)))
        for i, j in {c[:2] for c in cuts}:
            spans = g._parts(rule, i, j, 3)
            assert sorted(spans) == sorted(c[2:] for c in right if c[:2] == (i, j))
            weight = g._Splits(rule, i, j, room)
            for u, v in spans:
                assert weight(u, v)[1] == room.log_prob(g.split(rule, i, j, u, v, f"{P}9"), (rule[0][i:j], rule[1][u:v]))


def _texts_of_odd_words(spark):
    rows = [("a b a", "x y x"), ("b", "y"), ("", "x z"), ("c <null>", "z <null> z"), ("a c", ""), ("a b a", "x y x"), ("d d <null>", "x")]
    return spark.createDataFrame([(f"{k}", s.split(), t.split()) for k, (s, t) in enumerate(rows)], "sid string, src array<string>, trg array<string>")


def test_model1_by_target_word(spark):
    """Without rows for links: the table is that of the links, for each number of rounds, and no link is moved."""
    df = _texts_of_odd_words(spark)
    for rounds in (1, 2, 3):
        want = {(r.s, r.t): r.p for r in al.model1(al.word_links(df, F.col("src"), F.col("trg")), rounds).collect()}
        table = m1.Model1(written(m1.texts(df, F.col("src"), F.col("trg"))), rounds).table()
        got = {(r.s, r.t): r.p for r in table.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    once = df.groupBy("src", "trg").agg(F.count(F.lit(1)).alias("n"))
    model = m1.Model1(written(m1.texts(once, F.col("src"), F.col("trg"), times=F.col("n"))), 3)
    assert {(r.s, r.t): round(r.p, 10) for r in model.table().collect()} == {k: round(p, 10) for k, p in want.items()} and model.vocabulary == 4


def test_pieces_of_frequent_target_words(monkeypatch):
    """A task that takes a few links at a time gives what it gives with all at once."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    line = lambda words, n: " ".join(rng.choice(list(words), n))
    rows = [("", f"{k}", f"<null> {line('abcd', 4)}", line("xyyyy", 5), 1, None) for k in range(40)]
    rows += [("", "", w, None, 1, float(c)) for w, c in zip(["<null>", *"abcd"], rng.random(5) + 1, strict=True)] + [("", "", w, None, 2, 2.0) for w in ["<null>", *"abcd"]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*rows, strict=True))[1:], (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)], ["id", "src", "trg", "times", "c"])
    for give in ("table", "scores", "sums"):
        got = []
        for most in (1 << 20, 7):
            monkeypatch.setattr(m1, "AT_ONCE", most)
            got.append(sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r.values()) for r in pa.Table.from_batches(list(m1._rounds(2, give)([batch]))).to_pylist()))
        assert got[0] == got[1] and got[0]


def test_model1_query_moves_texts_not_links(spark):
    """Its links were sorted for windows and joined with the table, which was written."""
    import __spark_entry__

    plan = __spark_entry__.queries()["model1_em2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(s" not in plan and "SortMergeJoin" not in plan and "Window" not in plan and "MapInArrow" in plan


def test_two_way_query_moves_texts_not_links(spark):
    """Its rules met the tables of both models in a join of all their word pairs."""
    import __spark_entry__

    plan = __spark_entry__.queries()["rule_base_two_way"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 4 and "Window" not in plan and "FullOuter" not in plan


def test_word_pairs_are_counted_where_their_target_word_is(spark):
    """Counts of pairs of words were summed by a shuffle of nearly all of them. Words may be empty."""
    import __spark_entry__

    rows = [("a b  a", "x y"), ("", "x "), ("b", "x"), ("a\nb", "")]
    got = {(r.s, r.t): r.n for r in m1.word_pairs(spark.createDataFrame(rows, "src string, trg string")).collect()}
    want = {}
    for s, t in rows:
        for x in s.split(" "):
            for y in t.split(" "):
                want[x, y] = want.get((x, y), 0) + 1
    assert got == want and m1.word_pairs(spark.createDataFrame(rows, "src string, trg string").limit(0)).count() == 0
    plan = __spark_entry__.queries()["word_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan
