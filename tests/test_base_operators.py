"""Operators on small inputs with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomcount.functions import special as sp
from loomcount.functions.ordered import numbered, running
from loomcount.operators import align, lm, metrics, sketch


def test_running_sums_are_in_order(spark):
    rows = [(k % 37 if k % 11 else None, k, k % 3) for k in range(400)]
    df = spark.createDataFrame(rows, "key int, v int, g int")
    for down in (False, True):
        got = running(df, "key", {"s": F.col("v")}, down, ("v",), ("g",)).collect()
        for g in range(3):
            mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is None, (-r[0] if down else r[0]) if r[0] is not None else 0, r[1]))
            want, s = {}, 0
            for r in mine:
                want[r[1]] = s
                s += r[1]
            assert {r["v"]: r["s"] for r in got if r["g"] == g} == want
    assert sorted(r["n"] for r in numbered(df, "key", "n", then=("v",)).collect()) == list(range(1, 401))
    assert numbered(df.limit(0), "key", "n").count() == 0


def test_special_functions(spark):
    df = spark.createDataFrame([(x,) for x in (0.05, 0.5, 1.0, 3.7, 25.0, 900.0)], "x double")
    for r in df.select("x", sp.lgamma(F.col("x")).alias("g"), sp.digamma(F.col("x")).alias("d")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), abs=1e-9, rel=1e-12)
        h = 1e-5
        assert r["d"] == pytest.approx((math.lgamma(r["x"] + h) - math.lgamma(r["x"] - h)) / (2 * h), rel=1e-5, abs=1e-5)
    one = spark.range(1).select(sp.log_add(F.lit(-1000.0), F.lit(-1000.0)).alias("a"), sp.log_add(F.lit(None).cast("double"), F.lit(-2.0)).alias("b"), sp.ratio(F.lit(0.0), F.lit(0.0)).alias("c"), sp.ratio(F.lit(2.0), F.lit(0.0)).alias("d")).first()
    assert one["a"] == pytest.approx(-1000 + math.log(2)) and one["b"] == -2.0 and (one["c"], one["d"]) == (1.0, 0.0)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2)], "y int, p double")
    g = metrics.tie_groups(df)
    assert metrics.roc_area(g).first()[0] == pytest.approx((2 + 1.5) / 6)  # pairs of a positive above a negative, ties half
    assert metrics.average_precision(g).first()[0] == pytest.approx((1 + (1 / 2) * (2 / 2) + (1 / 2) * (2 / 3) + 3 / 5) / 3)
    assert metrics.last_rank(g).first()[0] == 5
    assert metrics.break_even(g).first()[0] == pytest.approx(2 / 3)
    assert metrics.rates(metrics.confusion(df.limit(0), F.lit(0.5))).count() == 1


def test_count_min_never_below(spark):
    df = spark.createDataFrame([(f"k{i % 50}",) for i in range(1000)], "key string")
    est = sketch.point_estimates(df, "key", sketch.count_min(df, "key", 3, 16), 3, 16).collect()
    assert len(est) == 50 and all(r["estimate"] >= 20 for r in est)


def test_bloomier_rejects_most_unknown_keys(spark):
    known = spark.createDataFrame([(f"k{i}", i % 30 + 1) for i in range(500)], "gram string, cnt long")
    t = sketch.bloomier(known, "gram")
    assert {r["gram"]: r["cnt"] for r in sketch.bloomier_query(known.select("gram"), "gram", t, 30).collect()} == {f"k{i}": i % 30 + 1 for i in range(500)}
    unknown = spark.createDataFrame([(f"u{i}",) for i in range(500)], "gram string")
    assert sketch.bloomier_query(unknown, "gram", t, 30).filter("cnt IS NOT NULL").count() < 10


def test_quantiser_is_never_too_high():
    codes = lm.codes(3, 1000)
    assert codes[:4] == [1, 2, 3, 4] and max(codes) <= 1000


def test_model1_learns_a_pair(spark):
    pairs = spark.createDataFrame([("0", ["das", "haus"], ["the", "house"]), ("1", ["das", "buch"], ["the", "book"]), ("2", ["ein", "buch"], ["a", "book"])], "sid string, s array<string>, t array<string>")
    p = {(r["s"], r["t"]): r["p"] for r in align.model1(align.word_links(pairs, F.col("s"), F.col("t")), 5).collect()}
    assert p["das", "the"] > 0.7 and p["buch", "book"] > 0.7


def test_inversion_grammar():
    lp, links = align.itg_inside(["a", "b"], ["B", "A"], {("a", "A"): 0.9, ("b", "B"): 0.9})
    assert links == [(0, 1), (1, 0)] and lp < 0


def test_packed_numbers_come_back(spark):
    rng = random.Random(7)
    for width in (1, 5, 11, 17, 31):
        rows = [(a, rng.randrange(1 << width), rng.choice((0, -5, rng.getrandbits(62)))) for a in rng.sample(range(300), 120)]
        df = spark.createDataFrame(rows, "address long, value long, finger long")
        cells = sketch.packed(df, width)
        bits = sum(((v ^ f) & ((1 << width) - 1)) << (a * width) for a, v, f in rows)
        assert all(r["bits"] == bits >> (32 * r["cell"]) & 0xFFFFFFFF for r in cells.collect())
        got = sketch.unpacked(df.drop("value"), cells, width).collect()
        assert sorted((r["address"], r["value"], r["finger"]) for r in got) == sorted(rows)
        free = spark.createDataFrame([(5000, 0)], "address long, finger long")
        assert sketch.unpacked(free, cells, width).first()["value"] == 0
    for bad in (32, None):
        with pytest.raises(Exception, match="does not fit"):
            sketch.packed(spark.createDataFrame([(0, bad, 0)], "address long, value long, finger long"), 5).collect()


def test_model1_and_two_way_against_loops(spark):
    import math

    from loomcount.operators import align as al

    pairs = [(1, ["a", "b", "a"], ["x", "y"]), (2, ["a"], ["x"]), (3, ["c"], ["y", "y"])]
    df = spark.createDataFrame(pairs, "sid long, src array<string>, trg array<string>")

    def em(ps, rounds):
        ps = [([al.NULL, *s], t) for s, t in ps]
        p = {(a, b): 1.0 for s, t in ps for a in s for b in t}
        for _ in range(rounds):
            c = dict.fromkeys(p, 0.0)
            for s, t in ps:
                for b in t:
                    z = sum(p[a, b] for a in s)
                    for a in s:
                        c[a, b] += p[a, b] / z
            by = {}
            for (a, _), v in c.items():
                by[a] = by.get(a, 0) + v
            p = {k: v / by[k[0]] for k, v in c.items()}
        return p

    f, b = em([(s, t) for _, s, t in pairs], 2), em([(t, s) for _, s, t in pairs], 2)
    tables = al.model1(al.word_links(df, df["src"], df["trg"]), 2), al.model1(al.word_links(df, df["trg"], df["src"]), 2)
    assert {(r["s"], r["t"]): round(r["p"], 9) for r in tables[0].collect()} == {k: round(v, 9) for k, v in f.items()}
    rules = [*pairs, (4, ["a", "a"], ["y"]), (5, ["new"], ["x"]), (6, [], ["x"]), (7, ["a"], ["unseen"])]
    got = al.two_way(spark.createDataFrame(rules, "rule long, s array<string>, t array<string>"), tables[0], tables[1].selectExpr("t AS s", "s AS t", "p"))
    ln = lambda z: math.log(z) if z > 0 else -math.inf
    want = {}
    for k, s, t in rules:
        one = lambda u, v, p: sum(ln(sum(p.get((x, y), 0) for x in [al.NULL, *u])) for y in v) - len(v) * math.log(len(u) + 1)
        want[k] = one(s, t, f), one(t, s, b)
    for r in got.collect():
        assert all(math.isclose(x, y, abs_tol=1e-9) or x == y for x, y in zip((r["s2t"], r["t2s"]), want[r["rule"]], strict=True)), r
    assert got.count() == len(rules)
