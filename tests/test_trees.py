"""Derivations as intervals against a recursive reading of random trees."""

import random

import pytest

from loomcount.operators import trees


def grown(rng, depth=0):
    kids = [grown(rng, depth + 1) if depth < 5 and rng.random() < 0.5 else rng.choice("abc") for _ in range(rng.randint(0 if depth else 1, 4))]
    return (rng.choice(["[]", "<>", "A"]), kids)


def text(t):
    return t if isinstance(t, str) else f"({t[0]} {' '.join(map(text, t[1]))})"


def leaves(t, at=None):
    """Words with their source places, in target order."""
    at = [0] if at is None else at
    if isinstance(t, str):
        at[0] += 1
        return [(at[0] - 1, t)]
    parts = [leaves(k, at) for k in t[1]]
    return [x for p in (reversed(parts) if t[0] == "<>" else parts) for x in p]


def all_yields(t):
    return [] if isinstance(t, str) else [(t[0], [w for _, w in sorted(leaves(t))]), *[x for k in t[1] for x in all_yields(k)]]


def test_random_trees(spark):
    rng = random.Random(5)
    made = [grown(rng) for _ in range(60)]
    df = spark.createDataFrame([(k, text(t)) for k, t in enumerate(made)] + [(98, None), (99, "")], "sid long, tree string")
    links, ns = {}, {}
    for r in trees.alignment(df, "sid", "tree").collect():
        links.setdefault(r["sid"], []).append((r["j"], r["i"], r["word"]))
    for r in trees.nodes(df, "sid", "tree").collect():
        ns.setdefault(r["sid"], []).append((r["enter"], r["label"], r["words"]))
    assert set(ns) == set(range(60))
    for k, t in enumerate(made):
        want = [(j, i, w) for j, (i, w) in enumerate(leaves(t))]
        assert sorted(links.get(k, [])) == want
        assert [x[1:] for x in sorted(ns[k])] == all_yields(t)


def test_subtrees(spark):
    df = spark.createDataFrame([(1, "(A (B x (C y)) z)")], "sid long, tree string")
    ns = trees.nodes(df, "sid", "tree")
    got = trees.below(ns, ns.filter("label = 'B'"), "sid")
    assert sorted(r["label"] for r in got.collect()) == ["B", "C"]


@pytest.mark.parametrize("bad", ["(A x", "A x)", "(A (B x)", "(A () x)", "(A x))"])
def test_bad_brackets(spark, bad):
    with pytest.raises(Exception, match="don't match"):
        trees.nodes(spark.createDataFrame([(1, bad)], "sid long, tree string"), "sid", "tree").collect()


def test_derivations_are_read_where_they_are(spark):
    df = spark.createDataFrame([(1, "(A (B x) y)")], "sid long, tree string")
    for made in (trees.alignment(df, "sid", "tree"), trees.nodes(df, "sid", "tree")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_texts_of_more_than_is_read_at_once(spark):
    n = 250_000
    wide = "(D " + "(<> b c) " * n + ")"
    assert len(wide) > trees.TOGETHER
    df = spark.createDataFrame([(1, wide), (2, "(A x (B))"), (3, None), (4, wide), (5, "(<> u (A v w))")], "sid long, tree string").coalesce(1)
    got = trees.alignment(df, "sid", "tree").toPandas()
    assert got.groupby("sid").size().to_dict() == {1: 2 * n, 2: 1, 4: 2 * n, 5: 3}
    big = got[got["sid"] == 4].sort_values("j")
    assert (big["word"].to_numpy().reshape(n, 2) == ["c", "b"]).all() and (big["i"].to_numpy() == big["j"].to_numpy() + [1, -1] * n).all()
    assert sorted(got[got["sid"] == 5][["j", "i", "word"]].itertuples(index=False, name=None)) == [(0, 1, "v"), (1, 2, "w"), (2, 0, "u")]
    sizes = trees.nodes(df, "sid", "tree").selectExpr("sid", "level", "size(words) AS n").groupBy("sid", "level").agg({"n": "sum"}).collect()
    assert sorted(map(tuple, sizes)) == [(1, 1, 2 * n), (1, 2, 2 * n), (2, 1, 1), (2, 2, 0), (4, 1, 2 * n), (4, 2, 2 * n), (5, 1, 3), (5, 2, 2)]
