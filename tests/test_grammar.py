"""Laws of the derivation samplers."""

import math

import numpy as np
import pytest

from loomcount.operators import grammar as g
from loomcount.sources.tables import written

P = g.NONTERMINAL


def test_parts_of_rules():
    rule = (("a", "b", "c"), ("x", "y"))
    cut = g.split(rule, 1, 3, 0, 1, f"{P}7")
    assert cut == (("a", f"{P}7"), (f"{P}7", "y")) and g.arity(cut[0]) == 1
    assert g.combined(cut, f"{P}7", (("b", "c"), ("x",))) == rule
    assert g.name(cut) == g.name((("a", f"{P}3"), (f"{P}3", "y"))) != g.name(rule)
    assert g.is_part(("b",), ("x",), rule) and not g.is_part(*rule, rule) and not g.is_part((f"{P}7",), ("y",), cut)
    assert g.is_insertion((f"{P}1",), ("x", f"{P}1")) and not g.is_insertion((f"{P}1",), (f"{P}1",)) and not g.is_insertion(("a",), ("x",))


def test_derivations_from_links():
    s, t = ("a", "b", "c", "d"), ("x", "y", "z")
    got = g.from_links(s, t, [(0, 2), (1, 0), (2, 1), (1, 1)])
    assert got == {0: ((f"{P}1", f"{P}2", "d"), (f"{P}2", f"{P}1")), 1: (("a",), ("z",)), 2: (("b", "c"), ("x", "y"))}
    assert g.read(got) == (s, t) and g.from_links(s, t, []) == {0: (s, t)}


@pytest.mark.parametrize("every", [False, True])
def test_rounds_of_one_room(every):
    """Each walk keeps the sentence pairs, and the room's counts are those of the derivations."""
    rng = np.random.default_rng(3)
    pairs = [(tuple(rng.choice(list("abcd"), n)), tuple(rng.choice(list("wxyz"), m))) for n, m in rng.integers(1, 6, (12, 2))]
    trees, room = [{0: p} for p in pairs], g.Room({}, 0, 0, 0.1, 1.0, 2.0, 0.01)
    for x in trees:
        room.add(x[0])
    for _ in range(4):
        for x, p in zip(trees, pairs, strict=True):
            g.walk(x, room, rng, every=every)
            assert g.read(x) == p and all(sorted(g.places(s)) == sorted(g.places(t)) for s, t in x.values())
        want = {}
        for x in trees:
            for r in x.values():
                want[g.name(r)] = want.get(g.name(r), 0) + 1
        assert {k: n for k, n in room.own.items() if n} == want
        assert (room.total, room.types) == (sum(want.values()), len(want))
    assert sum(map(len, trees)) > len(trees)


def test_one_decision_is_drawn_with_its_weight():
    """A pair of two words and one: the only children are (a, x) and (b, x); shares of the first decision against the exact ones."""
    rng, got = np.random.default_rng(5), 0
    for _ in range(3000):
        room, tree = g.Room({}, 0, 0, 0.1, 1.0, 2.0, 0.5), {0: (("a", "b"), ("x",))}
        room.add(tree[0])
        g.walk(tree, room, rng, every=True)
        got += len(tree) == 1
    room = g.Room({}, 0, 0, 0.1, 1.0, 2.0, 0.5)
    stay, part = math.exp(room.log_prob((("a", "b"), ("x",)))), math.exp(room.log_prob(((f"{P}1", "b"), (f"{P}1",)), (("a",), ("x",))))
    assert abs(got / 3000 - (stay / (stay + part)) ** 2) < 0.04


def test_rounds_on_tables(spark):
    rows = [(f"{i}", ["the", n, v], [w, m]) for i, (n, m, v, w) in enumerate([("cat", "neko", "runs", "hashiru"), ("dog", "inu", "runs", "hashiru"), ("cat", "neko", "sleeps", "nemuru"), ("dog", "inu", "sleeps", "nemuru")] * 10)]
    df = spark.createDataFrame([*rows, ("e", [], ["x"]), ("n", None, ["x"])], "sid string, src array<string>, trg array<string>")
    first = written(g.started(df))
    assert first.count() == 40 and g.sampled(first.limit(0), 0, 1).count() == 0
    state, again = first, first
    for k in range(3):
        state = written(g.sampled(state, k, 1, every=k == 2, shard_of=16))
    for k in range(3):
        again = written(g.sampled(again, k, 1, every=k == 2, shard_of=16))
    got = {r["sid"]: {x["k"]: (tuple(x["s"]), tuple(x["t"])) for x in r["rules"]} for r in state.collect()}
    assert got == {r["sid"]: {x["k"]: (tuple(x["s"]), tuple(x["t"])) for x in r["rules"]} for r in again.collect()}
    assert {k: g.read(v) for k, v in got.items()} == {i: (tuple(s), tuple(t)) for i, s, t in rows}
    assert g.rule_counts(state).groupBy().sum("n").first()[0] == sum(map(len, got.values())) >= 40
    linked = spark.createDataFrame([("1", ["a", "b"], ["x", "y"], [(0, 1), (1, 0)])], "sid string, src array<string>, trg array<string>, links array<struct<i:int,u:int>>")
    assert len(g.started(linked, True).first()["rules"]) == 3
