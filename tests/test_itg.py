"""The inversion grammar against all derivations, numeric derivatives and the laws of EM."""

import math
import random

from loomcount.operators import align

RULES, NULL = align.ITG_RULES, align.NULL


def derivations(s, t, table):
    """(probability, links) of every derivation, by recursion over splits."""

    def of(i, j, u, v):
        if j - i <= 1 and v - u <= 1:
            pair = (s[i] if j > i else NULL, t[u] if v > u else NULL)
            yield RULES["word"] * table.get(pair, 0.0), ([(i, u)] if j > i and v > u else [])
        for k in range(i, j + 1):
            for m in range(u, v + 1):
                for name, x, y in (("straight", (i, k, u, m), (k, j, m, v)), ("inverted", (i, k, m, v), (k, j, u, m))):
                    if any(q[0] == q[1] and q[2] == q[3] for q in (x, y)):
                        continue
                    for p, a in of(*x):
                        for r, b in of(*y):
                            yield RULES[name] * p * r, a + b

    return list(of(0, len(s), 0, len(t)))


def pairs_of(s, t):
    return {(a, b) for a in [*s, NULL] for b in [*t, NULL]} - {(NULL, NULL)}


def test_inside_and_best_links_are_those_of_all_derivations():
    rng = random.Random(1)
    for s, t in (("a", "x"), ("ab", "x"), ("ab", "xy"), ("aab", "x"), ("ab", "xyx"), ("aba", "xx")):
        table = {pair: rng.random() for pair in pairs_of(s, t)}
        every = derivations(s, t, table)
        lp, links = align.itg_inside(list(s), list(t), table)
        assert math.isclose(lp, math.log(sum(p for p, _ in every)), rel_tol=1e-9)
        best = max(p for p, _ in every)
        assert links in [sorted(x) for p, x in every if p > best * (1 - 1e-9)]


def test_expected_counts_are_derivatives():
    rng = random.Random(2)
    for s, t in (("abc", "xyz"), ("abab", "xyy"), ("abcde", "vwxyz")):
        table = {pair: rng.random() for pair in pairs_of(s, t)}
        _, counts = align.itg_expected(list(s), list(t), table)
        for pair in table:
            up, down = ({**table, pair: table[pair] * f} for f in (1 + 1e-5, 1 - 1e-5))
            slope = (align.itg_expected(list(s), list(t), up)[0] - align.itg_expected(list(s), list(t), down)[0]) / 2e-5
            assert math.isclose(counts.get(pair, 0.0), slope, abs_tol=1e-6)
        # each word is linked once
        assert math.isclose(sum(c for p, c in counts.items() if p[0] != NULL), len(s), rel_tol=1e-9)
        assert math.isclose(sum(c for p, c in counts.items() if p[1] != NULL), len(t), rel_tol=1e-9)


def test_training(spark):
    rng = random.Random(3)
    lexicon = dict(zip("abcdef", "uvwxyz", strict=True))
    data = []
    for _ in range(60):
        s = [rng.choice("abcdef") for _ in range(rng.randint(1, 5))]
        t = [lexicon[w] for w in s]
        data.append((s, t[::-1] if rng.random() < 0.3 else t))
    data += [data[0], data[0], ([], ["u"]), (None, ["u"]), (["a"] * 10, ["u"])]
    df = spark.createDataFrame([(k, *x, "c") for k, x in enumerate(data)], "sid long, src array<string>, trg array<string>, times string")
    probs, trace = align.itg_train(df, 5)
    assert all(a <= b + 1e-9 for a, b in zip(trace, trace[1:], strict=False)) and trace[-1] > trace[0] + 10
    got = {(r["s"], r["t"]): r["p"] for r in probs.collect()}
    assert math.isclose(sum(got.values()), 1.0, rel_tol=1e-9)
    # the same rounds in one place
    want = {(s, t): 0.0 for x, y in data if x and y and len(x) < 10 for s, t in pairs_of(x, y)}
    want = dict.fromkeys(want, 1.0 / len(want))
    for _ in range(5):
        total = {}
        for s, t in data:
            if s and t and len(s) < 10:
                for pair, c in align.itg_expected(s, t, want, 0.0)[1].items():
                    total[pair] = total.get(pair, 0.0) + c
        want = {pair: c / sum(total.values()) for pair, c in total.items() if c > 0}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-12) for k in got)
    for w, x in lexicon.items():
        assert max((p, t) for (s, t), p in got.items() if s == w)[1] == x
    links = {r["sid"]: (r["lp"], r["links"]) for r in align.itg_alignments(df, probs).collect()}
    assert len(links) == len(data) and all(links[k] == (None, None) for k in range(62, 65)) and links[0] == links[60]
    assert align.itg_train(df.limit(0), 2)[0].count() == 0
    assert align.itg_alignments(df, probs.limit(0)).count() == len(data)


def test_counts_of_a_batch_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shapes = sorted((rng.choice((3, 6)), rng.choice((3, 6))) for _ in range(8000))
    part = lambda n, m: [{"at": k, "p": 0.001} for k in range((n + 1) * (m + 1) - 1)]
    schema = pa.schema([("src", pa.list_(pa.string())), ("trg", pa.list_(pa.string())), ("times", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("part", pa.list_(pa.struct([("at", pa.int32()), ("p", pa.float64())])))])
    batch = pa.RecordBatch.from_pylist([{"src": words(n), "trg": words(m), "times": 1, "n": n, "m": m, "part": part(n, m)} for n, m in shapes], schema)
    align._itg_splits(6, 6)
    tracemalloc.start()
    got = align.itg_counts(batch, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 250,000 places of word pairs: dictionaries of them took some hundred bytes for each
    assert peak < 60e6
    c = dict(zip(zip(got["s"].to_pylist(), got["t"].to_pylist(), strict=True), got["c"].to_pylist(), strict=True))
    c.pop((None, None))
    assert math.isclose(sum(x for (s, _), x in c.items() if s != NULL), sum(n for n, _ in shapes), rel_tol=1e-9)


def test_the_word_null_is_the_null_word(spark):
    data = [(0, ["a", NULL], ["u"]), (1, ["a"], ["u", NULL]), (2, [NULL], [NULL]), (3, ["a"], ["u"])]
    probs, _ = align.itg_train(spark.createDataFrame(data, "sid long, src array<string>, trg array<string>"), 1)
    got = {(r["s"], r["t"]): r["p"] for r in probs.collect()}
    start = dict.fromkeys(set().union(*(pairs_of(s, t) for _, s, t in data)), 0.25)
    assert got.keys() <= start.keys() == {("a", "u"), ("a", NULL), (NULL, "u")} and math.isclose(sum(got.values()), 1.0)
    start = dict.fromkeys(start, 1 / len(start))
    total = {}
    for _, s, t in data:
        for pair, c in align.itg_expected(s, t, start, 0.0)[1].items():
            total[pair] = total.get(pair, 0.0) + c
    assert all(math.isclose(got[k], total[k] / sum(total.values()), rel_tol=1e-9) for k in got)


def test_long_pairs_are_aligned_together(spark):
    """One pair of nine words a side took 0.27 s when it had a chart of its own."""
    import time

    rng = random.Random(5)
    words = lambda signs: [rng.choice(signs) for _ in range(9)]
    df = spark.createDataFrame([(k, words("abcdefgh"), words("stuvwxyz")) for k in range(2000)], "sid long, src array<string>, trg array<string>")
    probs = spark.createDataFrame([(s, t, rng.random()) for s in [*"abcdefgh", NULL] for t in [*"stuvwxyz", NULL] if (s, t) != (NULL, NULL)], "s string, t string, p double")
    start = time.monotonic()
    got = {r["sid"]: (r["lp"], r["links"]) for r in align.itg_alignments(df, probs).collect()}
    assert time.monotonic() - start < 60
    assert len(got) == 2000
    table = {(r["s"], r["t"]): r["p"] for r in probs.collect()}
    for r in df.limit(5).collect():
        lp, links = align.itg_inside(r["src"], r["trg"], table)
        assert math.isclose(got[r["sid"]][0], lp, rel_tol=1e-9) and got[r["sid"]][1] == " ".join(f"{i}-{j}" for i, j in links)


def test_words_with_the_same_number_are_numbered_anew(spark, monkeypatch):
    data = [(0, ["a", "b"], ["u"]), (1, ["b"], ["v"]), (2, ["a"], ["u"]), (3, ["a"] * 10, ["u"])]
    df = spark.createDataFrame(data, "sid long, src array<string>, trg array<string>")
    want = {(r["s"], r["t"]): r["p"] for r in align.itg_train(df, 2)[0].collect()}
    of = align._itg_id
    monkeypatch.setattr(align, "_itg_id", lambda word, seed: of(word, seed) % 2 if seed < 2 else of(word, seed))
    probs = align.itg_train(df, 2)[0]
    got = {(r["s"], r["t"]): r["p"] for r in probs.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)
    links = {r["sid"]: (r["lp"], r["links"]) for r in align.itg_alignments(df, probs).collect()}
    both = {r["sid"]: (r["lp"], r["links"]) for r in align.itg_trained_alignments(df, 2).collect()}
    assert links.keys() == both.keys() == {0, 1, 2, 3} and links[3] == both[3] == (None, None)
    assert all(math.isclose(links[k][0], both[k][0], rel_tol=1e-9) and links[k][1] == both[k][1] for k in range(3))


def test_splits_of_one_side_are_tried_once_and_the_first_round_needs_one_chart(monkeypatch):
    """An inverted split with a child of one side is the straight one again; pairs of the same lengths have the same counts in the first round."""
    import pyarrow as pa

    assert all(all(x) and all(y) for _, splits in align._itg_splits(4, 3) for name, x, _, y, _ in splits if name == "inverted")
    made = []
    of = align.itg_expected_of
    monkeypatch.setattr(align, "itg_expected_of", lambda words: made.append(words.shape[2]) or of(words))
    rows = [{"src": ["a", f"b{k}"], "trg": [f"x{k}", "y"], "times": 1, "n": 2, "m": 2, "part": None} for k in range(50)]
    part = pa.list_(pa.struct([("at", pa.int32()), ("p", pa.float64())]))
    schema = pa.schema([("src", pa.list_(pa.string())), ("trg", pa.list_(pa.string())), ("times", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("part", part)])
    align._itg_uniform.cache_clear()
    got = align.itg_counts(pa.RecordBatch.from_pylist(rows, schema), 0.01)
    assert made == [1]
    c = dict(zip(zip(got["s"].to_pylist(), got["t"].to_pylist(), strict=True), got["c"].to_pylist(), strict=True))
    want = align.itg_expected(["a", "b0"], ["x0", "y"], {}, 0.01)[1]
    assert math.isclose(c["b0", "x0"], want["b0", "x0"], rel_tol=1e-9) and math.isclose(c["a", "y"], 50 * want["a", "y"], rel_tol=1e-9)
