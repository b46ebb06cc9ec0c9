"""The join against all pairs."""

import random
import re

from loomcount.llm import jaccard_join


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                up[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    return sorted(((i, len(sets[x]), low.get(root(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n, vocabulary=40):
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(vocabulary)] + ["É", "ß"]
    base = [[rng.choice(vocab) for _ in range(rng.randint(20, 120))] for _ in range(6)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(vocab)
        if rng.random() < 0.2:
            t += passage
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in t)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "A  b"), (n + 5, "b a"), (None, rows[0][1]), (n + 6, rows[1][1]), (n + 6, rows[1][1])]
    return rows


def test_against_all_pairs(spark, monkeypatch):
    for seed, salt, size in ((1, 50_000, 32_768), (2, 1, 7)):
        monkeypatch.setattr(jaccard_join, "SALT_AT", salt)
        monkeypatch.setattr(jaccard_join, "LIST", size)
        rows = corpus(seed, 150)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as comp", "2 as id", "3 as h", "4 as _id")
        got = sorted([tuple(r) for r in jaccard_join.join(df).collect()], key=str)
        assert got == brute(rows)
    assert jaccard_join.join(df.limit(0)).count() == 0
    assert {r["doc_id"] for r in jaccard_join.keep_one(df).collect()} == {c for i, _, c in got if i is not None and i == c} | {None}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 21), (5, 4)] + [(100 + k, 101 + k) for k in range(40)]
    got = dict(tuple(r) for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8, 20: 20, 21: 20} | {100 + k: 100 for k in range(41)}


def template(seed, texts, words, changes):
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    rows = []
    for i in range(texts):
        t = list(base)
        for k in rng.sample(range(words), rng.choice(changes)):
            t[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    return rows


def verified_pairs(monkeypatch):
    seen, real = [], jaccard_join._verified

    def counted(texts, pairs, *more):
        seen.append(pairs.count())
        return real(texts, pairs, *more)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    return seen


def test_near_misses_cost_no_pairs(spark, monkeypatch):
    seen = verified_pairs(monkeypatch)
    got = jaccard_join.join(spark.createDataFrame(template(3, 800, 300, [6]), "doc_id long, text string"))
    assert got.filter("doc_id = component_id").count() == 800 and sum(seen) <= 4 * 800  # of 319,600 pairs
    seen.clear()
    rows = template(4, 200, 300, [4])  # near the threshold: some link
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows) and sum(seen) <= 1_000


def test_answers_from_differences(spark, monkeypatch):
    for seed, group in ((6, 20),):
        monkeypatch.setattr(jaccard_join, "GROUP", group)
        rows = template(seed, 130, 100, [2, 3]) + [(1_000 + i, t.replace("b", "c")) for i, t in template(seed + 9, 60, 100, [1, 2, 3])]
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as root", "1 as diff", "2 as good")
        assert sorted([tuple(r) for r in jaccard_join.join(df).collect()], key=str) == brute(rows)
