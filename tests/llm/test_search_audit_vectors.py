"""Lexical search, filter audit and vector near-duplicates against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from loomcount.llm import filter_audit, lexical, pivot_dedup

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def ranked(docs, items, k):
    bags = [Counter(re.findall(TERM, fold(t))) for _, t in docs]
    n, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        q, scored = Counter(re.findall(TERM, fold(text))), []
        for (i, _), bag in zip(docs, bags):
            m = 25 + (75 * sum(bag.values()) * n) // total if total else 0
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, times in q.items() if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def test_lexical_search(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(30)] + ["É", "ß2", "日本", "A", "a_b", "x-y"]
    docs = [(i, " ".join(rng.choice(vocab).upper() if rng.random() < 0.1 else rng.choice(vocab[: rng.choice([3, 36])]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + k, docs[5][1]) for k in range(40)] + [(None, docs[5][1]), (7, docs[5][1]), (7, docs[5][1]), (900, None), (901, ""), (902, " _-"), (903, "w1 " * 50_000)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12)))) for k in range(25)] + [(30, docs[5][1]), (30, "w1 w1 w1 w2"), (None, "w3"), (31, None), (32, ""), (33, "unknown"), (34, "--")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as score").repartition(5)
    q = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 as doc_id", "'x' as rank")
    for most, k, chunk in ((500_000, 10, 1 << 22), (40, 3, 200)):
        monkeypatch.setattr(lexical, "ITEM_TERMS", most)
        monkeypatch.setattr(lexical.rn, "CHUNK", chunk)
        got = lexical.search(d, q, k)
        assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
        assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, k)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0
    assert lexical.search(d.filter("doc_id in (900, 901)"), q).count() == 0


def audited(docs, labels):
    low = {}
    for i, _, t in docs:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, lang, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > low[t]]
        rows.append((lang or "", {f for f, x in zip("ABCDE", fails) if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                gone = [bool(r[1] & set(order[:s])) for r in own]
                removed = [r for r, g in zip(own, gone) if f in r[1] and not g]
                out[part, "".join(order), s + 1] = [
                    sum(not r[1] & set(order[: s + 1]) for r in own), len(removed), sum(f in r[1] and g for r, g in zip(own, gone)), sum(r[1] == {f} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)
                ]
                shapley[part, f] += len(removed)
    return sorted((*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def test_filter_audit(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(400)] + ["É", "Ab", "XYZ", "a|b", "1%"]
    docs = []
    for i in range(200):
        some = vocab[: rng.choice([10, 400, 405])]
        docs.append((i, rng.choice(["de", "en", "", None]), rng.choice([" ", "\n\t "]).join(rng.choice(some) for _ in range(rng.choice([5, 199, 200, 300])))))
    docs += [(300 + k, "en", docs[7][2]) for k in range(20)] + [(7, "en", docs[7][2]), (7, "de", docs[7][2]), (7, "de", docs[7][2]), (None, "en", docs[7][2]), (None, "de", "x"), (400, "de", None), (401, "fr", ""), (402, "de", "A b c " * 60_000), (3, "de", "other text of id 3")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string").selectExpr("*", "1 as mask", "'x' as part", "2 as n", "3 as digest", "4 as quality").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as part", "1 as good")
    got = filter_audit.audit(d, lab)
    assert sorted(map(tuple, got.collect())) == audited(docs, labels)
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(d, lab.limit(0)).collect()} == {0}


def grouped(vectors, cosine=0.9):
    good = [i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in vectors]
    up, n = list(range(len(vectors))), [0] * len(vectors)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    unit = [np.array(v, float) / np.linalg.norm(v) if g else None for (_, v), g in zip(vectors, good)]
    for x in range(len(vectors)):
        for y in range(x):
            if good[x] and good[y] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= cosine:
                n[x], n[y] = n[x] + 1, n[y] + 1
                up[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(vectors):
        if i is not None:
            low[root(x)] = min(low.get(root(x), i), i)
    return sorted(((i, n[x], low.get(root(x)), i is None or i == low[root(x)]) for x, (i, _) in enumerate(vectors)), key=str)


def planted(seed, dims, single=300, pairs=60, tight=120, loose=80):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)

    def turned(x, cosine):
        z = rng.standard_normal(x.shape)
        z = unit(z - (z * x).sum(-1, keepdims=True) * x)
        return cosine * x + np.sqrt(1 - cosine**2) * z

    base = unit(rng.standard_normal((single, dims)))
    near = [turned(base[k], c) for k, c in zip(range(pairs), np.linspace(0.85, 0.999, pairs)) if abs(c - 0.9) > 1e-6]
    one, two = unit(rng.standard_normal((2, dims)))
    close = [turned(one, c) for c in rng.uniform(0.98, 1, tight)]  # all within a core
    wide = [turned(two, c) for c in rng.uniform(0.93, 0.97, loose)]  # some of them link with each other
    return [*base, *near, *close, *wide]


def test_vector_near_duplicates(spark, monkeypatch):
    for seed, dims, size in ((2, 64, 30), (3, 3, 40), (4, 1, 1_024)):
        monkeypatch.setattr(pivot_dedup, "LIST", size)
        few = {} if dims > 3 else {"single": 90, "pairs": 20, "tight": 30, "loose": 20}
        rows = [(5 * k % 997, (v * (1 + k % 3)).tolist()) for k, v in enumerate(planted(seed, dims, **few))]
        rows += [(2000 + k, rows[3][1]) for k in range(15)] + [(2000, rows[3][1]), (2000, rows[4][1]), (None, rows[3][1]), (None, None), (3000, None), (3001, []), (3002, [0.0] * dims), (3003, [float("nan")] * dims)]
        rows += [(3004, [float("inf")] + [1.0] * (dims - 1)), (3005, [None] + [1.0] * (dims - 1)), (3006, [1.0] * (dims + 1)), (3007, [2.0] * (dims + 1)), (3008, [-x for x in rows[3][1]])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "'x' as key", "2 as v", "3 as label", "4 as id").repartition(5)
        got = pivot_dedup.join(df)
        assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
        assert sorted(map(tuple, got.collect()), key=str) == grouped(rows)
    assert pivot_dedup.join(df.limit(0)).count() == 0
    assert pivot_dedup.join(df.filter("vec_id = 3000")).collect()[0][1:] == (0, 3000, True)
    kept = pivot_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.filter("vec_id between 2001 and 2014").count() == 0


def test_tight_groups_are_not_compared(spark):
    rng = np.random.default_rng(6)
    one = rng.standard_normal(64)
    rows = [(k, (one + 0.1 * rng.standard_normal(64)).tolist()) for k in range(3_000)] + [(5_000 + k, rng.standard_normal(64).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    made = []
    real = pivot_dedup._lists
    pivot_dedup._lists = lambda nodes: (made.append(real(nodes).agg(F.sum((~F.col("core")).cast("int"))).first()[0]), real(nodes))[1]
    try:
        got = {r["vec_id"]: r["n_links"] for r in pivot_dedup.join(df).collect()}
    finally:
        pivot_dedup._lists = real
    assert all(got[k] == 2_999 for k in range(3_000)) and got[5_000] == 0
    assert made[0] <= 300 * pivot_dedup.PREFIX  # the group's members are in no list as rims


def test_pivots_are_apart():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 32))
    x[:300] = x[0] + 0.05 * x[:300]
    x /= np.linalg.norm(x, axis=1)[:, None]
    p = pivot_dedup.choose_pivots(x, 150)
    near = p @ p.T - 2 * np.eye(len(p))
    assert len(p) == 150 and near.max() < 0.6
    assert len(pivot_dedup.choose_pivots(x[:300], 20)) == 20
