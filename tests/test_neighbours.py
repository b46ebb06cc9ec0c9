"""Exact search against all pairs, on clustered and on equal vectors, and the number of leaves that it reads."""

import numpy as np
from pyspark.sql import functions as F

from loomcount.operators import neighbours as nb


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nb, "LEAF", 20)
    monkeypatch.setattr(nb, "BLOCK", 50)
    monkeypatch.setattr(nb, "QUERIES", 7)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((700, 2)), np.ones((200, 2)), 5 + 0.1 * rng.standard_normal((100, 2))])
    ids = rng.permutation(len(x))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(None, [0.0, 0.0]), (5_000, None), (5_001, [1.0]), (5_002, [float("nan"), 1.0]), (5_003, [None, 1.0])]
    df = spark.createDataFrame(rows, "name int, e array<double>").selectExpr("*", "1 as leaf", "2 as v")
    index = nb.Index(df, "name", F.col("e"))
    queries = df.filter("name % 9 = 0").select(F.col("name").alias("query_id"), F.col("e").alias("v"))
    got = {}
    answers = nb.nearest(index, queries, 6)
    for r in answers.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    near = {}
    for r in nb.within(index, queries, 0.3).collect():
        near.setdefault(r["query_id"], set()).add(r["id"])
    for i, v in zip(ids, x):
        if i % 9:
            continue
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = [(float(a), int(j)) for a, j in sorted(zip(d, ids)) if j != i]
        assert [(g[1], g[2]) for g in sorted(got[i])] == [(j, a) for a, j in order[:6]]
        assert near.get(i, set()) == {j for a, j in order if a <= 0.3}
    read = nb.leaves_read(index, queries, 6, answers).toPandas()
    assert len(index.sizes) == 64 and read["second"].mean() < 10  # of 64 leaves
    assert nb.nearest(index, queries, 2_000).count() == len(got) * 999  # fewer than asked for: all
    assert nb.nearest(nb.Index(df.limit(0), "name", F.col("e")), queries, 3).count() == 0
