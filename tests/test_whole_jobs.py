"""Queries and operators do the whole job: nothing is left out for being frequent, large or late."""

import numpy as np
import pytest

from loomcount.operators import learn, sketch
from loomcount.plans import QUERIES, lm_queries, model_queries
from loomcount.plans.registry import Tables
from loomcount.sources.tables import written


def test_bloomier_keeps_frequent_words(spark, tmp_path):
    docs = [(1, "the " * 40_000 + "rare", "en", "src0", 160_004), (2, "the rare end", "en", "src1", 12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["gram"]: r["cnt"] for r in QUERIES["bloomier_lookup"](spark, str(tmp_path)).collect()}
    assert got == {"the": 40_001, "rare": 2, "end": 1}


def test_bloomier_reads_large_counts_and_rejects_unknown_keys(spark):
    want = {f"k{i}": 3**i for i in range(25)} | {"most": (1 << sketch.COUNT_BITS) - 1}
    known = spark.createDataFrame(list(want.items()), "gram string, cnt long")
    t = sketch.bloomier(known, "gram")
    most = (1 << sketch.COUNT_BITS) - 1
    assert {r["gram"]: r["cnt"] for r in sketch.bloomier_query(known.select("gram"), "gram", t, most).collect()} == want
    unknown = spark.createDataFrame([(f"u{i}",) for i in range(500)], "gram string")
    assert sketch.bloomier_query(unknown, "gram", t, most).filter("cnt IS NOT NULL").count() == 0


def test_quantised_counts_reach_the_largest_code(spark, monkeypatch):
    counts = spark.createDataFrame([(1, "a", 1), (1, "b", (1 << 24) + 9), (1, "c", 1 << 27), (2, "a b", (1 << 30) - 1), (1, "d", 1 << 30)], "ord long, gram string, cnt long")
    monkeypatch.setattr(lm_queries, "english", lambda t: counts)
    got = {r["cnt"]: r["value"] for r in QUERIES["quantised_counts"](spark, "").collect()}
    assert got == {1: 1, (1 << 24) + 9: 1 << 24, 1 << 27: 1 << 27, (1 << 30) - 1: int(2 ** (89 / 3)), 1 << 30: 1 << 30}


def test_graph_regulariser_reaches_its_fixed_point(spark):
    n = 12
    nodes = [(k, 1.0 if k < 2 else -0.2 * (k % 3), 1 if k == 0 else None) for k in range(n)]
    links = [(a, b, 4 + (a * b) % 5) for a in range(n) for b in range(n) if a != b and (a + b) % 3]
    score = learn.graph_regularised(spark.createDataFrame(nodes, "node long, base double, label int"), spark.createDataFrame(links, "src long, dst long, n long"), 0.2, 1.0, 400, 1e-6, written)
    got = {r["node"]: r["score"] for r in score.collect()}
    base, count = {i: b for i, b, _ in nodes}, {(a, b): k for a, b, k in links}
    a, top = np.zeros((n, n)), np.zeros(n)
    for i, b, label in nodes:
        own = 0 if label is None else 1.0
        a[i, i], top[i] = own + 1.0, own * (label or 0) + b
        for j in range(n):
            if (i, j) in count:
                w = 0.2 * (np.log1p(count[i, j]) + np.log1p(count.get((j, i), 0))) * (0.1 if base[i] < base[j] else 1)
                a[i, i] += w
                a[i, j] -= w
    want = np.linalg.solve(a, top)
    assert max(abs(got[k] - want[k]) for k in range(n)) < 1e-5
    with pytest.raises(ValueError):
        learn.graph_regularised(spark.createDataFrame(nodes, "node long, base double, label int"), spark.createDataFrame(links, "src long, dst long, n long"), 0.2, 1.0, 2, 1e-6, written)


def test_graphs_keep_suppliers_and_parts_apart(spark, tmp_path):
    lines = [(1, 1), (98, 1), (98, 90), (1, 700), (1, 700), (2, 650)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes, edges = model_queries.suppliers(Tables(spark, str(tmp_path)))
    assert {tuple(r) for r in edges.collect()} == {(1, -1, 1), (98, -1, 1), (98, -90, 1), (1, -700, 2), (2, -650, 1)}
    assert {r["node"] for r in nodes.collect()} == {1, 2, 98, -1, -90, -700, -650}
    vectors = spark.createDataFrame([(5,), (10,), (1,), (700,)], "vec_id long")
    assert {tuple(r) for r in model_queries.vector_links(Tables(spark, str(tmp_path)), vectors).collect()} == {(5, 1, 1), (5, 700, 2)}
