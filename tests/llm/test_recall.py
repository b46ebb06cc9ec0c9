"""Recall of the nearest-neighbour search on a given table, against brute force."""

from pathlib import Path

import numpy as np
import pytest
from loomcount.llm import ann
from pyspark.sql import functions as F

TABLE = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.mark.skipif(not Path(TABLE).exists(), reason="the driver's tables are absent")
def test_recall(spark):
    table = spark.read.parquet(TABLE)
    rows = ann.usable(table).collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    got = {}
    for r in ann.search(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        near = [k for k in np.lexsort((ids, d)) if ids[k] != ids[q]][:10]
        hits += len({int(ids[k]) for k in near} & set(got[int(ids[q])]))
        assert all(abs(d[np.flatnonzero(ids == i)[0]] - s) < 1e-12 for i, s in got[int(ids[q])].items())
    assert hits >= 0.9 * 10 * len(got) and len(got) == int((ids % 100 == 0).sum())


@pytest.mark.skipif(not Path(TABLE).exists(), reason="the driver's tables are absent")
def test_candidates_are_abandoned(spark):
    """The rounds of the search over whole lists: a half of the dimensions of all vectors is not read."""
    rows = ann.usable(spark.read.parquet(TABLE)).withColumn("uid", F.col("vec_id"))
    got = rows.toPandas()
    ids, x = got["vec_id"].to_numpy(), np.stack(got["v"].to_numpy())
    centre = ann.fit(rows, round(len(x) ** 0.5))
    turned = x @ ann.rotation(x.shape[1])
    own = ann.nearest(turned, centre, 1)[:, 0]
    sizes, read, hits, asked = np.bincount(own, minlength=len(centre)), 0, 0, np.flatnonzero(ids % 100 == 0)
    for q in asked:
        order = ann.nearest(turned[q : q + 1], centre, len(centre))[0]
        best, start = [], 0
        for stop in ann.lists_of(order, sizes, 10):
            bound = sorted(best)[9][0] if len(best) >= 10 else np.inf
            for c in order[start:stop]:
                some = np.flatnonzero(own == c)
                _, found, d, n = next(ann.scan_block((ids[some], turned[some], x[some]), (ids[q : q + 1], turned[q : q + 1], x[q : q + 1], [bound]), 10))
                read, best = read + n, best + list(zip(d.tolist(), found.tolist()))
            start = stop
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({i for _, i in sorted(best)[:10]} & set(ids[np.argsort(d)[:10]].tolist()))
    assert read < 0.5 * len(asked) * x.size
    assert hits >= 0.9 * 10 * len(asked)
