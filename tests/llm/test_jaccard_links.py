"""All links of the join against all pairs, also inside groups of different texts."""

import re

from loomcount.llm import jaccard_join

from test_jaccard_join import brute, corpus


def sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)}) if w else frozenset())
    return out


def linked(x, y):
    return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)


def test_all_links(spark, monkeypatch):
    words = [f"w{k}" for k in range(200)]
    group = [(1000 + k, " ".join(words[k : k + 150])) for k in range(40)]  # a chain: near ones link, far ones don't
    for seed, block in ((1, 128), (2, 3)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        rows = corpus(seed, 120) + group
        own = sets(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = sorted(((i, len(own[x]), sum(linked(own[x], own[y]) for y in range(len(rows)) if y != x)) for x, (i, _) in enumerate(rows)), key=str)
        counts = jaccard_join.link_counts(df)
        assert sorted([tuple(r) for r in counts.select("doc_id", "n_shingles", "n_links").collect()], key=str) == want
        assert sorted([tuple(r) for r in counts.select("doc_id", "n_shingles", "component_id").collect()], key=str) == brute(rows)
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("jaccard_texts")]
        pairs, members = jaccard_join.links(df)
        node = {r["doc_id"]: r["node"] for r in members.filter("doc_id < 1000000").collect()}
        of = {node[i]: own[x] for x, (i, _) in enumerate(rows) if i is not None and own[x]}
        some = sorted(of)
        got = [tuple(r) for r in pairs.collect()]
        assert sorted(got) == [(a, b) for k, a in enumerate(some) for b in some[k + 1 :] if linked(of[a], of[b])]
    assert jaccard_join.link_counts(df.limit(0)).count() == 0
