"""Line dedup against a direct search for repeated runs."""

import random
import re

from loomcount.llm import line_dedup


def words(s):
    return len(re.findall(r"[^\x20\x09-\x0D]+", s))


def brute(rows, least):
    """Every run of at least `least` words that occurs earlier loses its lines."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    seq = {d: d[1].split("\n") for d in docs}
    first, gone = {}, {d: set() for d in docs}
    for d in docs:
        n = len(seq[d])
        for a in range(n):
            for b in range(a + 1, n + 1):
                run = tuple(seq[d][a:b])
                if sum(map(words, run)) < least:
                    continue
                if run not in first:
                    first[run] = (d, a)
                elif first[run][0] != d or a >= first[run][1] + len(run):  # not over the first one
                    gone[d] |= set(range(a, b))
    return sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])) for i, t in rows), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    for least, n_lines in ((4, 6), (7, 3), (3, 12)):
        pool = [" ".join("w%d" % rng.randint(0, 9) for _ in range(rng.randint(0, 4))) for _ in range(n_lines)]
        passage = [rng.choice(pool) for _ in range(9)]
        rows = []
        for i in range(40):
            t = [rng.choice(pool) if rng.random() < 0.5 else "u%d x" % rng.randint(0, 99999) for _ in range(rng.randint(1, 12))]
            if i % 3 == 0:
                t[1:1] = passage[rng.randint(0, 3) :]
            rows.append((i, "\n".join(t)))
        rows += [(41, rows[0][1]), (42, None), (43, ""), (None, rows[3][1]), (44, rows[5][1]), (44, rows[5][1])]
        rows += [(45, "\n".join(["p q r"] * 9)), (46, "\n".join(["s t u", "v w"] * 7)), (47, "\n".join(["p q r"] * 5))]
        clash = ["gone", "pos", "_id", "_lines", "_gone", "_h", "_text_hash", "_gone_lines"]
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'c' as {c}" for c in clash])
        out = line_dedup.dedup(df, least)
        assert out.columns == ["doc_id", "text", *clash, "__lines", "__gone"]
        # documents that differ in id only are ordered by id; a text hash orders equal ids, of which there are none here
        assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str) == brute(rows, least)
    assert line_dedup.dedup(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "\n".join(["a b c d e"] * 60)), (2, "x " * 200_000)], "doc_id long, text string")
    assert [r["text"] for r in line_dedup.dedup(same).orderBy("doc_id").collect()] == ["\n".join(["a b c d e"] * 10), "x " * 200_000]
