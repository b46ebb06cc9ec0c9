"""Each stage of the pipeline against a direct version of it, on small documents with nulls, copies, long texts and clashing columns."""

import random
import re

import corpus_pipeline
import pytest
from loomcount.llm import mixing, quality

from test_jaccard_join import brute as groups
from test_line_dedup import brute as without_runs

CLASH = ["_id", "_gone", "_log_weight", "domain", "n_tokens", "epoch", "node"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(5)
    vocab = ["w%d" % k for k in range(300)]
    good = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 90))) + "." for _ in range(60)]
    passage = "\n".join(" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(4))
    rows = []
    for i in range(240):
        t = rng.choice(good) if rng.random() < 0.4 else " ".join(rng.choice(vocab) for _ in range(rng.randint(20, 80)))
        if i % 5 == 0:
            t = " ".join(w.upper() + "!!$$" for w in t.split())
        elif i % 7 == 0:
            t = t + "\n" + passage
        elif i % 11 == 0:
            t = t.replace(t.split()[3], "changed", 1)
        rows.append((i, t, rng.choice(["en", "de", None]), f"src{rng.randint(0, 3)}"))
    rows += [(300, None, "en", "src1"), (301, "", None, None), (302, "word " * 30_000, "en", "src1"), (None, good[0], "de", "src2"), (303, good[1], "de", "src2"), (303, good[1], "de", "src2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *[f"'{c}!' as {c}" for c in CLASH])
    at = tmp_path_factory.mktemp("tables")
    df.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return df, str(at)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def whole(df, columns):
    """The stage keeps columns and their values."""
    assert df.columns == columns
    assert df.filter(" OR ".join(f"`{c}` <> '{c}!'" for c in CLASH)).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mixture", "tokens"]


def test_quality(spark, made):
    df, at = made
    out = corpus_pipeline.quality_stage(spark, df, at)
    whole(out, df.columns)
    rows, _, _ = quality.resample(df, spark.read.parquet(f"{at}/labels.parquet"))
    want = rows.filter("kept").collect()
    assert sorted(str(r["doc_id"]) for r in want) == sorted(str(i) for i, _ in pairs(out))
    ids = [i for i, _ in pairs(out) if i is not None and i < 240]
    assert sum(i % 5 == 0 for i in ids) <= 5 and sum(i % 5 > 0 for i in ids) >= 180


def test_lines(spark, made):
    df, at = made
    out = corpus_pipeline.lines_stage(spark, df, at)
    whole(out, df.columns)
    was = pairs(df)
    want = [(i, t) for (i, t) in without_runs([x for x in was if x[0] != 302], 50)]
    # what a document has lost wholly goes; what was empty or null before stays
    lost = [(i, t) for i, t in want if not (t == "" and (i, "") not in was)]
    assert sorted([x for x in pairs(out) if x[0] != 302], key=str) == sorted(lost, key=str)
    assert [t for i, t in pairs(out) if i == 302] == ["word " * 30_000]


def test_near_copies(spark, made):
    df, at = made
    out = corpus_pipeline.near_copies_stage(spark, df, at)
    whole(out, df.columns)
    want = {i for i, _, c in groups(pairs(df)) if i is not None and i == c} | {None}
    assert {i for i, _ in pairs(out)} == want


def test_mixture(spark, made):
    df, at = made
    out = corpus_pipeline.mixture_stage(spark, df, at)
    whole(out, df.columns)
    got = mixing.mix(df).select("doc_id", "text").collect()
    assert sorted(map(str, pairs(out))) == sorted(str(tuple(r)) for r in got)
    tokens = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows)
    assert abs(tokens(pairs(out)) - tokens(pairs(df))) <= 30_000 + 100 * 20


def test_run_and_empty(spark, made):
    df, at = made
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    rows = corpus_pipeline.run(spark, at).collect()
    docs = df
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, at)
    tok = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = sorted((str(i), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs(docs))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == want
