"""Operators against brute force, laws and held-out rows, with nulls, empties, long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcount.llm import ann, exact_dedup, hilbert, mixing, quality, secrets, url_filter


def texts(n=60):
    rng = random.Random(9)
    bits = ["password = hunter2hunter2", "token: secret=abcdefgh1", "API_KEY:'x/y+z=12345'", "apikey=short", "pass word", "AKIAABCDEFGHIJKL", "AKIA1234", "xAKIAAKIAAKIAAKIA9", "0123456789abcdef" * 2, "0123456789abcdef" * 3 + "g", "Secret == zzzzzzzzz", "token  =  \"aaaabbbbcccc\" token='q'", "日本 é ", "\n", "Bearer abcdefghijklmnopqrstuvwxyz", "-----BEGIN RSA PRIVATE KEY-----"]
    out = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(n)]
    return out + ["", "a" * 50_000 + " password: 12345678", "password: token: abcdefghijk", "passwd\"=\"A1b2c3d4"]


def brute_secrets(text):
    rules = [("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    found = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return sorted(found)


def test_secrets(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "AKIAABCDEFGHIJKL"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "1 as found")
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.digest(secrets.scan(df)).collect()), key=str)
    want = []
    for i, t in rows:
        f = brute_secrets(t or "")
        name = ",".join(f"{kind}:{a}:{z}" for a, _, kind, z in f)
        want.append((i, *(sum(x[2] == k for x in f) for k in ("assign", "access", "hex")), hashlib.sha256(name.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert secrets.scan(df.limit(0)).count() == 0


def test_spans_of_many_matches(spark):
    rule = next(r for r in secrets.RULES if r.kind == "assign")
    for n in (0, 1, 2, 3, 4, 5, 16, 17, 2000):
        text = "é ".join("token=" + "a" * (6 + k % 5) for k in range(n)) + " end"
        got = spark.createDataFrame([(text,)], "text string").select(secrets.spans_of(F.col("text"), rule).alias("x")).first()["x"]
        want = [m.span() for m in re.finditer(r"token=([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 8]
        assert [(x["start"], x["end"]) for x in got] == want
    text = "token=abcdefgh " * 40_000
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.digest(secrets.scan(rows)).first()["n_assign"] == 40_000


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{32,}") is True
    assert secrets.trigram_query("abcd") == ("and", frozenset({("tri", "abc"), ("tri", "bcd")}))
    assert secrets.trigrams_of(secrets.trigram_query(r"(foo|bar)[0-9]+x")) == {"foo", "bar"}


def test_full_index_gives_the_same_candidates(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(20))], "key long, text string")
    queries = {r.kind: q for r in secrets.RULES if (q := secrets.trigram_query(r.pattern)) is not True}
    few = secrets.build_index(df, set().union(*map(secrets.trigrams_of, queries.values())))
    some, all_ = (sorted(map(tuple, secrets.candidates(x, queries).collect())) for x in (few, secrets.build_index(df, None)))
    assert some == all_


def test_exact_dedup(spark):
    rows = [(5, "Ab"), (7, "aB"), (7, "AB"), (1, "É"), (2, "é"), (3, None), (4, ""), (None, "ab"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as digest", "1 as uid")
    index = exact_dedup.DigestIndex(spark)
    got = index.ingest(df).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in got if r["doc_id"] in (5, 7)) == [(7, 4)] * 3
    assert sum(r["kept"] for r in got) == 5 and {r["doc_id"] for r in got if r["kept"]} == {7, 1, 2, 4, None}
    again = index.ingest(spark.createDataFrame([(90, "aB"), (91, "new"), (92, "NEW")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in again} == {90: (7, False), 91: (92, False), 92: (92, True)}
    opened = exact_dedup.DigestIndex(spark, "opened_again", index.path, index.buckets)
    assert opened.table().count() == 6
    assert index.ingest(df.limit(0)).count() == 0
    some = spark.createDataFrame([(95, "later"), (96, "LATER")], "doc_id long, text string")
    assert [sorted(map(tuple, index.ingest(some, "named").select("doc_id", "keep_id", "kept").collect())) for _ in range(2)] == [[(95, 96, False), (96, 96, True)]] * 2
    plan = spark.table(index.name).groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    join = index.new_digests(index._rows(df))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in join and "LeftAnti" in join
    index.drop()
    assert index.table() is None


def test_exact_dedup_of_a_whole_table(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(300)]), rng.choice([None, "", "a", "A", "b", "É", f"u{k}"])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = sorted(((i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)])) for i, t in rows), key=str)
    for hot, batches in ((65_536, 2), (7, 3), (7, 1)):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        index = exact_dedup.DigestIndex(spark)
        got = index.ingest_all(df, batches).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want
        assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.DigestIndex(spark).ingest_all(df.limit(0)).count() == 0


def test_hilbert_curve_is_a_walk(spark):
    for dims, bits in ((2, 3), (3, 2)):
        cells = spark.range(2 ** (dims * bits)).select(F.array(*[F.pmod(F.floor(F.col("id") / 2 ** (bits * d)), F.lit(2**bits)).cast("int") for d in range(dims)]).alias("x"))
        walk = [r["x"] for r in cells.withColumn("h", hilbert.hilbert_index(F.col("x"), dims, bits)).orderBy("h").collect()]
        assert len({tuple(x) for x in walk}) == 2 ** (dims * bits)
        assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(walk, walk[1:]))


def curve_index(x, bits):
    """The place of a point on the curve, bit by bit (Skilling's inverse transform)."""
    x, q = list(x), 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    return int("".join(str(((v ^ t) >> b) & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_hilbert_order(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["de", "en", "fr", None]), f"a common beginning {rng.randint(0, 40):02d}", rng.randint(1, 900), f"t{i % 50}") for i in range(600)]
    rows += [(1_000 + i, "en", "a common beginning 07", 5, f"hot{i % 4}") for i in range(400)]  # a hot cell with four texts
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string").repartition(7)

    def steps(values):
        known = sorted(v for v in values if v is not None)
        cuts = {known[max(0, -(-k * len(known) // 16) - 1)] for k in range(1, 16)}
        return [0 if v is None else sum(c < v for c in cuts) for v in values]

    place = [curve_index(p, 4) for p in zip(*(steps([r[k] for r in rows]) for k in (1, 2)))]
    want = [r[0] for _, _, r in sorted((c, zlib.crc32(r[4].encode()), r) for c, r in zip(place, rows))]
    for partitions in ("4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = [r["doc_id"] for r in hilbert.assign(df, ("lang", "source"), 3).orderBy("shard", "slot").collect()]
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    hot = hilbert.assign(df, ("lang", "source"), 8).join(df.select("doc_id", "text"), "doc_id").filter("doc_id >= 1000")
    assert hot.groupBy("text").agg(F.max("shard") - F.min("shard")).agg(F.max("(max(shard) - min(shard))")).first()[0] <= 1  # side by side
    with pytest.raises(ValueError):
        hilbert.assign(df, ())


def test_hilbert_shards(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["de", "en", None]), f"src{rng.randint(0, 5)}", rng.randint(1, 900) if i % 7 else None, "same" if i % 3 == 0 else f"t{i}é") for i in range(403)] + [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string").selectExpr("*", "1 as shard", "2 as cell")
    got = hilbert.assign(df).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(8)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    by = sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None)
    assert by == sorted((r[0], len(r[4].encode()) + 1, zlib.crc32(r[4].encode())) for r in rows if r[0] is not None)
    assert hilbert.assign(df.limit(0)).count() == 0
    hilbert.write_shards(df.drop("shard"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 405 and back.select("shard").distinct().count() == 8


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "src30", None, "x"])) for i in range(500)] + [(None, None, "en", "src1"), (7, "a b", "en", "src1"), (7, "a b", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'d' as domain", "5 as whole")
    names = dict(zip(mixing.appended(df), ("domain", "n_tokens", "epoch"), strict=True))
    out = mixing.mix(df, share=1.5)
    assert out.columns == [*df.columns, "_domain", "n_tokens", "epoch"] and out.filter("domain <> 'd' OR whole <> 5").count() == 0
    got = out.drop("domain").withColumnsRenamed(names)
    assert [tuple(r) for r in got.orderBy("doc_id", "epoch").collect()] == [tuple(r) for r in mixing.mix(df, share=1.5).drop("domain").withColumnsRenamed(names).orderBy("doc_id", "epoch").collect()]
    leaves = got.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("got"), F.max("n_tokens").alias("most"))
    own = df.select(mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", mixing.token_count(F.col("text")).alias("n")).groupBy("domain", "lang", "source").agg(F.sum("n").alias("tokens"))
    total = own.agg(F.sum("tokens")).first()[0]
    plan = mixing.budgets(own, total * 1.5)
    assert plan.agg(F.sum("budget")).first()[0] == pytest.approx(total * 1.5, rel=1e-6)
    want = {(r["domain"], r["lang"], r["source"]): r for r in plan.collect()}
    for r in leaves.collect():
        w = want[r["domain"], r["lang"], r["source"]]
        assert w["budget"] - 1e-3 <= r["got"] <= w["budget"] + 45 and w["whole"] <= mixing.MAX_EPOCHS
    # the documents of each leaf, directly: whole epochs, then the prefix in the seeded order while tokens are left
    docs = {}
    for i, t, lang, source in rows:
        leaf = ("domain%d" % (int(re.search("[0-9]+$", source)[0]) % 4 if source and re.search("[0-9]+$", source) else 0), lang, source)
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        docs.setdefault(leaf, []).append((md5(f"{'null' if i is None else i}:{md5(t or '')}"), len((t or "").split()), i))
    wanted = []
    for leaf, own in docs.items():
        w = want[leaf]
        for e in range(w["whole"]):
            wanted += [(i, e) for _, _, i in own]
        used, last = 0, None
        for key, n, i in sorted((md5(f"{mixing.SEED}:{w['whole']}:{d}"), n, i) for d, n, i in own if i is not None or True):
            if key != last and used >= w["rest"]:
                break
            used, last = used + n, key
            wanted.append((i, w["whole"]))
    assert sorted(((r["doc_id"], r["epoch"]) for r in got.collect()), key=str) == sorted(wanted, key=str)
    assert mixing.mix(df.limit(0)).count() == 0


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("b", "y", "s3", 1000)], "domain string, lang string, source string, tokens long")
    weights = {"domain": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "domain string, weight double"), "lang": spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "domain string, lang string, weight double"),
               "source": spark.createDataFrame([("a", "x", "s1", 0.5), ("a", "x", "s2", 0.5), ("b", "y", "s3", 1.0)], "domain string, lang string, source string, weight double")}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, 400, weights, max_epochs=1).collect()}
    assert got == {"s1": 10.0, "s2": 190.0, "s3": 200.0}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves.withColumn("tokens", F.when(F.col("source") == "s2", 50).otherwise(F.col("tokens"))), 400, weights, max_epochs=1).collect()}
    assert got == {"s1": 10.0, "s2": 50.0, "s3": 340.0}


def test_urls(spark):
    rng = random.Random(6)
    hosts = ["a.net", "NET", "net", "x.Example.net", "example.net", "notnet", "example.com", "www.example.com", "b.org", "org", "a.net:80", ""]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/de/1", "/fr/", "/fr?x=/en/", "#/en/", "/EN/"]
    urls = [f"{rng.choice(['http', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)] + [None, "", "nothing", "a.net/en/", "http://a?u=http://b.net/", "://" + "s." * 300 + "net" + "/d" * 500]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.org", "/f", "block"), ("org", "", "block")]
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0]), (None, urls[1])], "page_id long, url string").selectExpr("*", "'h' as host", "'r' as rule")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def judged(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fit = max(((len(a + b), v == "block", a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)), default=None)
        return h, p, fit[2] if fit else None, fit[3] if fit else "allow"

    got = sorted((tuple(r) for r in url_filter.judge(df, table).collect()), key=str)
    assert got == sorted(((i, *judged(u)) for i, u in [*enumerate(urls), (0, urls[0]), (None, urls[1])]), key=str)
    assert url_filter.judge(df, table.limit(0)).filter("rule IS NOT NULL").count() == 0
    assert url_filter.judge(df.limit(0), table).count() == 0


def brute_nearest(rows, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q)[:k]
    return out


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_GROUP", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(3000)] + [(3000 + i, [1.0] * 8) for i in range(300)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [float("nan")] * 8), (5004, [None] + [1.0] * 7), (5005, [1.0, 2.0]), (5100, [float("inf")] * 8), (5200, [1.0] * 8), (None, [1.0] * 8), (9007199254740993, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as list", "2 as score")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows, 10)
    assert set(got) == set(want) and all([x[0] for x in sorted(v)] == list(range(1, 11)) for v in got.values())
    hits = sum(len({x[1] for x in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert [(i, d) for _, i, d in sorted(got[3100])] == [(i, d) for d, i in want[3100]]
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in ann.search(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [i for _, i in brute_nearest(rows[:4], 10)[0]]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def corpus():
    rng = random.Random(8)
    vocab = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "is"]
    good = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(30, 80))) + "."
    bad = lambda: " ".join(rng.choice(vocab).upper() + "!!$$" for _ in range(rng.randint(30, 80)))
    return [(i, good() if i % 5 else bad()) for i in range(600)]


def test_quality(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + [(None, None), (700, ""), (701, None), (1, rows[1][1])], "doc_id long, text string").selectExpr("*", "'w' as log_weight", "1 as good")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    got, _, _ = quality.resample(df, labels)
    kept = {(r["doc_id"]): r["kept"] for r in got.collect()}
    held = [i for i in range(1, 600, 2)]
    assert np.mean([kept[i] == bool(i % 5) for i in held]) > 0.97
    assert quality.resample(df, labels, 100)[0].filter("kept").count() == 100
    assert quality.keep(df, labels).columns == df.columns
    assert quality.resample(df, labels.limit(0))[0].filter("NOT kept").count() <= df.count() - 1
    assert quality.resample(df.limit(0), labels)[0].count() == 0


def test_kth_largest(spark):
    values = [random.Random(1).gauss(0, 1) for _ in range(2000)] + [0.5] * 50
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 3, 700, 2050):
        assert quality.kth_largest(df, k, 16) == sorted(values, reverse=True)[k - 1]
