"""Join, set, graph, hash and sketch queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.functions import text as tx
from loomcount.operators import graph as gr
from loomcount.operators import model1 as m1
from loomcount.operators import neighbours as nb
from loomcount.operators import ngrams as ng
from loomcount.operators import sketch as sk
from loomcount.plans.registry import Tables, big, query, r6
from loomcount.plans.sqltext import TOKENS, grams
from loomcount.plans.text_queries import _TURNS, turn_pairs
from loomcount.sources.tables import dealt, written

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def hosts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), "html")


@query(f"WITH p AS (SELECT page_id, {_HOST} AS host FROM pages), n AS (SELECT host, count(*) AS pages FROM p WHERE page_id % 3 = 0 GROUP BY host) SELECT DISTINCT p.host, coalesce(n.pages, 0)::BIGINT AS pages FROM p LEFT JOIN n USING (host)")
def left_zero_fill(t: Tables) -> DataFrame:
    """Features of missing hosts are zero"""
    h = hosts(t).drop("html")
    n = h.filter("page_id % 3 = 0").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return h.select("host").distinct().join(n, "host", "left").select("host", F.coalesce("pages", F.lit(0)).cast("bigint").alias("pages"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_missing(t: Tables) -> DataFrame:
    """J03, J19"""
    return t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query(f"SELECT page_id, {_HOST} AS host FROM pages WHERE {_HOST} IN (SELECT {_HOST} FROM pages WHERE page_id % 5 = 0)")
def semi_hosts(t: Tables) -> DataFrame:
    """J04, S17"""
    h = hosts(t).select("page_id", "host")
    return h.join(h.filter("page_id % 5 = 0").select("host").distinct(), "host", "left_semi").select("page_id", "host")


@query(f"WITH {_TURNS} SELECT conv_id, turn, length(src) AS s, length(trg) AS t FROM u")
def positional_zip(t: Tables) -> DataFrame:
    """J05, S22"""
    return turn_pairs(t).select("conv_id", "turn", big(F.length("src"), "s"), big(F.length("trg"), "t"))


@query("SELECT d.doc_id, d.n_chars, l.quality::BIGINT AS quality, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id")
def feature_families(t: Tables) -> DataFrame:
    """Families of features side by side"""
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))
    return t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", big("quality", "quality")), "doc_id").join(e, "doc_id")


@query(f"WITH {_TURNS}, w AS (SELECT conv_id, turn, string_split(lower(src), ' ') AS s, string_split(lower(trg), ' ') AS t FROM u), x AS (SELECT conv_id, turn, unnest(s) AS sw, t FROM w), y AS (SELECT sw, unnest(t) AS tw FROM x) SELECT sw, tw, count(*) AS n FROM y GROUP BY ALL")
def word_pairs(t: Tables) -> DataFrame:
    """Words of both sides of a pair"""
    p = dealt(turn_pairs(t), "conv_id", "turn").filter("src IS NOT NULL AND trg IS NOT NULL")
    return m1.word_pairs(written(p.select(F.lower("src").alias("src"), F.lower("trg").alias("trg")))).select(F.col("s").alias("sw"), F.col("t").alias("tw"), "n")


@query("SELECT o_orderkey, (SELECT min(b.bound) FROM (SELECT DISTINCT (p_partkey * 2500)::DOUBLE AS bound FROM part WHERE p_partkey % 3 = 0) b WHERE b.bound >= o_totalprice) AS bound FROM orders")
def asof_boundary(t: Tables) -> DataFrame:
    """The first boundary at or above a key. Boundaries and keys are merged into ranges of 2^16; the answer lies in the key's own range or in the next one that has any"""
    b = t.part.filter("p_partkey % 3 = 0").select((F.col("p_partkey") * 2500).cast("double").alias("bound")).distinct()
    size = 65536.0
    own = b.groupBy(F.floor(F.col("bound") / size).alias("r")).agg(F.min("bound").alias("low"), F.array_sort(F.collect_list("bound")).alias("bounds"))
    ranges = t.orders.select(F.floor(F.col("o_totalprice") / size).alias("r")).distinct().withColumn("k", F.lit(1))
    every = ranges.join(own, "r", "full_outer")  # a row for each range in use
    later = F.first("low", ignorenulls=True).over(W.orderBy("r").rowsBetween(1, W.unboundedFollowing))
    every = every.select("r", "bounds", later.alias("later"))
    met = t.orders.select("o_orderkey", F.col("o_totalprice").cast("double").alias("x")).withColumn("r", F.floor(F.col("x") / size)).join(every, "r")
    return met.select("o_orderkey", F.coalesce(F.array_min(F.filter("bounds", lambda v: v >= F.col("x"))), F.col("later")).alias("bound"))


_EDGES = """e AS (SELECT l_suppkey AS src, -l_partkey AS dst, count(*) AS n FROM lineitem GROUP BY ALL
    UNION ALL SELECT -l_partkey, l_suppkey, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), m AS (SELECT src AS node, sum(n)::DOUBLE AS x FROM e GROUP BY src)"""
_RATIO = "CASE WHEN {1} <> 0 THEN {0} / {1} WHEN {0} = 0 THEN 1 ELSE 0 END"


def edges(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Deliveries from suppliers (their keys) to parts (their keys below zero), returns the other way round; and the measure of nodes with out-links."""
    supplier, part, n = F.col("l_suppkey"), -F.col("l_partkey"), F.count(F.lit(1)).alias("n")
    back = t.lineitem.filter("l_returnflag = 'R'").groupBy(part.alias("src"), supplier.alias("dst")).agg(n)
    e = t.lineitem.groupBy(supplier.alias("src"), part.alias("dst")).agg(n).union(back)
    return e, e.groupBy(F.col("src").alias("node")).agg(F.sum("n").cast("double").alias("x"))


_ADJ = "a AS (SELECT src AS node, dst AS nbr, n, 'out' AS dir FROM e UNION ALL SELECT dst, src, n, 'in' FROM e), g AS (SELECT node, count(*) FILTER (dir = 'out') AS outdeg, count(*) FILTER (dir = 'in') AS indeg FROM a GROUP BY node)"


@query(f"WITH {_EDGES}, {_ADJ} SELECT node, outdeg, indeg FROM g")
def adjacency_degrees(t: Tables) -> DataFrame:
    """G01"""
    return gr.degrees(edges(t)[0])


def _near(side: str, deg: str) -> str:
    return f"SELECT a.node, 'near_{side}' AS feature, {_RATIO.format('sum(coalesce(m.x, 0))', f'sum(g.{deg})')} AS value FROM a JOIN g ON g.node = a.nbr LEFT JOIN m ON m.node = a.nbr WHERE a.dir = '{side}' GROUP BY a.node"


def _far(side: str, hop: str) -> str:
    return f"SELECT a.node, 'far_{side}_{hop}' AS feature, {_RATIO.format('sum(coalesce(m.x, 0))', 'sum(b.n)')} AS value FROM a JOIN a b ON b.node = a.nbr AND b.dir = '{hop}' LEFT JOIN m ON m.node = b.nbr WHERE a.dir = '{side}' GROUP BY a.node"


@query(f"WITH {_EDGES}, {_ADJ} SELECT node, round(value, 6) AS value FROM ({_near('in', 'outdeg')})")
def nbr_ratio_in(t: Tables) -> DataFrame:
    """G02"""
    return gr.neighbour_ratio(*edges(t), "in").select("node", r6("value", "value"))


@query(f"WITH {_EDGES}, {_ADJ} SELECT node, round(value, 6) AS value FROM ({_near('out', 'indeg')})")
def nbr_ratio_out(t: Tables) -> DataFrame:
    """G03"""
    return gr.neighbour_ratio(*edges(t), "out").select("node", r6("value", "value"))


@query(f"WITH {_EDGES}, {_ADJ} SELECT node, round(value, 6) AS value FROM ({_far('in', 'in')})")
def two_hop_in(t: Tables) -> DataFrame:
    """G04, J12"""
    return gr.two_hop(*edges(t), "in", "in").select("node", r6("value", "value"))


@query(f"WITH {_EDGES}, {_ADJ} SELECT node, round(value, 6) AS value FROM ({_far('out', 'out')})")
def two_hop_out(t: Tables) -> DataFrame:
    """G05, J12"""
    return gr.two_hop(*edges(t), "out", "out").select("node", r6("value", "value"))


@query(f"WITH {_EDGES}, {_ADJ} SELECT node, feature, round(value, 6) AS value FROM (SELECT node, 'degree' AS feature, {_RATIO.format('outdeg', 'indeg')} AS value FROM g UNION ALL {_near('in', 'outdeg')} UNION ALL {_near('out', 'indeg')} UNION ALL {_far('in', 'in')} UNION ALL {_far('in', 'out')} UNION ALL {_far('out', 'in')} UNION ALL {_far('out', 'out')})")
def graph_features(t: Tables) -> DataFrame:
    """G06"""
    return gr.all_features(*edges(t)).select("node", "feature", r6("value", "value"))


@query(f"WITH {_EDGES} SELECT e.src, e.dst, round((ln(1 + e.n) + ln(1 + coalesce(b.n, 0))) * CASE WHEN coalesce(s.x, 0) < coalesce(d.x, 0) THEN 0.1 ELSE 1 END, 6) AS w FROM e LEFT JOIN e b ON b.src = e.dst AND b.dst = e.src LEFT JOIN m s ON s.node = e.src LEFT JOIN m d ON d.node = e.dst")
def bidir_weight(t: Tables) -> DataFrame:
    """G07, J13"""
    return gr.both_ways(*edges(t)).select("src", "dst", r6("w", "w"))


_RULES = f"{TOKENS}, r AS (SELECT DISTINCT lang, unnest({grams('w', 2)}) AS rule FROM w WHERE doc_id % 4 < 2), q AS (SELECT DISTINCT lang, unnest({grams('w', 2)}) AS rule FROM w WHERE doc_id % 4 >= 2)"


def rules(t: Tables) -> tuple[DataFrame, DataFrame]:
    each = lambda d: ng.exploded(d, tx.tokens(F.col("text")), [2], "lang").select("lang", F.col("gram").alias("rule")).distinct()
    return each(t.documents.filter("doc_id % 4 < 2")), each(t.documents.filter("doc_id % 4 >= 2"))


@query(f"""WITH {_RULES}, n AS (SELECT lang, count(*) AS n FROM r GROUP BY lang), k AS (SELECT lang, count(*) AS k FROM q GROUP BY lang), b AS (SELECT lang, count(*) AS both_ FROM r JOIN q USING (lang, rule) GROUP BY lang)
    SELECT lang, both_, round(both_ / n, 6) AS precision_, round(both_ / k, 6) AS recall, round(1 - 2.0 * both_ / (n + k), 6) AS error FROM b JOIN n USING (lang) JOIN k USING (lang)""")
def rule_overlap(t: Tables) -> DataFrame:
    """J14, E20"""
    r, q = rules(t)
    n, k = r.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), q.groupBy("lang").agg(F.count(F.lit(1)).alias("k"))
    b = r.join(q, ["lang", "rule"]).groupBy("lang").agg(F.count(F.lit(1)).alias("both_"))
    return b.join(n, "lang").join(k, "lang").select("lang", "both_", r6(F.col("both_") / F.col("n"), "precision_"), r6(F.col("both_") / F.col("k"), "recall"), r6(1 - 2.0 * F.col("both_") / (F.col("n") + F.col("k")), "error"))


@query(f"WITH {_RULES} SELECT side, lang, count(*) AS n, round(1.0 / count(*), 9) AS prob FROM (SELECT 'left' AS side, * FROM (SELECT * FROM r EXCEPT SELECT * FROM q) UNION ALL SELECT 'right', * FROM (SELECT * FROM q EXCEPT SELECT * FROM r)) GROUP BY ALL")
def two_sided_diff(t: Tables) -> DataFrame:
    """J15"""
    both = ng.counts(t.documents.filter("doc_id IS NOT NULL"), [2], "lang", left=F.expr("doc_id % 4 < 2"), right=F.expr("doc_id % 4 >= 2"))  # texts are counted once for both sides
    d = both.filter("(left > 0) <> (right > 0)").withColumn("side", F.when(F.col("left") > 0, "left").otherwise("right"))
    return d.groupBy("side", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(1.0 / F.count(F.lit(1)), 9).alias("prob"))


_LINKS = f"""{_TURNS}, p AS (SELECT conv_id, turn, string_split(lower(src), ' ') AS s, string_split(lower(trg), ' ') AS t FROM u),
    x AS (SELECT conv_id, turn, unnest(s) AS sw, unnest(range(len(s))) AS i, t FROM p), y AS (SELECT conv_id, turn, i, sw, unnest(t) AS tw, unnest(range(len(t))) AS j FROM x),
    a AS (SELECT DISTINCT conv_id, turn, i, j FROM y WHERE sw = tw), b AS (SELECT DISTINCT conv_id, turn, i, j FROM y WHERE substr(sw, 1, 2) = substr(tw, 1, 2) AND abs(i - j) < 6)"""


def links(t: Tables) -> tuple[DataFrame, DataFrame]:
    first = lambda c: F.split(F.lower(c), " ")
    x = turn_pairs(t).select("conv_id", "turn", F.posexplode(first("src")).alias("i", "sw"), first("trg").alias("t")).select("conv_id", "turn", "i", "sw", F.posexplode("t").alias("j", "tw"))
    a = x.filter("sw = tw").select("conv_id", "turn", "i", "j").distinct()
    return a, x.filter("substr(sw, 1, 2) = substr(tw, 1, 2) AND abs(i - j) < 6").select("conv_id", "turn", "i", "j").distinct()


@query(f"WITH {_LINKS}, n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a JOIN b USING (conv_id, turn, i, j)) AS both_) SELECT na, nb, both_, round(both_ / nb, 6) AS precision_, round(both_ / na, 6) AS recall, round(1 - 2.0 * both_ / (na + nb), 6) AS aer FROM n")
def alignment_aer(t: Tables) -> DataFrame:
    """J16, E20, S24"""
    a, b = links(t)
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), ["conv_id", "turn", "i", "j"], "full_outer")
    n = both.agg(F.count("x").alias("na"), F.count("y").alias("nb"), F.count_if(F.expr("x = 1 AND y = 1")).alias("both_"))
    return n.select("na", "nb", "both_", r6(F.col("both_") / F.col("nb"), "precision_"), r6(F.col("both_") / F.col("na"), "recall"), r6(1 - 2.0 * F.col("both_") / (F.col("na") + F.col("nb")), "aer"))


@query(f"WITH {_LINKS}, s AS (SELECT conv_id, turn, i, list_sort(list(j)) AS js FROM b GROUP BY ALL), g AS (SELECT conv_id, turn, js, count(*) AS len FROM s GROUP BY ALL) SELECT conv_id, turn, array_to_string(js, '-') AS target, len FROM g WHERE len + len(js) < 7")
def phrase_groups(t: Tables) -> DataFrame:
    """Source places with the same targets; phrases of seven or more signs go"""
    s = links(t)[1].groupBy("conv_id", "turn", "i").agg(F.array_sort(F.collect_list("j")).alias("js"))
    g = s.groupBy("conv_id", "turn", "js").agg(F.count(F.lit(1)).alias("len"))
    return g.filter(F.col("len") + F.size("js") < 7).select("conv_id", "turn", F.array_join(F.col("js").cast("array<string>"), "-").alias("target"), "len")


@query("SELECT period, count(*) AS n FROM (SELECT source AS period FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT 'turns' FROM conversations UNION ALL SELECT 'bench' FROM benchmark) GROUP BY period")
def period_union(t: Tables) -> DataFrame:
    """J18"""
    d = t.documents.filter("source IN ('src1', 'src2')").select(F.col("source").alias("period"))
    return d.unionByName(t.conversations.select(F.lit("turns").alias("period"))).unionByName(t.benchmark.select(F.lit("bench").alias("period"))).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT quality, avg(n_chars) AS m, var_samp(n_chars) AS v FROM documents JOIN labels USING (doc_id) GROUP BY quality), g AS (SELECT quality, avg(length(source)) AS m, var_samp(length(source)) AS v FROM documents JOIN labels USING (doc_id) GROUP BY quality)
    SELECT feature, round((m1 - m0) ** 2 / nullif(v1 + v0, 0), 6) AS fisher FROM (SELECT 'chars' AS feature, max(m) FILTER (quality = 1) AS m1, max(m) FILTER (quality = 0) AS m0, max(v) FILTER (quality = 1) AS v1, max(v) FILTER (quality = 0) AS v0 FROM f
    UNION ALL SELECT 'source', max(m) FILTER (quality = 1), max(m) FILTER (quality = 0), max(v) FILTER (quality = 1), max(v) FILTER (quality = 0) FROM g)""")
def fisher_ratio(t: Tables) -> DataFrame:
    """A17, T04"""
    d = t.documents.join(t.labels, "doc_id").select("quality", F.explode(F.array(F.struct(F.lit("chars").alias("f"), F.col("n_chars").cast("double").alias("v")), F.struct(F.lit("source").alias("f"), F.length("source").cast("double").alias("v")))).alias("x"))
    one = lambda f, k: f(F.when(F.col("quality") == k, F.col("x.v")))
    s = d.groupBy(F.col("x.f").alias("feature")).agg(one(F.avg, 1).alias("m1"), one(F.avg, 0).alias("m0"), one(F.var_samp, 1).alias("v1"), one(F.var_samp, 0).alias("v0"))
    return s.select("feature", r6(F.pow(F.col("m1") - F.col("m0"), 2) / F.nullif(F.col("v1") + F.col("v0"), F.lit(0.0)), "fisher")).orderBy(F.desc("fisher"), "feature")


@query("SELECT vec_id, label, err FROM (SELECT vec_id, label::BIGINT AS label, round(abs(label - list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 5) AS err FROM embeddings) QUALIFY row_number() OVER (PARTITION BY label ORDER BY err DESC, vec_id) <= 10")
def worst_examples(t: Tables) -> DataFrame:
    """A top-k report; the window keeps the k best of each task before the shuffle"""
    e = t.embeddings.select("vec_id", big("label", "label"), F.round(F.abs(F.col("label") - F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))), 5).alias("err"))
    return e.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(F.desc("err"), "vec_id"))).filter("k <= 10").drop("k")


@query("SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS first_, len(embedding) - list_position(list_reverse(embedding), list_max(embedding))::BIGINT AS last_ FROM embeddings")
def arg_max_class(t: Tables) -> DataFrame:
    """The first or the last class wins a tie"""
    e = F.col("embedding")
    return t.embeddings.select("vec_id", big(F.array_position(e, F.array_max(e)) - 1, "first_"), big(F.size(e) - F.array_position(F.reverse(e), F.array_max(e)), "last_"))


@query("SELECT round(avg((n_chars / 1000.0 - quality) ** 2), 6) AS mse FROM documents JOIN labels USING (doc_id)")
def score_mse(t: Tables) -> DataFrame:
    """A21"""
    return t.documents.join(t.labels, "doc_id").agg(r6(F.avg(F.pow(F.col("n_chars") / 1000.0 - F.col("quality"), 2)), "mse"))


@query("SELECT o_orderkey, ((48271 * o_custkey + 11) % 2147483647) % 1024 AS u, (((1103515245 * o_custkey) & 4294967295) >> 22) AS m FROM orders")
def integer_hashes(t: Tables) -> DataFrame:
    """H01, H02"""
    x = F.col("o_custkey").cast("bigint")
    return t.orders.select("o_orderkey", sk.universal(x, 48271, 11, 1024).alias("u"), sk.multiply_shift(x, 1103515245, 10).alias("m"))


@query("""SELECT p_partkey, list_reduce(list_prepend(31::BIGINT, list_transform(list_filter(string_split(p_name, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: xor(h, (h << 5) + (h >> 2) + c) & 2147483647) AS s,
    xor(xor(('0x' || substr(md5('3:0:' || (p_partkey & 255)), 1, 8))::BIGINT, ('0x' || substr(md5('3:1:' || ((p_partkey >> 8) & 255)), 1, 8))::BIGINT), xor(('0x' || substr(md5('3:2:' || ((p_partkey >> 16) & 255)), 1, 8))::BIGINT, ('0x' || substr(md5('3:3:' || ((p_partkey >> 24) & 255)), 1, 8))::BIGINT)) AS t FROM part""")
def string_and_table_hashes(t: Tables) -> DataFrame:
    """H03, H04"""
    return t.part.select("p_partkey", sk.shift_add_xor(F.col("p_name")).alias("s"), sk.tabulation(F.col("p_partkey").cast("bigint"), 3).alias("t"))


_CELL = "('0x' || substr(md5({0} || ':' || word), 1, 12))::BIGINT % 512"


@query(f"""WITH {TOKENS}, c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY word), s AS (SELECT r, {_CELL.format('r')} AS cell, sum(n) AS total FROM c, range(0, 4) x(r) GROUP BY ALL)
    SELECT word, min(total)::BIGINT AS estimate FROM (SELECT c.word, s.total FROM c, range(0, 4) x(k) JOIN s ON s.r = k AND s.cell = {_CELL.format('k')}) GROUP BY word""")
def countmin_estimate(t: Tables) -> DataFrame:
    """H05"""
    words = t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("word"))
    return sk.point_estimates(words, "word", sk.count_min(words, "word", 4, 512), 4, 512)


@query(f"WITH {TOKENS}, c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY word), b AS (SELECT {_CELL.format(0)} AS bucket, count(*) AS keys FROM c GROUP BY bucket) SELECT count(*) AS used, max(keys) AS largest, min(keys) AS smallest, count(*) FILTER (keys >= 100) AS full_, sum(keys - 1)::BIGINT AS collisions, round(count(*) / 512, 6) AS density FROM b")
def store_analysis(t: Tables) -> DataFrame:
    """Occupancy of the buckets of a store"""
    words = t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("word")).groupBy("word").count()
    b = words.groupBy(sk.cell(F.col("word"), 0, 512).alias("bucket")).agg(F.count(F.lit(1)).alias("keys"))
    return b.agg(F.count(F.lit(1)).alias("used"), F.max("keys").alias("largest"), F.min("keys").alias("smallest"), F.count_if(F.col("keys") >= 100).alias("full_"), big(F.sum(F.col("keys") - 1), "collisions"), r6(F.count(F.lit(1)) / 512, "density"))


@query()
def fingerprint_store(t: Tables) -> DataFrame:
    """Cells of the approximate store with the number of keys that share them"""
    c = ng.counts(t.documents, [1]).select("gram", "cnt")
    return sk.fingerprint_store(c, "gram", 1024, 12).groupBy("keys").agg(F.count(F.lit(1)).alias("cells"), big(F.sum("cnt"), "total"))


@query()
def bloomier_lookup(t: Tables) -> DataFrame:
    """Counts of all words stored in a static function and read back, exact"""
    c = ng.counts(t.documents, [1]).select("gram", "cnt")
    return sk.bloomier_query(c.select("gram"), "gram", sk.bloomier(c, "gram"), (1 << sk.COUNT_BITS) - 1)


_ENT = "c AS (SELECT event_type AS k, user_id AS u, count(*) AS n FROM events GROUP BY ALL)"


@query(f"WITH {_ENT} SELECT k, round(sum(-n / s * log2(n / s)), 6) AS entropy FROM (SELECT k, n, sum(n) OVER (PARTITION BY k) AS s FROM c) GROUP BY k")
def entropy_exact(t: Tables) -> DataFrame:
    """H15"""
    c = t.events.groupBy(F.col("event_type").alias("k"), "user_id").agg(F.count(F.lit(1)).alias("cnt"))
    return sk.entropy(c, "k").select("k", r6("entropy", "entropy"))


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY event_id) AS pos, event_type AS k FROM events), m AS (SELECT count(*)::DOUBLE AS m FROM s), r AS (SELECT a.pos, count(*) AS r FROM s a JOIN s b ON a.k = b.k AND b.pos >= a.pos WHERE a.pos <= 60 GROUP BY a.pos),
    x AS (SELECT (pos - 1) // 12 AS g, avg(r * log2(m / r) - CASE WHEN r > 1 THEN (r - 1) * log2(m / (r - 1)) ELSE 0 END) AS x FROM r, m GROUP BY g) SELECT round((list_sort(list(x)))[count(*) // 2 + 1], 6) AS entropy FROM x""")
def entropy_sampled(t: Tables) -> DataFrame:
    """H14"""
    from loomcount.functions.ordered import numbered

    s = numbered(t.events.select("event_id", F.col("event_type").alias("k")), "event_id", "pos")
    return sk.sampled_entropy(s.withColumnRenamed("k", "key"), "pos", "key", 12, 5).select(r6("entropy", "entropy"))


@query("SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT n_chars) AS sizes FROM documents GROUP BY lang")
def distinct_values(t: Tables) -> DataFrame:
    """H16"""
    return t.documents.groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct("n_chars").alias("sizes"))


def _lengths(t: Tables, finger: Column) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("address"), F.coalesce("n_chars", F.lit(0)).alias("value"), finger.cast("long").alias("finger"))


@query("""WITH b AS (SELECT doc_id * 31 // 32 AS cell, doc_id * 31 % 32 AS off, coalesce(n_chars, 0) << (doc_id * 31 % 32) AS v FROM documents),
    p AS (SELECT cell, v & 4294967295 AS bits FROM b UNION ALL SELECT cell + 1, v >> 32 FROM b WHERE off > 1) SELECT cell, bit_or(bits) AS bits FROM p GROUP BY cell""")
def packed_lengths(t: Tables) -> DataFrame:
    """Text lengths in 31 bits each, by doc_id"""
    return sk.packed(_lengths(t, F.lit(0)), 31)


@query("SELECT doc_id, coalesce(n_chars, 0) AS value FROM documents")
def packed_read(t: Tables) -> DataFrame:
    """Written and read back with the fingerprint of each document"""
    rows = _lengths(t, F.xxhash64("doc_id"))
    return sk.unpacked(rows.select("address", "finger"), sk.packed(rows, 31), 31).select(F.col("address").alias("doc_id"), "value")


_DIFF = "list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt({_DIFF}) AS d FROM e q JOIN e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) SELECT query_id, rank::INTEGER AS rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def kd_nearest(t: Tables) -> DataFrame:
    """2.14 exact nearest neighbours"""
    index = nb.Index(t.embeddings, "vec_id", F.col("embedding"))
    queries = t.embeddings.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    return nb.nearest(index, queries, 5).select("query_id", "rank", F.col("id").alias("vec_id"), r6("distance", "distance"))


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt({_DIFF}) AS d FROM e q JOIN e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
    SELECT query_id, vec_id, round(d, 6) AS distance FROM d WHERE d <= 1.1""")
def kd_range(t: Tables) -> DataFrame:
    """2.14 exact range search"""
    index = nb.Index(t.embeddings, "vec_id", F.col("embedding"))
    queries = t.embeddings.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    return nb.within(index, queries, 1.1).select("query_id", F.col("id").alias("vec_id"), r6("distance", "distance"))
