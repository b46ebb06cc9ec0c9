"""Learning, fusion, alignment and grammar queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.functions import text as tx
from loomcount.operators import align as al
from loomcount.operators import grammar as gr
from loomcount.operators import learn as le
from loomcount.operators import model1 as m1
from loomcount.operators import ngrams as ng
from loomcount.operators import sketch as sk
from loomcount.plans.registry import Tables, big, query, r6
from loomcount.plans.series_queries import changes
from loomcount.plans.sqltext import TOKENS, tok
from loomcount.plans.text_queries import _TURNS, turn_pairs
from loomcount.sources.tables import dealt, written

_X = "x AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS f, round(unnest(embedding)::DOUBLE, 1) + 0.0 AS v, quality AS label FROM embeddings JOIN labels ON doc_id = vec_id)"


def features(t: Tables) -> DataFrame:
    met = t.embeddings.join(t.labels, F.col("doc_id") == F.col("vec_id"))
    return met.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("f", "v"), F.col("quality").alias("label")).withColumn("v", F.round(F.col("v").cast("double"), 1))


_HIST = "h AS (SELECT f, label, v, count(*) AS n FROM x GROUP BY ALL)"


@query(f"WITH {_X}, {_HIST} SELECT f::BIGINT AS f, label::BIGINT AS label, v, n FROM h")
def feature_histograms(t: Tables) -> DataFrame:
    """A15"""
    return le.histograms(features(t)).select(big("f", "f"), big("label", "label"), "v", "n")


@query(f"WITH {_X} SELECT f::BIGINT AS f, label::BIGINT AS label, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 6) AS var FROM x GROUP BY ALL")
def class_moments(t: Tables) -> DataFrame:
    """A16"""
    return le.moments(le.histograms(features(t))).select(big("f", "f"), big("label", "label"), r6("mean", "mean"), r6("var", "var"))


@query(f"""WITH {_X}, m AS (SELECT f, label, avg(v) AS mean, var_pop(v) AS var FROM x GROUP BY ALL),
    s AS (SELECT id, m.label AS k, sum(ln(greatest(exp(-((v - mean) ** 2) / (2 * var)) / sqrt(2 * 3.14159 * var), 1e-300))) AS score FROM x JOIN m USING (f) WHERE var > 1e-12 GROUP BY id, m.label)
    SELECT id, k::BIGINT AS label, round(ln(CASE WHEN k = 1 THEN 0.9 ELSE 0.1 END) + score, 5) AS score FROM s""")
def nb_gaussian_scores(t: Tables) -> DataFrame:
    """Fixed priors 0.1 and 0.9"""
    x = features(t)
    return le.nb_gaussian(x, le.moments(le.histograms(x)), {0: 0.1, 1: 0.9}).select("id", big("label", "label"), F.round("score", 5).alias("score"))


@query(f"""WITH {_X}, {_HIST}, t AS (SELECT f, label, sum(n) AS t FROM h GROUP BY ALL), k AS (SELECT f, count(DISTINCT v) AS k FROM h GROUP BY f), z AS (SELECT label, max(t) AS size FROM t GROUP BY label),
    s AS (SELECT x.id, t.label, sum(ln((coalesce(h.n, 0) + 1) / (t.t + k.k))) AS ll FROM x JOIN t USING (f) JOIN k USING (f) LEFT JOIN h ON h.f = x.f AND h.label = t.label AND h.v = x.v GROUP BY ALL),
    r AS (SELECT id, label, ln(size / (SELECT sum(size) FROM z)) + ll AS score FROM s JOIN z USING (label))
    SELECT id, max_by(label, struct_pack(s := round(score, 9), l := -label))::BIGINT AS label FROM r GROUP BY id""")
def nb_histogram_labels(t: Tables) -> DataFrame:
    """M25, T06"""
    x = features(t)
    return le.best_label(le.nb_histogram(x, le.histograms(x))).select("id", big("label", "label"))


_MEMBERS = "v AS (SELECT vec_id AS id, k AS member, score::DOUBLE AS score FROM (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding) AS score FROM embeddings))"


def votes(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("member", "score")).withColumn("score", F.col("score").cast("double"))


@query(f"WITH {_MEMBERS} SELECT id, round(abs(avg(score)) * CASE WHEN sum(CASE WHEN score > 0 THEN 1 ELSE -1 END) > 0 THEN 1 ELSE -1 END, 6) AS score FROM v GROUP BY id")
def bagging_vote(t: Tables) -> DataFrame:
    """Each dimension is a weak member"""
    return le.bagged(votes(t)).select("id", r6("score", "score"))


@query(f"WITH {_MEMBERS}, e AS (SELECT member, avg((score < 0)::INT) AS error FROM v GROUP BY member) SELECT id, round(sum(score * (1 - error)) / sum(1 - error), 6) AS score FROM v JOIN e USING (member) GROUP BY id")
def error_weighted_average(t: Tables) -> DataFrame:
    """M26"""
    v = votes(t)
    return le.error_weighted(v, v.groupBy("member").agg(F.avg((F.col("score") < 0).cast("int")).alias("error"))).select("id", r6("score", "score"))


@query("SELECT doc_id AS id, toxic::BIGINT AS label, k AS member FROM labels, range(0, 5) r(k) WHERE toxic = 1 OR ('0x' || substr(md5(k || ':' || doc_id), 1, 8))::BIGINT / 4294967296 < 0.2")
def under_sampling(t: Tables) -> DataFrame:
    """M26"""
    return le.under_sampled(t.labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")), 5, 0.2).select("id", big("label", "label"), big("member", "member"))


def vectors(t: Tables) -> DataFrame:
    met = t.embeddings.join(t.labels, F.col("doc_id") == F.col("vec_id"))
    return met.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("quality") * 2 - 1).alias("y"))


@query()
def passive_aggressive(t: Tables) -> DataFrame:
    """Binary updates of an under-sampled ensemble"""
    rows = vectors(t).withColumn("label", (F.col("y") < 0).cast("int")).withColumnRenamed("vec_id", "id")
    m = le.under_sampled(rows, 3, 0.3).withColumn("member", F.col("member").cast("bigint"))
    return le.passive_aggressive(m, "member", "id", {1: 0.5, -1: 2.0})


@query()
def passive_aggressive_regression(t: Tables) -> DataFrame:
    """Regression within a tolerance"""
    rows = vectors(t).withColumn("member", F.lit(0).cast("bigint")).withColumn("y", F.aggregate("x", F.lit(0.0), lambda a, x: a + x))
    return le.passive_aggressive(rows, "member", "vec_id", {1: 1.0, -1: 1.0}, 0.05)


def suppliers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Suppliers by their keys, parts by their keys below zero."""
    edges = t.lineitem.groupBy(big("l_suppkey", "src"), big(-F.col("l_partkey"), "dst")).agg(F.count(F.lit(1)).alias("n"))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ids.select("node", (F.sin(F.col("node") * 1.7) / 2).alias("base"), F.when(F.col("node") % 3 == 0, F.when(F.col("node") % 2 == 0, 1).otherwise(-1)).alias("label")), edges


def vector_links(t: Tables, rows: DataFrame) -> DataFrame:
    """Links of five times a supplier's key with part keys, of those that both name vectors of rows."""
    edges = t.lineitem.groupBy((F.col("l_suppkey") * 5).alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    for side in ("src", "dst"):
        edges = edges.join(rows.select(F.col("vec_id").alias(side)), side, "left_semi")
    return edges.select("src", "dst", "n")


@query()
def graph_regulariser(t: Tables) -> DataFrame:
    """M23"""
    return le.graph_regularised(*suppliers(t), gamma=0.1, lam=1.0, rounds=400, tolerance=1e-6, written=written)


@query()
def alternating_training(t: Tables) -> DataFrame:
    """A linear learner and the graph's scores in turns, twice"""
    rows = vectors(t).withColumn("member", F.lit(0).cast("bigint"))
    edges = written(vector_links(t, rows))
    for _ in range(2):
        w = le.passive_aggressive(rows, "member", "vec_id", {1: 0.5, -1: 2.0}, 0.1).select(F.col("averaged").alias("w"))
        base = rows.crossJoin(F.broadcast(w)).select(F.col("vec_id").alias("node"), F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("base"), F.signum("y").cast("int").alias("label"))  # one row
        score = le.graph_regularised(base, edges, 0.1, 1.0, 400, 1e-6, written)
        rows = rows.select("vec_id", "x", "member").join(score.select(F.col("node").alias("vec_id"), F.col("score").alias("y")), "vec_id")
    return rows.select("vec_id", F.col("y").alias("score"))


def weak_outputs(t: Tables) -> DataFrame:
    """Four sources that guess the class of a document's quality from its place in the data, with errors of their own; a third of the epochs is untold."""
    d = t.labels.select(F.col("doc_id").alias("epoch"), F.col("quality").alias("truth")).withColumn("source", F.explode(F.sequence(F.lit(0), F.lit(3))))
    wrong = F.pmod(F.xxhash64("epoch", "source"), F.lit(10)) < F.col("source") + 1
    p1 = F.when(wrong, 0.9 - 0.8 * F.col("truth")).otherwise(0.1 + 0.8 * F.col("truth"))
    d = d.withColumn("ps", F.array(1 - p1, p1)).withColumn("gold", F.when(F.col("epoch") % 3 != 0, F.col("truth")))
    return d.select("source", "epoch", F.posexplode("ps").alias("k", "p"), "gold")


@query()
def ibcc_posteriors(t: Tables) -> DataFrame:
    """Class posteriors of all epochs"""
    return le.ibcc(weak_outputs(t), 2, 3, written)


@query()
def ibcc_hard_posteriors(t: Tables) -> DataFrame:
    """Sources count by their largest output; one prior for all"""
    return le.ibcc(weak_outputs(t), 2, 3, written, user_prior=2.0, soft=False)


@query("""WITH o AS (SELECT k AS source, doc_id AS epoch, quality AS gold, CASE WHEN (doc_id * 7 + k) % 10 < k + 1 THEN 1 - quality ELSE quality END AS hard FROM labels, range(0, 4) r(k))
    SELECT source, gold::BIGINT AS class, hard::BIGINT AS output, count(*) AS n, round(sum(CASE WHEN hard = 1 THEN 0.9 ELSE 0.1 END), 6) AS soft FROM o GROUP BY ALL""")
def ibcc_counts(t: Tables) -> DataFrame:
    """Hard and soft base counts of source, class and output"""
    o = t.labels.withColumn("source", F.explode(F.sequence(F.lit(0), F.lit(3))))
    hard = F.when((F.col("doc_id") * 7 + F.col("source")) % 10 < F.col("source") + 1, 1 - F.col("quality")).otherwise(F.col("quality"))
    return o.groupBy(big("source", "source"), big("quality", "class"), big(hard, "output")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.when(hard == 1, 0.9).otherwise(0.1)), "soft"))


def _em(k: int, x: str = "") -> str:
    """A round over the links l{x}."""
    before = f"SELECT DISTINCT s, t, 1.0::DOUBLE AS p FROM l{x}" if k == 0 else f"SELECT * FROM p{k - 1}{x}"
    return f"""q{k}{x} AS ({before}), z{k}{x} AS (SELECT sid, t, sum(n * p) AS z FROM l{x} JOIN q{k}{x} USING (s, t) GROUP BY ALL),
    c{k}{x} AS (SELECT s, t, sum(n * p / z * unit) AS c FROM l{x} JOIN q{k}{x} USING (s, t) JOIN z{k}{x} USING (sid, t) JOIN u2{x} USING (sid, t) GROUP BY ALL), p{k}{x} AS (SELECT s, t, c / sum(c) OVER (PARTITION BY s) AS p FROM c{k}{x})"""


def _links(src: str, trg: str, x: str = "") -> str:
    return f"""b{x} AS (SELECT conv_id || ':' || turn AS sid, list_prepend('<null>', {tok(src)}) AS s, {tok(trg)} AS t FROM u), d{x} AS (SELECT sid, unnest(s) AS s, t FROM b{x}),
    l{x} AS MATERIALIZED (SELECT sid, s, t, count(*) AS n FROM (SELECT sid, s, unnest(t) AS t FROM d{x}) GROUP BY ALL), u2{x} AS (SELECT sid, t, min(n) AS unit FROM l{x} GROUP BY ALL)"""


@query(f"WITH {_TURNS}, {_links('src', 'trg')}, {_em(0)}, {_em(1)} SELECT s, t, round(p, 6) AS p FROM p1")
def model1_em2(t: Tables) -> DataFrame:
    """Two rounds over user turns and the turns that follow"""
    p = dealt(turn_pairs(t), "conv_id", "turn")
    of = written(m1.texts(p, tx.tokens(F.col("src")), tx.tokens(F.col("trg"))))
    return m1.Model1(of, 2, written).table().select("s", "t", r6("p", "p"))


@query()
def hmm_training(t: Tables) -> DataFrame:
    """Log likelihood of three rounds over the users' event sequences; equal sequences count by their number"""
    names = _streams(t)
    kinds = F.array(*[F.lit(x) for x in names]).cast("array<string>")  # null and unknown types are one symbol, the first
    seq = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.coalesce(F.array_position(kinds, x["event_type"]).cast("int"), F.lit(0))).alias("obs"))
    seqs = seq.groupBy("obs").agg(F.count(F.lit(1)).alias("times"))
    _, trace = al.baum_welch(seqs, 2, len(names) + 1, 3)
    return t._spark.createDataFrame([(k, float(x)) for k, x in enumerate(trace)], "round int, log_likelihood double")


def itg_units(t: Tables, most: int | None = None) -> DataFrame:
    """sid, src, trg: clauses of a user turn with the clauses at the same place of the turn that follows; one that has no partner has an empty one. With `most`, only pairs of 1 to so many words a side
    have words; the others have null, and most of them are not split into words at all."""
    clauses = lambda c: F.split(c, r"[.,;:!?\n]+")
    p = turn_pairs(t)
    p = dealt(p, "conv_id", "turn") if most is None else p
    p = p.select("conv_id", "turn", F.posexplode(F.arrays_zip(clauses("src").alias("src"), clauses("trg").alias("trg"))).alias("k", "x"))
    words = lambda c: tx.tokens(F.coalesce(F.col(c), F.lit("")))
    p = p.select(F.concat_ws(":", "conv_id", "turn", "k").alias("sid"), "x")
    if most is None:
        return p.select("sid", words("x.src").alias("src"), words("x.trg").alias("trg"))
    few = lambda c: F.size(c).between(1, most)
    p = p.select("sid", "x", F.when(F.col("x.trg").isNotNull(), words("x.src")).alias("src"))
    p = p.select("sid", "src", F.when(few("src"), words("x.trg")).alias("trg"))
    return p.select("sid", *(F.when(few("trg"), F.col(c)).alias(c) for c in ("src", "trg")))


@query()
def itg_alignment(t: Tables) -> DataFrame:
    """Inside probabilities and best links of clauses of up to nine words a side, under a table learned in two rounds"""
    return al.itg_trained_alignments(written(itg_units(t, 9)), 2)


@query()
def itg_table(t: Tables) -> DataFrame:
    """The joint distribution over word pairs after two rounds of expected counts"""
    return al.itg_train(itg_units(t, 9), 2)[0]


@query()
def derivation_samples(t: Tables) -> DataFrame:
    """Rules of the clauses' derivations after two rounds of the binary sampler and one of the multinomial one; places are @0, @1, ..."""
    state = written(gr.started(itg_units(t)))
    for k, every in enumerate((False, False, True)):
        state = written(gr.sampled(state, k, 11, every, most=4, shard_of=64))
    side = lambda k: F.translate(F.replace(F.get(F.split("rule", gr.APART * 2), F.lit(k)), F.lit(gr.NONTERMINAL), F.lit("@")), gr.APART, " ").alias("st"[k])
    return gr.rule_counts(state).select(side(0), side(1), "n")


_DISH = f"{TOKENS}, c AS (SELECT lang, word, count(*) AS c, count(DISTINCT source) AS t FROM (SELECT lang, source, unnest(w) AS word FROM w) GROUP BY ALL), z AS (SELECT lang, sum(c) AS cc, sum(t) AS tt, count(*) AS v FROM c GROUP BY lang)"


def dishes(t: Tables) -> DataFrame:
    w = t.documents.select("lang", "source", F.explode(tx.tokens(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("source").alias("t"))
    return w.join(w.groupBy("lang").agg(F.sum("c").alias("cc"), F.sum("t").alias("tt"), F.count(F.lit(1)).alias("v")), "lang")


@query(f"WITH {_DISH} SELECT lang, word, round((c - 0.5 * t + (2.0 + 0.5 * tt) / v) / (cc + 2.0), 9) AS p, round((c - 1 - 0.5 * t + (2.0 + 0.5 * tt) / v) / (cc - 1 + 2.0), 9) AS minus_one, round(4 * (exp(lgamma(c + 2.5) - lgamma(2.5) - lgamma(c + 2.0) + lgamma(2.0)) - 1), 3) AS expected FROM c JOIN z USING (lang)")
def pyp_predictive(t: Tables) -> DataFrame:
    """Words as dishes, languages as restaurants, sources as tables"""
    c, n, cc, tt, p0 = (F.col("c"), F.col("t"), F.col("cc"), F.col("tt"), 1.0 / F.col("v"))
    d = dishes(t)
    return d.select("lang", "word", F.round(al.pyp_predictive(c, n, cc, tt, 0.5, 2.0, p0), 9).alias("p"), F.round(al.pyp_minus_one(c, n, cc, tt, 0.5, 2.0, p0), 9).alias("minus_one"), F.round(al.expected_tables(c.cast("double"), 0.5, 2.0), 3).alias("expected"))


@query("""WITH d AS (SELECT user_id AS dish, event_type AS tab, count(*) AS size FROM events GROUP BY ALL), a AS (SELECT sum(size)::DOUBLE AS c, count(*)::DOUBLE AS t, sum(lgamma(size - 0.5) - lgamma(0.5)) AS seats FROM d)
    SELECT round(lgamma(2.0) - lgamma(c + 2) + t * ln(0.5) + lgamma(t + 4) - lgamma(4.0) + seats - 2, 4) AS lp FROM a""")
def pyp_log_prob(t: Tables) -> DataFrame:
    """Users as dishes, each type of event they have as a table"""
    d = t.events.groupBy(F.col("user_id").alias("dish"), "event_type").agg(F.count(F.lit(1)).alias("size"))
    h = d.groupBy("dish", "size").agg(F.count(F.lit(1)).alias("m")).groupBy("dish").agg(F.sum(F.col("size") * F.col("m")).alias("customers"), F.sum("m").alias("tables"), F.map_from_entries(F.collect_list(F.struct("size", "m"))).alias("hist"))
    return al.pyp_log_prob(h, 0.5, 2.0).select(F.round("lp", 4).alias("lp"))


@query()
def pyp_seating(t: Tables) -> DataFrame:
    """A restaurant for each user, dishes are event types"""
    e = t.events.select(F.col("user_id").alias("place"), F.col("event_type").alias("dish"), "event_id")
    return al.seat(e, "place", "event_id", 0.5, 1.0, 0.2, 3)


@query()
def hyper_parameter_draws(t: Tables) -> DataFrame:
    """Slice draws of the discount given the customers and tables of all restaurants, which are sums"""
    s = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.count(F.lit(1))).first()
    c, k = float(s[0] or 1), float(s[1] or 1)
    density = lambda a: k * math.log(a) + math.lgamma(k + 1 / a) - math.lgamma(1 / a) + k * (math.lgamma(c / k - a) - math.lgamma(1 - a)) if 0 < a < 1 and c / k > a else -math.inf
    return t._spark.createDataFrame([(i, x) for i, x in enumerate(al.slice_sample(density, 0.5, 0.001, 0.999, 50, 7))], "draw int, discount double")


_PHRASES = f"{_TURNS}, r AS (SELECT {tok('src')} AS s, {tok('trg')} AS t FROM u), g AS (SELECT s, t, count(*) AS tables FROM r WHERE len(s) > 0 AND len(t) > 0 GROUP BY ALL)"


def phrases(t: Tables) -> DataFrame:
    return turn_pairs(t).select(tx.tokens(F.col("src")).alias("s"), tx.tokens(F.col("trg")).alias("t")).filter("size(s) > 0 AND size(t) > 0").groupBy("s", "t").agg(F.count(F.lit(1)).alias("tables"))


@query(f"WITH {_PHRASES} SELECT md5(array_to_string(s, ' ') || '|' || array_to_string(t, ' ')) AS rule, round(len(s) * ln(3.0) - 3 - lgamma(len(s) + 1) + len(t) * ln(3.0) - 3 - lgamma(len(t) + 1) + (len(s) + len(t)) * ln(0.1) - len(t) * ln(len(s) + 1.0), 5) AS lp FROM g")
def rule_base_measure(t: Tables) -> DataFrame:
    """Whole pairs as rules, a uniform word model"""
    g, n, m = phrases(t), F.size("s"), F.size("t")
    return g.select(F.md5(F.concat(F.array_join("s", " "), F.lit("|"), F.array_join("t", " "))).alias("rule"), F.round(al.rule_base(n, m, (n + m).cast("double"), 3.0, 0.1, -m * F.log(n + 1.0)), 5).alias("lp"))


_SIDE = "SELECT rule, {c}, count(*) AS n{c} FROM (SELECT rule, unnest(list_prepend('<null>', {c})) AS {c} FROM g2) GROUP BY ALL"


@query(f"""WITH {_PHRASES}, g2 AS MATERIALIZED (SELECT md5(array_to_string(s, ' ') || '|' || array_to_string(t, ' ')) AS rule, s, t FROM g), {_links('src', 'trg')}, {_em(0)}, {_em(1)}, {_links('trg', 'src', '_b')}, {_em(0, '_b')}, {_em(1, '_b')},
    x AS MATERIALIZED (SELECT rule, s, t, ns, nt FROM ({_SIDE.format(c='s')}) JOIN ({_SIDE.format(c='t')}) USING (rule)),
    f AS (SELECT rule, sum(nt * ln(z)) AS v FROM (SELECT rule, t, nt, sum(ns * coalesce(p, 0)) AS z FROM x LEFT JOIN p1 USING (s, t) WHERE t <> '<null>' GROUP BY ALL) GROUP BY rule),
    r2 AS (SELECT rule, sum(ns * ln(z)) AS v FROM (SELECT rule, x.s, ns, sum(nt * coalesce(p, 0)) AS z FROM x LEFT JOIN p1_b ON p1_b.s = x.t AND p1_b.t = x.s WHERE x.s <> '<null>' GROUP BY ALL) GROUP BY rule),
    v AS (SELECT (SELECT count(DISTINCT s) - 1 FROM l) AS vs, (SELECT count(DISTINCT s) - 1 FROM l_b) AS vt),
    y AS (SELECT rule, s, t, len(s) * ln(1.0 / vs) + f.v - len(t) * ln(len(s) + 1.0) AS s2t, len(t) * ln(1.0 / vt) + r2.v - len(s) * ln(len(t) + 1.0) AS t2s FROM g2 JOIN f USING (rule) JOIN r2 USING (rule) CROSS JOIN v)
    SELECT rule, round(len(s) * ln(3.0) - 3 - lgamma(len(s) + 1) + len(t) * ln(3.0) - 3 - lgamma(len(t) + 1) + (len(s) + len(t)) * ln(0.1) + greatest(s2t, t2s) + ln(1 + exp(least(s2t, t2s) - greatest(s2t, t2s))) - ln(2.0), 4) AS lp FROM y""")
def rule_base_two_way(t: Tables) -> DataFrame:
    """Whole pairs as rules, with the mean of Model 1 both ways after two rounds each over the pairs' words; words of one side are uniform"""
    p = dealt(turn_pairs(t), "conv_id", "turn").select(tx.tokens(F.col("src")).alias("s"), tx.tokens(F.col("trg")).alias("t"))
    rule = F.md5(F.concat(F.array_join("s", " "), F.lit("|"), F.array_join("t", " ")))
    p = written(p.groupBy("s", "t").agg(F.count(F.lit(1)).alias("times")).withColumn("rule", rule))
    side = lambda a, b: m1.Model1(written(m1.texts(p, F.col(a), F.col(b), F.col("rule"), F.col("times"))), 2, written)
    forward, backward = side("s", "t"), side("t", "s")
    rules = p.filter("size(s) > 0 AND size(t) > 0").select("rule", F.size("s").alias("n"), F.size("t").alias("m")).dropDuplicates(["rule"])
    both = rules.join(forward.scores().select(F.col("id").alias("rule"), F.col("lp").alias("f")), "rule").join(backward.scores().select(F.col("id").alias("rule"), F.col("lp").alias("b")), "rule")
    n, m, ln = F.col("n"), F.col("m"), lambda x: math.log(x) if x else 0.0
    s2t, t2s = F.col("f") - m * F.log(n + 1.0) - n * ln(forward.vocabulary), F.col("b") - n * F.log(m + 1.0) - m * ln(backward.vocabulary)
    return both.select("rule", F.round(al.rule_base(n, m, (n + m).cast("double"), 3.0, 0.1, al.log_mean(s2t, t2s)), 4).alias("lp"))


@query(f"WITH {_PHRASES} SELECT count(*) AS types, round(avg(len(s)), 6) AS src_len, round(avg(len(t)), 6) AS trg_len, round(sum(tables * ln(1 / (1.0 + len(s)))), 4) AS base FROM g")
def grammar_statistics(t: Tables) -> DataFrame:
    """A18"""
    g = al.grammar_stats(phrases(t).withColumn("p0", 1 / (1.0 + F.size("s"))))
    return g.select("types", r6("src_len", "src_len"), r6("trg_len", "trg_len"), F.round("base", 4).alias("base"))


@query(f"WITH {_PHRASES} SELECT len(s)::BIGINT AS len, sum(tables)::BIGINT AS tables FROM g GROUP BY len(s)")
def rule_length_histogram(t: Tables) -> DataFrame:
    """A19"""
    return al.length_histogram(phrases(t)).select(big("len", "len"), big("tables", "tables"))


@query("SELECT k AS iteration, round(CASE WHEN k >= 20 THEN 1.0 ELSE 10 + (1 - 10) * k / 20 END, 6) AS temperature, least(3 + k // 10, 7)::BIGINT AS span FROM range(0, 60) r(k)")
def schedules(t: Tables) -> DataFrame:
    """M17"""
    k = F.col("id")
    return t._spark.range(60).select(k.alias("iteration"), F.round(al.annealing(k, 10.0, 1.0, 20), 6).alias("temperature"), big(al.max_span(k, 3, 10, 7), "span"))


@query()
def scfg_corpus(t: Tables) -> DataFrame:
    """Sentence pairs drawn from a small synchronous grammar"""
    g = [("S", ["NP", "VP"], ["VP", "NP"], 1.0), ("NP", ["the", "N"], ["N", "da"], 1.0), ("N", ["cat"], ["neko"], 0.6), ("N", ["dog"], ["inu"], 0.4), ("VP", ["sleeps"], ["nemuru"], 0.5), ("VP", ["runs"], ["hashiru"], 0.5)]
    return t._spark.createDataFrame(al.sampled_sentences(g, 200, 5), "src string, trg string")


def labelled_streams(t: Tables) -> DataFrame:
    d, w = changes(t), W.partitionBy("stream").orderBy("epoch")
    x = F.array("x", F.coalesce(F.lag("x", 1).over(w), F.lit(0.0)), F.coalesce(F.lag("x", 2).over(w), F.lit(0.0)))
    return d.select("stream", "epoch", x.alias("xs"), (F.coalesce(F.lead("x").over(w), F.lit(0.0)) > 0).cast("int").alias("label"), (F.row_number().over(W.partitionBy("stream").orderBy(F.desc("epoch"))) <= 8).alias("is_test")).withColumnRenamed("xs", "x")


def _streams(t: Tables) -> list[str]:
    return [r[0] for r in t.events.select("event_type").distinct().orderBy("event_type").collect()]  # a row for each type of event


@query()
def stream_logistic(t: Tables) -> DataFrame:
    """M27"""
    return le.stream_classifiers(labelled_streams(t), _streams(t), "logistic")


@query()
def stream_forest(t: Tables) -> DataFrame:
    """M28"""
    return le.stream_classifiers(labelled_streams(t), _streams(t), "forest")


@query()
def walk_forward(t: Tables) -> DataFrame:
    """Fitted on the epochs before a step, applied to the next seven, up to the last epoch"""
    rows = labelled_streams(t).drop("is_test")
    last = rows.agg(F.max("epoch")).first()[0] or 0
    return le.walk_forward(rows, list(range(16, max(last, 16) + 1, 7)), 7)


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE, 5)::DECIMAL(18, 5)::VARCHAR), ' ') AS features, label::BIGINT AS label FROM embeddings")
def feature_dump(t: Tables) -> DataFrame:
    """All features first, the label last"""
    return t.embeddings.select("vec_id", le.dump_line(F.col("embedding")).alias("features"), big("label", "label"))
