"""Scalar, string and count queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcount.functions import special as sp
from loomcount.functions import text as tx
from loomcount.operators import ngrams as ng
from loomcount.plans.registry import Tables, big, query, r6
from loomcount.plans.sqltext import PADDED, TOKENS, grams, tok

_EACH = lambda n: f"SELECT doc_id, lang, source, {n} AS ord, unnest({grams('w', n)}) AS gram FROM w"


@query("SELECT page_id, trim(url, 'htps:/') AS both_, ltrim(url, 'htps:/') AS left_, rtrim(url, '0123456789/') AS right_ FROM pages")
def trim_charset(t: Tables) -> DataFrame:
    """F01"""
    return t.pages.select("page_id", tx.trim_set(F.col("url"), "htps:/").alias("both_"), F.ltrim("url", F.lit("htps:/")).alias("left_"), F.rtrim("url", F.lit("0123456789/")).alias("right_"))


@query("SELECT page_id, array_to_string(list_filter(string_split_regex(url, '[/:.?&=#]'), lambda x: x <> ''), '|') AS parts FROM pages")
def split_delimiter_set(t: Tables) -> DataFrame:
    """F02"""
    return t.pages.select("page_id", F.array_join(tx.split_set(F.col("url"), "/:.?&=#"), "|").alias("parts"))


@query("""SELECT doc_id, len(p) AS parts, array_to_string(p[:4], '|') AS head FROM (SELECT doc_id, CASE WHEN list_last(p) = '' THEN p[:-2] ELSE p END AS p
          FROM (SELECT doc_id, string_split(text, 'th') AS p FROM documents))""")
def split_multichar(t: Tables) -> DataFrame:
    """F03"""
    p = tx.split_multi(F.col("text"), "th")
    return t.documents.select("doc_id", big(F.size(p), "parts"), F.array_join(F.slice(p, 1, 4), "|").alias("head"))


@query("""SELECT page_id, list_sum(list_transform(p, lambda x: coalesce(TRY_CAST(x AS BIGINT), 0)))::BIGINT AS total, len(list_filter(p, lambda x: TRY_CAST(x AS BIGINT) IS NULL)) AS bad
          FROM (SELECT page_id, list_filter(string_split_regex(url, '[^0-9a-z]'), lambda x: x <> '') AS p FROM pages)""")
def split_numbers(t: Tables) -> DataFrame:
    """F04"""
    p = tx.numbers(F.filter(F.split("url", "[^0-9a-z]"), lambda x: x != ""), "bigint")
    return t.pages.select("page_id", F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("total"), big(F.size(F.filter(p, lambda x: x.isNull())), "bad"))


@query("SELECT conv_id, turn, md5(lower(text)) AS low, md5(upper(lower(role))) AS up FROM conversations")
def change_case(t: Tables) -> DataFrame:
    """F05"""
    return t.conversations.select("conv_id", "turn", F.md5(F.lower("text")).alias("low"), F.md5(F.upper(F.lower("role"))).alias("up"))


@query(f"WITH {TOKENS} SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS joined FROM w")
def tokens_stripped(t: Tables) -> DataFrame:
    """F07"""
    w = tx.tokens(F.col("text"))
    return t.documents.select("doc_id", big(F.size(w), "n"), F.md5(F.array_join(w, " ")).alias("joined"))


_VOCAB = """v AS (SELECT word, row_number() OVER (ORDER BY d, pos) + 2 AS id FROM (SELECT word, min(d) AS d, arg_min(pos, d * 1000000 + pos) AS pos FROM
    (SELECT doc_id AS d, unnest(range(len(w))) AS pos, unnest(w) AS word FROM w) GROUP BY word))"""


@query(f"WITH {TOKENS}, {_VOCAB} SELECT word, id FROM v")
def vocab_first_seen(t: Tables) -> DataFrame:
    """F08, S28"""
    return ng.vocabulary(t.documents)


@query(f"""WITH {TOKENS}, k AS (SELECT DISTINCT unnest(w) AS word FROM w WHERE lang = 'en'),
    b AS (SELECT lang, unnest(w) AS word FROM w)
    SELECT lang, count(*) AS words, count(*) FILTER (k.word IS NULL) AS oov, round(count(*) FILTER (k.word IS NULL) / count(*), 6) AS rate FROM b LEFT JOIN k USING (word) GROUP BY lang""")
def oov_rate_by_lang(t: Tables) -> DataFrame:
    """A closed vocabulary of English words"""
    words = t.documents.select("lang", F.explode(tx.tokens(F.col("text"))).alias("word"))
    known = words.filter("lang = 'en'").select("word").distinct().withColumn("id", F.lit(1))
    got = words.groupBy("lang", "word").count().join(known, "word", "left").withColumn("oov", F.when(F.coalesce("id", F.lit(0)) == 0, F.col("count")).otherwise(0))
    return got.groupBy("lang").agg(big(F.sum("count"), "words"), big(F.sum("oov"), "oov"), r6(F.sum("oov") / F.sum("count"), "rate"))


@query(f"WITH {TOKENS} SELECT doc_id, len({PADDED}) AS n, array_to_string(({PADDED})[1:3], ' ') AS head, list_last({PADDED}) AS last FROM w")
def sentence_padding(t: Tables) -> DataFrame:
    """F09"""
    w = tx.padded(tx.tokens(F.col("text")))
    return t.documents.select("doc_id", big(F.size(w), "n"), F.array_join(F.slice(w, 1, 3), " ").alias("head"), F.element_at(w, -1).alias("last"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
    md5(array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10) || '<>', 'g'), '(?is)<title[^>]*>.*?</title>', chr(10) || '<>', 'g'), '<[^>]*>'),
        lambda x: trim(x, ' ')), lambda x: x <> '' AND length(x) < 400 AND regexp_full_match(x, '[A-Za-z0-9\s.,;:!?''"()/_-]+')), ' ')) AS body FROM pages""")
def html_text(t: Tables) -> DataFrame:
    """F10"""
    return t.pages.select("page_id", tx.html_title(F.col("html")).alias("title"), F.md5(tx.html_body(F.col("html"))).alias("body"))


@query("SELECT host, count(*) AS pages FROM (SELECT regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)', 1) AS host FROM pages) GROUP BY host")
def pages_by_host(t: Tables) -> DataFrame:
    """F11, S17"""
    return t.pages.groupBy(tx.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT doc_id, lang FROM documents WHERE contains(text, 'License') OR contains(text, 'idiot') OR contains(text, 'password')")
def keyword_filter(t: Tables) -> DataFrame:
    """F12"""
    return t.documents.filter(tx.has_keyword(F.col("text"), ["License", "idiot", "password"])).select("doc_id", "lang")


_TURNS = """u AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS trg FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def turn_pairs(t: Tables) -> DataFrame:
    a, b = t.conversations.alias("a"), t.conversations.alias("b")
    met = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return met.filter("a.role = 'user' AND b.role = 'assistant'").select("a.conv_id", "a.turn", F.col("a.text").alias("src"), F.col("b.text").alias("trg"))


@query(f"WITH {_TURNS}, n AS (SELECT conv_id, turn, len({tok('src')}) AS s, len({tok('trg')}) AS t FROM u) SELECT conv_id, turn, s, t, s >= 20 OR t >= 20 AS long_, NOT (s >= 40 OR t >= 40) AS pruned FROM n WHERE s >= 20 OR t >= 20 OR NOT (s >= 40 OR t >= 40)")
def sentence_length_filter(t: Tables) -> DataFrame:
    """F13, S22"""
    n = turn_pairs(t).select("conv_id", "turn", big(F.size(tx.tokens(F.col("src"))), "s"), big(F.size(tx.tokens(F.col("trg"))), "t"))
    return n.withColumn("long_", F.expr("s >= 20 OR t >= 20")).withColumn("pruned", F.expr("NOT (s >= 40 OR t >= 40)")).filter("long_ OR pruned")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) AS place FROM documents")
def aligned_shuffle(t: Tables) -> DataFrame:
    """a seeded order that keeps rows whole; numbered by ranges of the hash"""
    from pyspark.sql import Window as W

    rows = t.documents.select("doc_id", F.md5(F.concat(F.lit("9:"), F.col("doc_id").cast("string"))).alias("h")).withColumn("part", F.substring("h", 1, 3))
    before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.row_number().over(W.partitionBy("part").orderBy("h", "doc_id")) + F.col("before")).alias("place"))


@query("""SELECT l_orderkey, l_linenumber, round(ln(exp(ln(l_discount + 0.01)) + exp(ln(l_tax + 0.01))), 6) AS added, CASE WHEN l_discount > l_tax THEN round(ln(l_discount - l_tax), 6) END AS subtracted FROM lineitem""")
def log_add_subtract(t: Tables) -> DataFrame:
    """F15"""
    d, x = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(sp.log_add(F.log(d + 0.01), F.log(x + 0.01)), "added"),
        F.when(d > x, F.round(sp.log_subtract(F.log(F.nullif(d, F.lit(0.0))), F.coalesce(F.log(F.nullif(x, F.lit(0.0))), F.lit(-1e9))), 6)).alias("subtracted"))


@query("SELECT event_id, round(power(10, -value / 100), 6) AS prob, round(power(10, value / 100), 6) AS ppl, round(1 / (1 + exp(-value / 50)), 6) AS logit FROM events")
def log_probabilities(t: Tables) -> DataFrame:
    """F16, F17"""
    v = F.col("value")
    return t.events.select("event_id", r6(sp.log_to_prob(-v / 100), "prob"), r6(sp.log_to_perplexity(-v / 100), "ppl"), r6(sp.logistic(v / 50), "logit"))


@query("SELECT n::BIGINT AS n, k::BIGINT AS k, round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)), 0) AS ways FROM range(1, 31) a(n), range(0, 31) b(k) WHERE k <= n")
def binomial_coefficients(t: Tables) -> DataFrame:
    """F18"""
    s = t._spark
    n = s.range(1, 31).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("id"))).alias("k"))
    return n.select("n", "k", F.round(sp.choose(F.col("n").cast("double"), F.col("k").cast("double")), 0).alias("ways"))


_DIGAMMA = "(ln(z) - 0.5 / z - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6) + 1 / (240 * z ** 8) - 5 / (660 * z ** 10) - (1 / x + 1 / (x + 1) + 1 / (x + 2) + 1 / (x + 3) + 1 / (x + 4) + 1 / (x + 5) + 1 / (x + 6)))"


@query(f"SELECT p_partkey, round({_DIGAMMA}, 6) AS psi, round(lgamma(x), 6) AS lg FROM (SELECT p_partkey, p_size / 10.0 AS x, p_size / 10.0 + 7 AS z FROM part)")
def digamma_lgamma(t: Tables) -> DataFrame:
    """F19"""
    x = F.col("p_size") / 10.0
    return t.part.select("p_partkey", r6(sp.digamma(x), "psi"), r6(sp.lgamma(x), "lg"))


@query("""SELECT p_partkey, round((a - 1) * ln(x) + (b - 1) * ln(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b), 6) AS beta, round((a - 1) * ln(y) - y / b - lgamma(a) - a * ln(b), 6) AS gamma,
    round((a - 1) * ln(x) + (b - 1) * ln(1 - x) - lgamma(a) - lgamma(b) + lgamma(a + b), 6) AS dirichlet
    FROM (SELECT p_partkey, p_size / 60.0 AS x, p_size * 1.0 AS y, 1.5 + p_partkey % 5 AS a, 2.5 + p_partkey % 3 AS b FROM part)""")
def log_densities(t: Tables) -> DataFrame:
    """F20"""
    x, y, a, b = F.col("p_size") / 60.0, F.col("p_size") * 1.0, 1.5 + F.col("p_partkey") % 5, 2.5 + F.col("p_partkey") % 3
    return t.part.select("p_partkey", r6(sp.log_beta(x, a, b), "beta"), r6(sp.log_gamma(y, a, b), "gamma"), r6(sp.log_dirichlet([x, 1 - x], [a, b]), "dirichlet"))


@query("""SELECT p_partkey, round(lgamma(n + 1), 6) AS lf, round(power(0.7, n - 1) * 0.3, 6) AS geo, round((n - 1) * ln(0.7) + ln(0.3), 6) AS lgeo, round(exp(n * ln(4.5) - 4.5 - lgamma(n + 1)), 6) AS poi,
    round(exp(-((n - 20) ** 2) / (2 * 9.0)) / sqrt(2 * 3.14159 * 9.0), 6) AS gau FROM (SELECT p_partkey, p_size AS n FROM part)""")
def discrete_densities(t: Tables) -> DataFrame:
    """F21, F22"""
    n = F.col("p_size").cast("double")
    return t.part.select("p_partkey", r6(sp.log_factorial(n), "lf"), r6(sp.geometric(n, F.lit(0.3)), "geo"), r6(sp.log_geometric(n, F.lit(0.3)), "lgeo"), r6(F.exp(sp.log_poisson(n, F.lit(4.5))), "poi"), r6(sp.gaussian(n, F.lit(20.0), F.lit(9.0)), "gau"))


@query("""WITH g AS (SELECT l_linenumber AS k, count(*) FILTER (l_returnflag = 'R') + 1.0 AS a, count(*) FILTER (l_returnflag <> 'R') + 1.0 AS b FROM lineitem GROUP BY l_linenumber),
    s AS (SELECT k, x / 1000.0 AS x, (a - 1) * ln(x / 1000.0) + (b - 1) * ln(1 - x / 1000.0) AS l FROM g, range(100, 1000) r(x))
    SELECT k::BIGINT AS k, arg_max(x, (round(l, 6), -x)) AS best FROM s GROUP BY k""".replace("arg_max(x, (round(l, 6), -x))", "max_by(x, struct_pack(l := round(l, 6), x := -x))"))
def beta_grid_scan(t: Tables) -> DataFrame:
    """most likely grid point of a Beta density"""
    g = t.lineitem.groupBy(big("l_linenumber", "k")).agg((F.count_if(F.col("l_returnflag") == "R") + 1.0).alias("a"), (F.count_if(F.col("l_returnflag") != "R") + 1.0).alias("b"))
    s = g.withColumn("x", F.explode(F.transform(F.sequence(F.lit(100), F.lit(999)), lambda x: x / 1000.0)))
    l = F.round((F.col("a") - 1) * F.log("x") + (F.col("b") - 1) * F.log(1 - F.col("x")), 6)  # noqa: E741
    return s.groupBy("k").agg(F.max_by("x", F.struct(l.alias("l"), (-F.col("x")).alias("x"))).alias("best"))


@query("""SELECT page_id, host, n, round(ln(1 + n), 6) AS w, round(CASE WHEN z <> 0 THEN n / z WHEN n = 0 THEN 1 ELSE 0 END, 6) AS r FROM
    (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, len(regexp_extract_all(html, 'href='))::BIGINT AS n, (page_id % 3)::BIGINT AS z FROM pages)""")
def edge_weight_ratio(t: Tables) -> DataFrame:
    """F26, F27"""
    n = F.size(F.regexp_extract_all("html", F.lit("href="), F.lit(0)))
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), big(n, "n"), r6(F.log1p(n), "w"), r6(sp.ratio(n.cast("double"), (F.col("page_id") % 3).cast("double")), "r"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS self, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm,
    sign(round(list_sum(embedding::DOUBLE[]), 5))::BIGINT AS sgn FROM embeddings""")
def dot_norm_sign(t: Tables) -> DataFrame:
    """F28"""
    e = F.col("embedding")
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.select("vec_id", F.round(sp.dot(e, e), 5).alias("self"), F.round(sp.l2(e), 5).alias("norm"), big(F.signum(F.round(total, 5)), "sgn"))


@query(f"""SELECT item_id, start, len, count(*) AS n FROM (SELECT item_id, unnest(range(1, len(w) + 1)) AS start, w FROM (SELECT item_id, {tok('text')} AS w FROM benchmark)) b, range(1, 5) r(len)
    WHERE start + len - 1 <= len(w) GROUP BY ALL""")
def span_grid(t: Tables) -> DataFrame:
    """F29"""
    w = tx.tokens(F.col("text"))
    return t.benchmark.select("item_id", F.explode(tx.spans(w, 4)).alias("s")).groupBy("item_id", big("s.start", "start"), big("s.len", "len")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, k, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props::JSON)) AS k FROM events) GROUP BY ALL""")
def json_fields(t: Tables) -> DataFrame:
    """F25"""
    return t.events.select("event_type", F.explode(F.json_object_keys("props")).alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOKENS} SELECT lang, ord::BIGINT AS ord, gram, count(*) AS cnt FROM ({_EACH(1)} UNION ALL {_EACH(2)} UNION ALL {_EACH(3)}) GROUP BY lang, ord, gram")
def ngram_counts_by_lang(t: Tables) -> DataFrame:
    """A01, A03"""
    return ng.counts(t.documents, [1, 2, 3], "lang")


@query(f"WITH {TOKENS}, c AS (SELECT gram, count(*) AS cnt FROM ({_EACH(2)}) GROUP BY gram) SELECT * FROM c ORDER BY cnt DESC, gram LIMIT 50 OFFSET 10")
def ngram_topk_offset(t: Tables) -> DataFrame:
    """A top-k report"""
    return ng.top(ng.counts(t.documents, [2]).select("gram", "cnt"), 50, 10)


@query(f"WITH {TOKENS} SELECT source, count(*) FILTER (ord = 1) AS uni, count(*) FILTER (ord = 2) AS bi, count(*) FILTER (ord = 3) AS tri FROM ({_EACH(1)} UNION ALL {_EACH(2)} UNION ALL {_EACH(3)}) GROUP BY source")
def ngrams_by_source_pivot(t: Tables) -> DataFrame:
    """Stream by order"""
    got = ng.exploded(t.documents, tx.tokens(F.col("text")), [1, 2, 3], "source").groupBy("source").pivot("ord", [1, 2, 3]).count()
    return got.select("source", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(n) for k, n in ((1, "uni"), (2, "bi"), (3, "tri"))])


_DAILY = "d AS (SELECT date_trunc('day', ts) AS day, event_type AS gram, count(*) AS cnt FROM events GROUP BY ALL)"


def daily(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("gram")).agg(F.count(F.lit(1)).alias("cnt"))


@query(f"WITH {_DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, gram, cnt FROM d")
def daily_counts(t: Tables) -> DataFrame:
    """A02"""
    return daily(t).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"WITH {_DAILY} SELECT strftime(day, '%Y-%m') AS month, gram, sum(cnt)::BIGINT AS cnt FROM d GROUP BY ALL")
def month_rollup(t: Tables) -> DataFrame:
    """A04"""
    return ng.rolled_up(daily(t).withColumn("month", F.date_format("day", "yyyy-MM")), "month", "gram")


@query(f"""WITH {_DAILY}, s AS (SELECT min(day) AS a FROM d) SELECT (date_diff('day', a, day) // 7)::BIGINT AS week, gram, sum(cnt)::BIGINT AS cnt FROM d, s GROUP BY ALL""")
def week_range_bucket(t: Tables) -> DataFrame:
    """Days fall between the starts of weeks; the bucket key turns the range join into an equi-join"""
    from pyspark.sql import Window as W

    d = daily(t)
    starts = d.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.expr("sequence(a, z, interval 7 days)")).alias("start"))
    weeks = starts.select("start", F.lead("start").over(W.orderBy("start")).alias("stop"), (F.row_number().over(W.orderBy("start")) - 1).alias("week"))  # a row for each week
    keyed = weeks.withColumn("bucket", F.explode(F.expr("sequence(0, 6)"))).withColumn("bucket", F.date_format(F.date_add("start", F.col("bucket")), "yyyy-MM-dd"))
    met = d.withColumn("bucket", F.date_format("day", "yyyy-MM-dd")).join(keyed, "bucket").filter("day >= start AND (stop IS NULL OR day < stop)")
    return met.groupBy(big("week", "week"), "gram").agg(F.sum("cnt").alias("cnt"))


@query(f"WITH {TOKENS} SELECT lang, sum(len(w) + 1)::BIGINT AS size FROM w GROUP BY lang")
def corpus_size_by_lang(t: Tables) -> DataFrame:
    """A06"""
    return ng.corpus_size(ng.counts(t.documents, [1], "lang", pad=True), "lang")


@query(f"""WITH {TOKENS} SELECT lang, source, sum(len(w))::BIGINT AS words, count(*) AS docs FROM w GROUP BY ROLLUP (lang, source)""")
def doc_rollup(t: Tables) -> DataFrame:
    """A08"""
    w = t.documents.select("lang", "source", F.size(tx.tokens(F.col("text"))).alias("n"))
    return w.rollup("lang", "source").agg(big(F.sum("n"), "words"), F.count(F.lit(1)).alias("docs"))


@query(f"""WITH {TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT doc_id, term, round(sqrt(tf) * (1 + ln((SELECT count(*) FROM documents) / df + 1)), 6) AS score FROM tf JOIN df USING (term)""")
def tfidf_terms(t: Tables) -> DataFrame:
    """A11"""
    return ng.tf_idf(t.documents).withColumn("score", F.round("score", 6))


@query(f"""WITH {TOKENS}, c AS (SELECT ord, gram, count(*) AS cnt FROM ({_EACH(2)} UNION ALL {_EACH(3)}) GROUP BY ALL),
    k AS (SELECT ord, regexp_extract(gram, '^(.*) [^ ]*$', 1) AS prefix, count(*) AS kids, count(*) FILTER (cnt = 1) AS once FROM c GROUP BY ALL)
    SELECT ord::BIGINT AS ord, count(*) FILTER (kids > 1) AS more_than_1, count(*) FILTER (kids > 3) AS more_than_3, count(*) FILTER (kids > 10) AS more_than_10, max(kids) AS most, sum(once)::BIGINT AS singletons FROM k GROUP BY ord""")
def trie_level_stats(t: Tables) -> DataFrame:
    """A20"""
    return ng.level_stats(ng.counts(t.documents, [2, 3]))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS med FROM events GROUP BY event_type")
def stream_moments(t: Tables) -> DataFrame:
    """A09"""
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"), r6(F.var_samp("value"), "var"), r6(F.stddev_samp("value"), "sd"), r6(F.median("value"), "med"))


@query("SELECT host, count(*) AS pages FROM (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) WHERE host NOT IN (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) FROM pages WHERE page_id % 2 = 0) GROUP BY host")
def missing_hosts(t: Tables) -> DataFrame:
    """Hosts that half of the pages lack"""
    h = t.pages.select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
    return h.join(h.filter("page_id % 2 = 0").select("host").distinct(), "host", "left_anti").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
