"""One query for each operator over its whole table, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcount.llm import ann, bpe, exact_dedup, filter_audit, hilbert, jaccard_join, lexical, line_dedup, mixing, pivot_dedup, quality, secrets, url_filter
from loomcount.llm.common import table

#: The rules that op10 judges by.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_gone").cast("long").alias("n_deleted"), "text")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup.DigestIndex(spark).ingest_all(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = hilbert.assign(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_counts(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), bpe.DIGESTS)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in URL_RULES) + " AS t(host, path, verdict)")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.join(table(spark, sf_dir, "embeddings"))


#: What ends a term of op11.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_classifier, op3_line_dedup, op4_exact_dedup, op5_nearest_neighbours, op6_hilbert_sharding, op7_jaccard_join, op7_jaccard_links, op8_bpe, op9_mixing, op10_url_filter, op11_lexical_search, op12_filter_audit, op13_embedding_near_dedup)}

ORACLE_SQL = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op7_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        e AS (SELECT doc_id, unnest(s) AS g FROM s),
        f AS (SELECT e.doc_id, e.g FROM e JOIN (SELECT g FROM e GROUP BY g HAVING count(*) > 1) USING (g)),
        n AS (SELECT doc_id, len(s) AS n_shingles FROM s),
        l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM f x JOIN f y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
              JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n_shingles + q.n_shingles - c)),
        r AS (SELECT doc_id, doc_id AS to_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id)
        SELECT doc_id, n_shingles, component_id FROM n JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id) USING (doc_id)""",
    "op10_url_filter": f"""
        WITH r(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        u AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
                     coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        f AS (SELECT u.*, r.host || r.path AS rule, r.verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, r.verdict DESC) AS k
              FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1""",
    "op11_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS t FROM documents),
        i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS t FROM benchmark),
        q AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(t) AS term FROM i) GROUP BY ALL),
        f AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(t) AS term FROM d) GROUP BY ALL),
        a AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
        w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), a),
        s AS (SELECT iid, uid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(t) * n) // l))))::BIGINT AS score
              FROM q JOIN f USING (term) JOIN w USING (term) JOIN d USING (uid), a GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s JOIN d USING (uid) JOIN i USING (iid) WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
    "op12_filter_audit": r"""
        WITH b AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
        w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS low FROM b),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) AS c,
                     regexp_matches(x, '[#$%&*|]') AS d, coalesce(doc_id > low, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
        h AS (SELECT part, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
        f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        k AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, range(1, 6) AS g(step)),
        c AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS hit, len(list_filter(str_split(before, ''), lambda y: fails[y])) > 0 AS gone,
                     len(list_filter(map_values(fails), lambda y: y)) AS hits FROM h, k),
        r AS (SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
                     sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN hit AND hits = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                     sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM c GROUP BY ALL)
        SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
    "op13_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS uid, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        u AS (SELECT * FROM v WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
        l AS (SELECT a.uid AS a, b.uid AS b FROM u a JOIN u b ON a.uid <> b.uid AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
        r AS (SELECT uid, uid AS to_uid FROM v UNION SELECT r.uid, l.b FROM r JOIN l ON l.a = r.to_uid),
        c AS (SELECT r.uid, min(v.vec_id) AS component_id FROM r JOIN v ON v.uid = r.to_uid GROUP BY r.uid),
        n AS (SELECT a AS uid, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (uid) LEFT JOIN n USING (uid)""",
}
