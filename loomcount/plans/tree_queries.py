"""Documents as derivations: paragraphs of sentences of words. Sentences with an odd number of words are inverted, so are documents with an even id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcount.functions import text as tx
from loomcount.operators import trees
from loomcount.plans.registry import Tables, big, query
from loomcount.plans.sqltext import tok

_PARTS = f"""p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS pn FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, pn, unnest(string_split_regex(p, '[.!?]')) AS s, generate_subscripts(string_split_regex(p, '[.!?]'), 1) AS sn FROM p),
    w AS (SELECT doc_id, pn, sn, {tok("regexp_replace(s, '[()]', '', 'g')")} AS w FROM s),
    n AS (SELECT doc_id, pn, sn, w, len(w) AS n, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY pn, sn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM w)"""


def derivations(t: Tables) -> DataFrame:
    """doc_id, tree of every document that has a text."""
    words = lambda s: tx.tokens(F.regexp_replace(s, "[()]", ""))
    node = lambda label, kids: F.concat(F.lit("("), label, F.lit(" "), F.array_join(kids, " "), F.lit(")"))
    sentence = lambda w: node(F.when(F.size(w) % 2 == 1, F.lit("<>")).otherwise(F.lit("[]")), w)
    paragraph = lambda p: node(F.lit("P"), F.transform(F.transform(F.split(p, "[.!?]"), words), sentence))
    top = F.when(F.col("doc_id") % 2 == 0, F.lit("<>")).otherwise(F.lit("D"))
    return t.documents.filter("text IS NOT NULL").select("doc_id", node(top, F.transform(F.split("text", "\n"), paragraph)).alias("tree"))


@query(f"""WITH {_PARTS}, a AS (SELECT doc_id, 3 AS level, CASE WHEN n % 2 = 1 THEN '<>' ELSE '[]' END AS label, lo, lo + n AS hi, w AS words FROM n
    UNION ALL SELECT doc_id, 2, 'P', min(lo), max(lo + n), flatten(list(w ORDER BY sn)) FROM n GROUP BY doc_id, pn
    UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 2 = 0 THEN '<>' ELSE 'D' END, 0, max(lo + n), flatten(list(w ORDER BY pn, sn)) FROM n GROUP BY doc_id)
    SELECT doc_id, level::BIGINT AS level, label, lo::BIGINT AS lo, hi::BIGINT AS hi, md5(array_to_string(words, ' ')) AS yield, count(*) AS n FROM a GROUP BY ALL""")
def derivation_yields(t: Tables) -> DataFrame:
    """Every node with the words of its yield"""
    n = trees.nodes(derivations(t), "doc_id", "tree")
    return n.groupBy("doc_id", big("level", "level"), "label", big("lo", "lo"), big("hi", "hi"), F.md5(F.array_join("words", " ")).alias("yield")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PARTS}, q AS (SELECT doc_id, pn, min(lo) AS plo, max(lo + n) AS phi FROM n GROUP BY ALL), d AS (SELECT doc_id, max(phi) AS hi FROM q GROUP BY ALL),
    x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN d.hi - q.phi ELSE q.plo END + lo - plo AS base, lo, n, w FROM n JOIN q USING (doc_id, pn) JOIN d USING (doc_id)),
    y AS (SELECT doc_id, base, lo, n, unnest(w) AS word, unnest(range(0, n)) AS k FROM x)
    SELECT doc_id, (lo + k)::BIGINT AS i, (base + CASE WHEN n % 2 = 1 THEN n - 1 - k ELSE k END)::BIGINT AS j, word FROM y""")
def derivation_links(t: Tables) -> DataFrame:
    """The alignment that a derivation says: source and target place of every word"""
    return trees.alignment(derivations(t), "doc_id", "tree")
