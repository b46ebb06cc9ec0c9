"""Queries against their SQL on the smallest tables, and laws of those without SQL."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from loomcount.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = (
    "tokens_stripped", "split_multichar", "tfidf_terms", "vocab_first_seen", "trie_level_stats", "week_range_bucket", "log_densities", "digamma_lgamma", "backoff_score", "strict_backoff", "lm_mixture_score", "kl_features_by_doc",
    "roc_50", "average_precision", "best_thresholds", "calibration_sliding", "rank_normalise", "interval_cv", "label_delay_split", "asof_boundary", "graph_features", "alignment_aer", "countmin_estimate", "entropy_sampled",
    "adapt_step", "trie_period", "round_robin_streams", "model1_em2", "nb_gaussian_scores", "daily_windows_stream", "daily_windows_closed", "item_lives_stream", "derivation_yields", "derivation_links", "stored_model_scores", "rule_base_two_way", "packed_lengths", "packed_read",
    "sample_moments", "t_test_unequal", "f_test_variances", "mann_whitney", "wilcoxon_signed_rank", "sign_test", "covariance_matrix", "spearman_matrix",
)
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    cell = lambda v: "-" if v is None or v != v else repr(float(v) + 0.0) if not isinstance(v, str) else v
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_its_items_named():
    import loomcount.plans as p

    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 150
    assert p.QUERIES is QUERIES


@needs_data
def test_laws(spark):
    post = QUERIES["ibcc_posteriors"](spark, SF).toPandas()
    assert (post.groupby("epoch")["rho"].sum() - 1).abs().max() < 1e-9
    trace = QUERIES["hmm_training"](spark, SF).toPandas().sort_values("round")["log_likelihood"]
    assert trace.is_monotonic_increasing
    found = QUERIES["bloomier_lookup"](spark, SF).toPandas()
    words = QUERIES["ngram_counts_by_lang"](spark, SF).filter("ord = 1").groupBy("gram").sum("cnt").toPandas()
    met = found.merge(words, on="gram")
    assert len(met) == len(found) and (met["cnt"] == met["sum(cnt)"]).all()
    seats = QUERIES["pyp_seating"](spark, SF).toPandas()
    assert (seats["tables"] <= seats["customers"]).all()
