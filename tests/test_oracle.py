"""Registered queries vs their oracle SQL (DuckDB) on the smallest tables. Set
CORPUSLAB_ORACLE_ALL=1 to run every registered query (slow); the default is a quick set."""

import os

from conftest import SF_SMALL
from oracle_check import check

QUICK = ["lm_eval_by_lang", "tokenize", "vocab", "next_pairs", "kgrams", "corpus_lines", "split_exact", "mixture",
         "epoch_metrics", "plateau_lr", "interval_trigger", "config_parse", "corr_matrix", "ols_coef", "box_stats",
         "skyline", "skyline_3d", "summarize_runs", "versioned_summary", "append_summary", "ols_report", "nucleus", "greedy_next", "cosine_knn", "pool_attention", "kgram_counts"]


def test_registered_queries_match_oracle(spark):
    names = None if os.environ.get("CORPUSLAB_ORACLE_ALL") else QUICK
    res = check(spark, names, SF_SMALL, verbose=False)
    bad = {k: v for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))}
    assert not bad, bad


def test_every_query_has_oracle_or_is_declared_rows_only():
    from corpuslab.plans import catalog

    catalog.load_all()
    rows_only = {"cosine_knn_lsh", "tree_attribution", "hull", "gbt_importance", "word2vec", "write_generations", "mlp_kgram", "shapley_rows"}
    missing = set(catalog.QUERIES) - set(catalog.ORACLE)
    assert missing == rows_only
