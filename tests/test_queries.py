"""Queries against their SQL on the smallest tables, and the registry."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = [
    "validate_ledger", "dedup_ledger", "latest_version", "entity_lookup", "pit_sender_totals", "pit_receiver_totals", "pit_window_counts", "pit_prior_history", "pit_inflows", "regime_limits", "next_deadline", "register_lookup",
    "reconcile_filings", "cumulative_limit", "rule_fan_in_burst", "rule_donor_concentration", "features_donor", "features_pair", "alerts_fan_out", "typ_smurfing", "average_precision", "threshold_choice", "fairness_groups", "psi", "stream_score", "coverage_weights",
    "score_batch", "alert_versions", "rescore_history", "label_checks", "latest_labels", "retraining", "score_reasons", "classifier_reasons", "reputation_scores", "review_states", "drift_findings", "label_balance", "selection_rates",
    "affiliation_verdict", "fairness_verdict", "limits_by_rules", "rules_in_force", "coverage_admit", "coverage_sources", "coverage_retracted", "stream_fan_in", "alerts_all", "local_cluster", "cramers_v",
]


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(os.path.join(entry.ROOT, "__spark_entry__.py"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
