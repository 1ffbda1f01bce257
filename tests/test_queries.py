import pytest

from tests.oracle import check, connection
from tonelake import queries, queries_files, queries_plans, queries_sources, queries_spectra, queries_vectors

assert queries_files and queries_plans and queries_sources and queries_spectra and queries_vectors


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, con, sf_dir, name):
    check(spark, con, sf_dir, queries.QUERIES[name], queries.ORACLES.get(name))


def test_entry_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    q = lambda name: plan(queries.QUERIES[name](spark, sf_dir))
    page = q("page_by_occurrences")
    assert "TakeOrderedAndProject" in page or "GlobalLimit" in page
    lookup = q("point_lookup")
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,77)]" in lookup and "c_nationkey" not in lookup.split("ReadSchema")[1]
    assert "LeftSemi" in q("in_subquery_semi") and "LeftAnti" in q("orphans_anti")
    for name in ("usage_by_key_rate_note", "dominant_rate", "orphan_cascade", "restore_diff"):
        assert "CartesianProduct" not in q(name) and "NestedLoop" not in q(name)
    for name in ("spearman", "auc"):  # one task takes the partial sums; no window stands before it
        assert "SinglePartition" not in q(name).split("Window", 1)[1]
    for name in ("tag_first_use_rank", "vocabulary_ranks", "vocabulary_tree", "time_map", "token_budgets", "gain_scores", "spectral_grains", "grains_placed"):
        assert "SinglePartition" not in q(name) and "NestedLoop" not in q(name)
    for name in ("rate_folding", "dominant_value", "state_as_of", "label_closure_counts"):
        assert "SinglePartition" not in q(name)
