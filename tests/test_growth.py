"""What must not grow with the tables, or not faster than they: read off plans and counts."""

import pytest

from loomgraph.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["python_constructs", "type_relations", "access_relations", "call_edges", "declaration_usage_edges", "manipulation_edges", "inheritance_edges", "import_edges", "code_construct_triples"])
def test_files_are_parsed_once_and_by_many_tasks(spark, sf, name):
    p = plan(registry.queries()[name](spark, sf))
    assert p.count("MapInArrow") == 1 and "hashpartitioning(p_partkey" in p.split("MapInArrow")[1]


@pytest.mark.parametrize("name", ["commit_issues", "commit_triples"])
def test_commits_are_read_once_and_spread(spark, sf, name):
    p = plan(registry.queries()[name](spark, sf))
    assert p.count("FileScan") == 1 and p.count("Generate") == 1 and "hashpartitioning(o_orderkey" in p and p.count("Exchange") == 2


@pytest.mark.parametrize("name", ["class_counts_all", "class_counts_fused", "materialised_superclasses", "analytics_codebase", "analytics_development", "analytics_entity_distribution", "dashboard"])
def test_instances_are_shuffled_once_by_subject(spark, sf, name):
    """Before their classes above multiply them, not after; the closure is broadcast, so that no class is one task's."""
    p = plan(registry.queries()[name](spark, sf))
    assert "hashpartitioning(s#" in p and "REPARTITION_BY_NUM" in p and "hashpartitioning(sub#" not in p and "hashpartitioning(o#" not in p and "SortMergeJoin [sub" not in p
