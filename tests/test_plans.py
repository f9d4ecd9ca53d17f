"""What the plans must and must not contain."""

from __future__ import annotations

import pytest
from corpusloom.plans import recipes

SF_DIR = "/root/testdata/sf0.001"
NO_SHUFFLE = ("code_blocks", "code_blocks_js", "line_windows", "paragraph_pack", "token_windows", "token_counts", "html_markdown", "html_struct")

# Running state over lines or tags, and matrix products.
PYTHON = (
    "code_blocks", "code_blocks_js", "chunk_dispatch", "html_markdown", "html_nested", "sitemap_convert", "structured_chunks",
    "vector_topk", "vector_index_topk",
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_row_work_does_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(recipes.QUERIES[name](spark, SF_DIR))


@pytest.mark.parametrize("name", [n for n in recipes.QUERIES if n not in PYTHON])
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(recipes.QUERIES[name](spark, SF_DIR))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, word


def test_only_needed_columns_are_read(spark):
    plan = plan_of(recipes.token_counts(spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_scoring_reads_shelves_and_ranks_inside_tasks(spark):
    plan = plan_of(recipes.search_naive_index(spark, SF_DIR))
    assert "WindowGroupLimit" in plan and "_shelf#" in plan.split("PartitionFilters: [", 1)[1]


def test_relations_need_no_shuffle_by_chunk(spark):
    plan = plan_of(recipes.relation_keywords(spark, SF_DIR))
    assert "Bucketed: false (disabled by query planner)" in plan or "hashpartitioning(chunk_id" not in plan
