"""What the physical plans must and must not contain."""

import pytest

from waymark.operators import conversation
from waymark.plans import curation, recommend
from waymark.plans.registry import queries
from waymark.sources.sample_views import SampleViews

# Joins without an equi key. The sample views divide ids by a table's row
# count through scalar subqueries, so no query needs one.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
EAGER = {"csv_roundtrip", "raw_variant_load", "json_normalize", "kb_write", "append_write", "report_csv", "stream_ingest", "stream_liked", "knn_pivots", "knn_lsh"}


def plan(spark, small, name):
    return queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - EAGER))
def test_no_cross_join_and_no_row_udf(spark, small, name):
    text = plan(spark, small, name)
    assert not [word for word in FORBIDDEN if word in text]


@pytest.mark.parametrize("name", ["relevant_reviews", "relevant_users", "filtered_attributes", "preference_lookup"])
def test_cohorts_are_semi_joins(spark, small, name):
    assert "LeftSemi" in plan(spark, small, name)


@pytest.mark.parametrize("name", ["kb_dedupe", "search_cli", "search_near", "prefs_recommend", "geo_nearest"])
def test_top_rows_are_cut_before_the_shuffle(spark, small, name):
    assert "WindowGroupLimit" in plan(spark, small, name)


def test_scans_read_only_what_they_need(spark, small):
    text = plan(spark, small, "relevant_users")
    assert "l_extendedprice" not in text and "o_totalprice" not in text
    scope = plan(spark, small, "dq_not_null")
    assert "p_name" not in scope.split("ReadSchema")[-1]


def test_attribute_chain_reads_its_table_once(spark, small):
    assert plan(spark, small, "attribute_final").count("FileScan parquet") == 1
    assert plan(spark, small, "attribute_map").count("FileScan parquet") == 1


def test_text_operators_do_not_shuffle(spark, small):
    assert "Exchange" not in plan(spark, small, "hash_embed")
    assert "Exchange" not in plan(spark, small, "attribute_final")


@pytest.mark.parametrize("name", ["chat_history", "feedback_status"])
def test_conversations_are_spread_over_stretches(spark, small, name):
    text = plan(spark, small, name)
    windows = [x for x in text.splitlines() if "Window [" in x and "specifiedwindowframe" in x]
    assert "hashpartitioning(__key" in text and windows


def test_choices_are_worked_out_in_stretches(spark, small):
    v = SampleViews(spark, small)
    results = v.results()
    named = conversation._named(
        v.place_messages(),
        results.select("conv_id", "turn").distinct(),
        results,
        v.business().select("business_id", "name", "latitude", "longitude"),
    )
    text = named._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__key" in text and "WindowGroupLimit" in text


@pytest.mark.parametrize("build", [curation.attribute_wide, recommend.knn_l2, recommend.search_global])
def test_planning_runs_no_job(spark, small, build):
    v = SampleViews(spark, small)
    for name in ("part", "embeddings", "conversations"):
        v.table(name)  # finding a table's schema is a job of its own
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", build.__name__)
    before = len(tracker.getJobIdsForGroup("planning"))
    build(v)
    assert len(tracker.getJobIdsForGroup("planning")) == before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["search_cli", "prefs_recommend", "geo_nearest"])
def test_searches_meet_in_blocks(spark, small, name):
    text = plan(spark, small, name)
    assert "FlatMapCoGroupsInArrow [block" in text and "hashpartitioning(block" in text


@pytest.mark.parametrize("name", ["knn_l2", "knn_cosine", "search_global"])
def test_vectors_move_once(spark, small, name):
    """Without a radius both sides are shuffled to their blocks, and neither again."""
    text = plan(spark, small, name)
    shuffles = [x for x in text.splitlines() if "Exchange hashpartitioning(block" in x]
    assert len(shuffles) == 2 and "CartesianProduct" not in text


def test_a_small_file_does_not_leave_the_vectors_to_one_task(spark, small):
    """Rows are spread before the join that brings their vectors."""
    v = SampleViews(spark, str(small))
    for df, key in ((v.business_vectors(), "id"), (v.message_queries(), "conv_id"), (v.preference_queries(), "c_custkey")):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in text, key


def test_vectors_are_stretched_by_one_factor_per_row(spark, small):
    """The factor comes from below the join, not anew for every component."""
    text = SampleViews(spark, str(small)).business_vectors()._jdf.queryExecution().optimizedPlan().toString()
    stretched = next(line for line in text.splitlines() if "lambdafunction" in line)
    assert "%" not in stretched.split("lambdafunction")[1]
