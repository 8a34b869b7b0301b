"""Every query by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.plans import curation, dialogue, knowledge, recommend, storage
from waymark.sources.sample_views import SampleViews

PLANS: tuple[Callable[[SampleViews], DataFrame], ...] = (
    curation.business_scope,
    curation.business_model,
    curation.category_model,
    curation.category_vocab,
    curation.attribute_model,
    curation.attribute_nested,
    curation.attribute_final,
    curation.attribute_truthful,
    curation.attribute_map,
    curation.attribute_wide,
    curation.filtered_attributes,
    curation.filtered_categories,
    curation.engineered_businesses,
    curation.kb_join,
    curation.table_counts,
    curation.relevant_reviews,
    curation.relevant_users,
    curation.kb_dedupe,
    curation.row_dedupe,
    curation.declared_tests,
    curation.profile_numeric,
    curation.profile_nulls,
    curation.profile_counts,
    curation.dq_unique,
    curation.dq_not_null,
    curation.dq_foreign_key,
    curation.region_supported,
    curation.weekday_hours,
    knowledge.typed_attributes,
    knowledge.attr_prose,
    knowledge.hours_prose,
    knowledge.combined_text,
    knowledge.kb_doc_v1,
    knowledge.kb_doc_v2,
    knowledge.kb_metadata,
    knowledge.kb_metadata_v1,
    knowledge.hash_embed,
    knowledge.business_embed,
    knowledge.vector_text,
    recommend.gazetteer,
    recommend.geo_radius,
    recommend.geo_nearest,
    recommend.knn_l2,
    recommend.knn_ip,
    recommend.knn_cosine,
    recommend.knn_pivots,
    recommend.knn_lsh,
    recommend.search_cli,
    recommend.search_form,
    recommend.search_near,
    recommend.search_global,
    recommend.search_kb,
    recommend.search_followup,
    recommend.followup_best,
    recommend.search_text,
    recommend.search_text_near,
    recommend.search_kb_text,
    recommend.search_presented,
    recommend.prompt_table,
    recommend.prefs_recommend,
    recommend.prefs_text_recommend,
    recommend.user_preferences,
    recommend.preference_lookup,
    dialogue.feedback_class,
    dialogue.feedback_status,
    dialogue.last_item,
    dialogue.next_suggestion,
    dialogue.liked_categories,
    dialogue.liked_from_search,
    dialogue.prefs_upsert,
    dialogue.prefs_register,
    dialogue.intent,
    dialogue.place_mentions,
    dialogue.itinerary_legs,
    dialogue.itinerary_totals,
    dialogue.planning_search,
    dialogue.chat_history,
    storage.csv_roundtrip,
    storage.raw_variant_load,
    storage.json_normalize,
    storage.file_manifest,
    storage.kb_write,
    storage.embedding_table,
    storage.append_write,
    storage.report_csv,
    storage.stream_ingest,
    storage.stream_liked,
)


def _query(plan: Callable[[SampleViews], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(SampleViews(spark, sf_dir))

    run.__name__ = plan.__name__
    run.__doc__ = plan.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {plan.__name__: _query(plan) for plan in PLANS}
