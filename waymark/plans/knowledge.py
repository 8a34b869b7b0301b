"""Documents, metadata and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import semistructured as S
from waymark.operators import attributes as A
from waymark.operators import dedupe, documents, embed
from waymark.plans.curation import category_attributes, engineered
from waymark.sources.sample_views import SampleViews


def typed_attributes(v: SampleViews) -> DataFrame:
    """Typed values of the flattened attributes, before the clean-up drops any."""
    objects = A.regroup(A.flatten(v.business()))
    return documents.typed_attributes(objects).select(
        "business_id", F.col("name").alias("attribute_name"), "kind", "value"
    )


def _prose(v: SampleViews) -> DataFrame:
    return documents.prose(engineered(v))


def attr_prose(v: SampleViews) -> DataFrame:
    return _prose(v).select("business_id", "attribute_text")


def hours_prose(v: SampleViews) -> DataFrame:
    return _prose(v).select("business_id", "hours_text")


def combined_text(v: SampleViews) -> DataFrame:
    return _prose(v).select("business_id", "name", "city", "state", "combined_text")


def kb_doc_v1(v: SampleViews) -> DataFrame:
    return documents.kb_v1(category_attributes(v)).select("business_id", "document")


def kb_doc_v2(v: SampleViews) -> DataFrame:
    return documents.kb_v2(engineered(v)).select("business_id", "document")


def kb_metadata(v: SampleViews) -> DataFrame:
    return documents.kb_v2(engineered(v)).select("business_id", "metadata")


def kb_metadata_v1(v: SampleViews) -> DataFrame:
    return documents.kb_v1(category_attributes(v)).select("business_id", "metadata")


def knowledge_base(v: SampleViews) -> DataFrame:
    """id, document, metadata and vector, one row per business."""
    # Every column decides in the end, so that copies of an id do not tie.
    whole = engineered(v)
    rest = F.xxhash64(*(F.to_json(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in whole.dtypes))
    rows = dedupe.keep_first(whole, "business_id", F.asc("id"), rest.asc())
    docs = documents.kb_v2(rows).withColumnRenamed("business_id", "id")
    return embed.embed_words(docs, "document")


def embedding_rows(v: SampleViews) -> DataFrame:
    """The embedding table: business fields, combined text, vector as text."""
    rows = embed.embed_words(_prose(v).drop("attribute_text", "hours_text"), "combined_text", "embedding")
    return rows.withColumn("embedding", S.vector_to_text(F.col("embedding")))


def _weights(vectors: DataFrame, key: str) -> DataFrame:
    """Non-zero weights as rows; zeros are dropped before they become rows."""
    numbered = F.transform("vector", lambda w, i: F.struct(i.alias("bucket"), w.alias("weight")))
    rows = vectors.select(key, F.inline(F.filter(numbered, lambda e: e["weight"] != 0)))
    return rows.withColumn("weight", F.round("weight", 6))


def hash_embed(v: SampleViews) -> DataFrame:
    """Non-zero weights of every document's vector."""
    return _weights(embed.embed_words(v.table("documents").select("doc_id", "text"), "text"), "doc_id")


def business_embed(v: SampleViews) -> DataFrame:
    """Non-zero weights of the combined business texts."""
    texts = _prose(v).select("business_id", "combined_text")
    return _weights(embed.embed_words(texts, "combined_text"), "business_id")


def vector_text(v: SampleViews) -> DataFrame:
    """Stored vectors to text and back, value by value."""
    stored = v.table("embeddings")
    dim = stored.select(F.size("embedding").alias("dim")).first()["dim"]
    text = S.vector_to_text(F.col("embedding"))
    return (
        stored
        .select("vec_id", S.text_to_vector(text, dim).alias("vector"))
        .select("vec_id", F.posexplode("vector").alias("position", "value"))
        .withColumn("value", F.round(F.col("value").cast("double"), 6))
    )
