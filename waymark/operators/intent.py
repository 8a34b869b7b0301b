"""City and category named in a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import bare_words, word_list


def clean_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """(kind, phrase, n_words): terms cleaned the way messages are, so that
    terms with punctuation can be found."""
    words = vocabulary.select("kind", word_list(bare_words(F.col("term"))).alias("words"))
    return (
        words.filter(F.size("words") > 0)
        .select("kind", F.array_join("words", " ").alias("phrase"), F.size("words").alias("n_words"))
        .distinct()
    )


def phrases(messages: DataFrame, lengths: Column) -> DataFrame:
    """Every run of words of the given lengths, once per message."""
    words = F.col("__words")

    def runs(n):
        starts = F.when(
            F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    found = F.array_distinct(F.flatten(F.transform(F.col("__lengths"), runs)))
    return (
        messages.withColumn("__words", word_list(bare_words(F.col("text"))))
        .withColumn("__lengths", lengths)
        .select("conv_id", "turn", F.explode(found).alias("phrase"))
    )


def intent(messages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per message: location, category and whether both are there.

    Whole words only. Of several matches the longest counts, then the first
    in the alphabet. Messages meet the vocabulary in an equi join on the
    phrase; the matches are folded per message before their shuffle.
    """
    known = clean_vocabulary(vocabulary)
    lengths = known.agg(F.array_sort(F.collect_set("n_words"))).scalar()
    hits = phrases(messages, lengths).join(known, "phrase")

    def pick(kind: str):
        hit = F.when(
            F.col("kind") == kind, F.struct(-F.length("phrase"), F.col("phrase").alias("phrase"))
        )
        return F.min(hit)["phrase"]

    best = hits.groupBy("conv_id", "turn").agg(
        pick("city").alias("location"), pick("category").alias("category")
    )
    return (
        messages.select("conv_id", "turn")
        .join(best, ["conv_id", "turn"], "left")
        .withColumn("is_complete", F.col("location").isNotNull() & F.col("category").isNotNull())
    )
