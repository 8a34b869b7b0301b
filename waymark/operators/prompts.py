"""Result summaries and prompts for a text model (which is not part of this)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary_line(with_distance: bool = True) -> Column:
    """``- Name (categories), City, ST, 4.5 stars, 1.2 km`` for one hit."""
    parts = [
        F.lit("- "), F.coalesce("name", F.lit("")),
        F.lit(" ("), F.coalesce("categories", F.lit("")), F.lit("), "),
        F.coalesce("city", F.lit("Unknown")), F.lit(", "), F.coalesce("state", F.lit("Unknown")),
        F.lit(", "), F.coalesce(F.col("stars").cast("string"), F.lit("?")), F.lit(" stars"),
    ]
    if with_distance:
        parts += [F.lit(", "), F.coalesce(F.col("distance_km").cast("string"), F.lit("?")), F.lit(" km")]
    return F.concat(*parts)


def summaries(presented: DataFrame, sep: str = "\n") -> DataFrame:
    """One text per query with a line per hit, in rank order. A query has as
    many lines as its search keeps results."""
    lines = presented.select("query_id", "rank", summary_line().alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return lines.groupBy("query_id").agg(
        F.count("*").alias("n_hits"),
        F.array_join(F.transform(ordered, lambda e: e["line"]), sep).alias("context"),
    )


INSTRUCTION = "Recommend from the places listed below, warmly and briefly. Use only these places."


def prompt_table(questions: DataFrame, presented: DataFrame) -> DataFrame:
    """Instruction, question and the found places as one prompt per query."""
    return (
        questions.select("query_id", F.col("text").alias("question"))
        .join(summaries(presented), "query_id")
        .select(
            "query_id",
            "n_hits",
            F.concat(
                F.lit(INSTRUCTION), F.lit("\n\nQuestion: "), "question",
                F.lit("\n\nPlaces:\n"), "context", F.lit("\n"),
            ).alias("prompt"),
        )
    )
