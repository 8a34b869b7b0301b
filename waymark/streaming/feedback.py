"""Running category preferences from a stream of chat messages.

What the batches leave behind are tables in the shared folder, a part per
micro-batch under its number: the items reacted to, where every conversation
stands, and the category sets of every user. A batch reads the parts of
earlier numbers only and replaces its own, so one that is run again after a
failure changes nothing. Conversations are followed by running sums over
stretches, like a whole log: one of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import conversation as C

# A micro-batch should be bounded in bytes.
BATCH_BYTES = 1024 * 1024 * 1024
# Every so many batches the latest rows of all keys are written together.
WHOLE_EVERY = 64

STANDING = "conv_id long, list_turn long, list_size long, used long"
SETS = "user_id string, liked string, disliked string"
KEPT = "user_id string, feedback string, category string"


class LatestRows:
    """The latest row of every key, kept as the changes of each batch."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/kind=whole/batch=-1")

    def before(self, number: int) -> DataFrame:
        """What batches with smaller numbers left: the last of them to write
        all keys, and the changes since."""
        rows = self.spark.read.schema(f"{self.schema}, kind string, batch long").parquet(self.path)
        rows = rows.where(F.col("batch") < number)
        whole = rows.where("kind = 'whole'").select(F.coalesce(F.max("batch"), F.lit(-1))).scalar()
        rows = rows.where(F.col("batch") >= whole)
        values = [name for name in rows.columns if name not in (self.key, "kind", "batch")]
        latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*values), "batch").alias("latest"))
        return latest.select(self.key, "latest.*")

    def write(self, number: int, rows: DataFrame) -> None:
        """The rows that batch `number` changed, one per key."""
        rows.write.mode("overwrite").parquet(f"{self.path}/kind=changes/batch={number}")
        if number % WHOLE_EVERY == WHOLE_EVERY - 1:
            self.before(number + 1).write.mode("overwrite").parquet(f"{self.path}/kind=whole/batch={number}")


class Feedback:
    """The tables below ``folder``, brought up to date batch by batch.

    ``results``: the hits of every message (conv_id, turn, rank, business_id);
    ``business``: business_id, categories. Messages of a conversation must
    arrive in order across batches.
    """

    def __init__(self, spark: SparkSession, folder: str, results: DataFrame, business: DataFrame):
        self.spark, self.folder, self.results, self.business = spark, folder, results, business
        self.standing = LatestRows(spark, f"{folder}/standing", "conv_id", STANDING)
        self.sets = LatestRows(spark, f"{folder}/sets", "user_id", SETS)

    def take(self, batch: DataFrame, number: int) -> None:
        """One batch of messages: its reactions, then where its conversations
        stand, then the sets of its users."""
        moves = C.cursor(batch.select("conv_id", "turn", "role", "user_id", "text"), self.results, self.standing.before(number))
        moves.drop("text").write.mode("overwrite").parquet(f"{self.folder}/moves/batch={number}")
        moves = self.spark.read.parquet(f"{self.folder}/moves/batch={number}")

        reacted = C.last_item(moves, self.results).select("conv_id", "turn", "user_id", "feedback", "business_id")
        reacted.write.mode("overwrite").parquet(f"{self.folder}/reactions/batch={number}")
        liked = C.category_feedback(reacted, self.business)
        liked.write.mode("overwrite").parquet(f"{self.folder}/categories/batch={number}")

        stands = F.struct(F.col("shown_turn").alias("list_turn"), "list_size", "used")
        last = moves.where("shown_turn is not null").groupBy("conv_id").agg(F.max_by(stands, "turn").alias("last"))
        self.standing.write(number, last.select("conv_id", "last.*"))

        kept = self.spark.read.schema(f"{KEPT}, batch long").parquet(f"{self.folder}/categories")
        kept = kept.where(F.col("batch") <= number).drop("batch")
        users = liked.select("user_id").distinct()
        self.sets.write(number, C.category_sets(kept.join(users, "user_id", "left_semi").distinct()))

    def reactions(self) -> DataFrame:
        """All items reacted to."""
        return self.spark.read.parquet(f"{self.folder}/reactions").drop("batch")

    def preferences(self) -> DataFrame:
        """The sets of every user who reacted to something with a category."""
        return self.sets.before(1 << 62)


def follow(stream: DataFrame, feedback: Feedback) -> None:
    """Takes everything that has arrived, batch by batch; run again it goes on
    where it stopped."""
    query = (
        stream.writeStream.foreachBatch(feedback.take)
        .option("checkpointLocation", f"{feedback.folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
