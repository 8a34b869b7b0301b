"""The training-data pipeline: documents through five operators in turn.

Each stage takes all that its predecessor kept and returns the columns of
documents; the last one returns the packing. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm import mixing, ngram_join, packing, pii, toxicity
from waymark.llm.shared import materialize, table

VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity machine, trained on the labelled ones, accepts.
    NULL and empty texts are kept."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of documents
    linked by a Jaccard similarity of 0.8 of their five-word n-grams. Rows that
    repeat an id and its text are copies, of which one stays; rows that repeat
    an id with another text are judged on their own. Rows without an id are
    kept."""
    found = ngram_join.similar_documents(docs, size=5, num=4, den=5, links=False, kept=True)
    gone = found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash"))
    hashed = docs.withColumn("__text", ngram_join.text_hash(F.col("text")))
    rest = hashed.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.col("__text") == F.col("__hash")), "left_anti")
    # Ties beyond the text go by all that is left, so that reruns keep the same row.
    same = Window.partitionBy("doc_id", "__text").orderBy(*(F.xxhash64(docs[name]) for name in docs.columns if name != "text"))
    numbered = rest.withColumn("__row", F.row_number().over(same))
    return numbered.where(F.col("doc_id").isNull() | (F.col("__row") == 1)).drop("__row", "__text")


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data; `n_chars` follows the text."""
    done = pii.pseudonymise(docs, pii.session_key(spark))
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast(done.schema["n_chars"].dataType), "n_chars"))
    return done


def _row_key() -> Column:
    """The id, or for rows without one a number made from the text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: left out, once, or up to
    three times. Documents without words are not taken."""
    keyed = docs.withColumn("__key", _row_key())
    amounts = mixing.mix_amounts(keyed, id="__key")
    copies = amounts.groupBy("doc_id").agg(F.max("copies").alias("__copies")).where("__copies > 0")
    taken = keyed.join(copies.withColumnRenamed("doc_id", "__key"), "__key")
    repeated = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*(repeated[name] for name in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents, copies on their own, in sequences of 4096 tokens."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix),
    ("packing", pack),
]

# Training a machine and Feistel networks are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each one's rows are written
    before the next one starts."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
