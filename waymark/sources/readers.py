"""Scans: CSV, raw JSON, JSON normalisation, file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUSINESS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("business_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("postal_code", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("stars", T.DoubleType()),
        T.StructField("review_count", T.IntegerType()),
        T.StructField("is_open", T.BooleanType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("categories", T.StringType()),
        T.StructField("hours", T.StringType()),
    ]
)

# Blanks at the edges of a cell belong to it; NULL is \\N, "" an empty text.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    on_error: str = "FAILFAST",
    multi_line: bool = False,
) -> DataFrame:
    """Header skipped, cells optionally quoted, doubled quotes inside a cell.

    A malformed row ends the load, as a bulk copy does, whatever columns are
    asked for; pass ``PERMISSIVE`` or ``DROPMALFORMED`` for the other choices.
    ``multi_line`` lets a quoted cell hold line breaks; a file is then read by
    one task, so write many files.
    """
    rows = spark.read.schema(schema).options(**CSV_OPTIONS).option("mode", on_error)
    return _whole_rows(rows.option("multiLine", str(multi_line).lower()).csv(path))


def _whole_rows(df: DataFrame) -> DataFrame:
    """The same rows with every column needed for each of them, so that no
    pruning keeps a bad cell from being seen. The condition always holds."""
    return df.where(F.pmod(F.xxhash64(*(F.col(f"`{name}`") for name in df.columns)), F.lit(2)) < 2)


def read_raw_json(spark: SparkSession, path: str, column: str = "raw") -> DataFrame:
    """One VARIANT column per record, no schema needed."""
    return spark.read.option("singleVariantColumn", column).json(path)


def normalize_json(raw: DataFrame, schema: str | T.StructType, column: str = "raw") -> DataFrame:
    """Nested records to flat columns with dotted names.

    The schema is given, or taken from :func:`infer_variant_schema`.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    typed = F.from_json(F.to_json(F.col(column)), schema)

    def leaves(fields: T.StructType, path: tuple[str, ...]):
        for field in fields.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    parsed = raw.select(typed.alias("record"))
    return parsed.select(
        *[
            F.col("record." + ".".join(f"`{p}`" for p in path)).alias(".".join(path))
            for path in leaves(schema, ())
        ]
    )


def infer_variant_schema(raw: DataFrame, column: str = "raw") -> T.StructType:
    """Schema of all records, from one distributed pass. Returns to the
    driver as a single DDL string."""
    ddl = raw.agg(F.schema_of_variant_agg(F.col(column)).alias("ddl")).first()["ddl"]
    body = ddl.removeprefix("OBJECT<").removesuffix(">")
    return T.StructType.fromDDL(body.replace("OBJECT<", "STRUCT<"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File listing: path, bytes, modification time. File content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("bytes"), "modificationTime")
    )
