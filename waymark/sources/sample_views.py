"""The engine's inputs derived from the test tables.

Each view is a set of column expressions that Spark SQL and DuckDB both run
as written (``TEXT`` stands for the engine's string type), so the SQL check
starts from the same rows. Real deployments read their own tables instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Q = "chr(39)"

BUSINESS = {
    "id": "p_partkey",
    "business_id": "'b' || CAST(p_partkey AS TEXT)",
    "name": "p_name",
    "address": "CAST(p_size AS TEXT) || ' Main St'",
    "city": "'City' || CAST(p_partkey % 20 AS TEXT)",
    "state": "CASE p_partkey % 8 WHEN 0 THEN 'PA' WHEN 1 THEN 'FL' WHEN 2 THEN 'TN' WHEN 3 THEN 'IN' "
    "WHEN 4 THEN 'MO' WHEN 5 THEN 'CA' WHEN 6 THEN 'NV' ELSE 'AZ' END",
    "postal_code": "CAST(10000 + p_partkey % 500 AS TEXT)",
    "latitude": "27.9 + CAST(p_partkey * 37 % 1000 AS DOUBLE) / 5000",
    "longitude": "-82.5 + CAST(p_partkey * 91 % 1000 AS DOUBLE) / 5000",
    "stars": "1 + CAST(p_size % 9 AS DOUBLE) / 2",
    "review_count": "CAST(p_partkey % 300 AS INT)",
    "is_open": "p_partkey % 10 <> 0",
    "categories": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type || ', ' || p_brand || ', ' || p_type END",
    "attributes": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE '{\"WiFi\": \"u' || Q || "
    "CASE WHEN p_size % 3 = 0 THEN 'none' ELSE 'free' END || Q || '\", \"BikeParking\": \"' || "
    "CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END || '\", ' || "
    "CASE WHEN p_partkey % 5 = 0 THEN '\"RestaurantsPriceRange2\": \"' || CAST(p_size % 4 + 1 AS TEXT) || '\", ' "
    "ELSE '' END || '\"Ambience\": \"{' || Q || 'romantic' || Q || ': False, ' || Q || 'casual' || Q || "
    "': True, u' || Q || 'hipster' || Q || ': None}\"}' END",
    "hours": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE '{\"Monday\": \"' || CAST(p_size % 4 + 7 AS TEXT) || "
    "':0-22:0\", \"Sunday\": \"0:0-0:0\"}' END",
}

REVIEW = {
    "business_id": "'b' || CAST(l_partkey AS TEXT)",
    "user_id": "'u' || CAST(o_custkey AS TEXT)",
    "stars": "CAST(l_linenumber % 5 + 1 AS DOUBLE)",
    "date": "l_shipdate",
}

USER = {
    "user_id": "'u' || CAST(c_custkey AS TEXT)",
    "name": "c_name",
    "categories": "' ' || c_mktsegment || ',Brand#' || CAST(c_custkey % 25 + 1 AS TEXT)",
    "city": "CASE WHEN c_custkey % 9 = 0 THEN 'Nowhere' ELSE 'City' || CAST(c_custkey % 20 AS TEXT) END",
    "state": BUSINESS["state"].replace("p_partkey", "c_custkey"),
    "place": "CASE c_custkey % 5 WHEN 0 THEN 'Tampa, FL' WHEN 1 THEN 'downtown philadelphia pa' "
    "WHEN 2 THEN 'somewhere in Nevada' WHEN 3 THEN 'Reno NV' ELSE 'St. Louis (MO)' END",
}

# The conversations hold invented prose without any feedback phrase, so one
# is appended to each user message by a rule on its position.
CHAT = {
    "conv_id": "conv_id",
    "turn": "turn",
    "role": "role",
    "user_id": "'u' || CAST(conv_id - conv_id % 3 AS TEXT)",
    "text": "CASE WHEN role <> 'user' THEN text ELSE text || CASE (conv_id + turn) % 6 "
    "WHEN 1 THEN ' I like it' WHEN 2 THEN ' show me another one' WHEN 3 THEN ' Not a fan' "
    "WHEN 4 THEN ' Great, perfect!' ELSE '' END END",
    "wish": "text || CASE (conv_id + turn) % 4 WHEN 0 THEN ' Any brand#' || CAST(conv_id % 25 + 1 AS TEXT) || "
    "' near CITY' || CAST(turn % 20 AS TEXT) || '?' WHEN 1 THEN ' Economy, please.' "
    "WHEN 2 THEN ' What is in city' || CAST(conv_id % 20 AS TEXT) || ' or city1?' ELSE '' END",
    "city": "CASE WHEN conv_id % 9 = 0 THEN 'Nowhere' ELSE 'City' || CAST(conv_id % 20 AS TEXT) END",
    "state": BUSINESS["state"].replace("p_partkey", "conv_id"),
}

# Number of results that a user message would get as a search, and the
# business at each rank. A message that names a place gets none.
N_RESULTS = "CASE WHEN (conv_id + turn) % 4 = 2 THEN 0 ELSE (conv_id * 3 + turn * 5) % 5 END"
RESULT_ID = "(conv_id * 131 + turn * 17 + result_rank * 7919) % n_business"

# Queries reuse the stored vectors; business vectors are stretched by a
# factor per row so that L2 and cosine rank differently.
STRETCH = "1 + CAST(id % 5 AS DOUBLE) / 4"
MESSAGE_VECTOR_ID = "(conv_id * 7 + turn) % n_vectors"
FOLLOW_UP_VECTOR_ID = "(conv_id * 7 + turn + 13) % n_vectors"
USER_VECTOR_ID = "(c_custkey * 3 + 1) % n_vectors"


def render(expression: str, text_type: str) -> str:
    return expression.replace("TEXT", text_type).replace(" Q ", f" {Q} ")


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(render(sql, "STRING")).alias(name) for name, sql in columns.items()])


class SampleViews:
    """Lazy views over one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def business(self) -> DataFrame:
        return _project(self.table("part"), BUSINESS)

    def review(self) -> DataFrame:
        items, orders = self.table("lineitem"), self.table("orders")
        return _project(items.join(orders, items.l_orderkey == orders.o_orderkey), REVIEW)

    def user(self) -> DataFrame:
        return _project(self.table("customer"), USER)

    def chat(self) -> DataFrame:
        return _project(self.table("conversations"), CHAT)

    def _rows(self, name: str):
        return self.table(name).agg(F.count("*")).scalar()

    def vectors(self) -> DataFrame:
        """As they are stored; what computes with them does so in double precision."""
        return self.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))

    def vector_width(self):
        """The number of components of the stored vectors, as a subquery."""
        return self.table("embeddings").agg(F.max(F.size("embedding"))).scalar()

    def business_vectors(self) -> DataFrame:
        """business_id, vector, latitude, longitude for every business.

        The factor is worked out before the join, once per row. Businesses are
        spread by their vector first: a small file is one task to read, and
        stretching its vectors is most of the work."""
        return (
            self.business()
            .withColumn("vec_id", F.col("id") % self._rows("embeddings"))
            .withColumn("stretch", F.expr(STRETCH))
            .repartition("vec_id")
            .join(self.vectors(), "vec_id")
            .select(
                "business_id",
                "latitude",
                "longitude",
                F.transform("vector", lambda x: x * F.col("stretch")).alias("vector"),
            )
        )

    def results(self) -> DataFrame:
        """Result list of every user message: conv_id, turn, rank, business_id."""
        messages = self.table("conversations").filter("role = 'user'")
        return (
            messages.withColumn("n_results", F.expr(N_RESULTS))
            .filter("n_results > 0")
            .withColumn("result_rank", F.explode(F.sequence(F.lit(1), F.col("n_results").cast("int"))))
            .withColumn("n_business", self._rows("part"))
            .select(
                "conv_id",
                "turn",
                F.col("result_rank").alias("rank"),
                F.concat(F.lit("b"), F.expr(RESULT_ID).cast("string")).alias("business_id"),
            )
        )

    def place_messages(self) -> DataFrame:
        """User messages; every second one names the second place found two
        turns before, half of these with results of their own."""
        shown = (
            self.results()
            .filter("rank = 2")
            .join(self.business().select("business_id", "name"), "business_id")
            .select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("name").alias("shown_name"))
        )
        talk = self.table("conversations").filter("role = 'user'")
        named = F.expr("(conv_id + turn) % 2 = 0") & F.col("shown_name").isNotNull()
        return talk.join(shown, ["conv_id", "turn"], "left").select(
            "conv_id",
            "turn",
            F.when(named, F.concat("text", F.lit(" take me to "), F.upper("shown_name")))
            .otherwise(F.col("text"))
            .alias("text"),
        )

    def _with_vector(self, df: DataFrame, vector_id: str) -> DataFrame:
        # Spread first, as the businesses are: what follows is not left to the one task that reads a small file.
        return (
            df.withColumn("n_vectors", self._rows("embeddings"))
            .withColumn("vec_id", F.expr(vector_id))
            .repartition("vec_id")
            .join(self.vectors(), "vec_id")
            .drop("vec_id", "n_vectors")
        )

    def message_queries(self, vector_id: str = MESSAGE_VECTOR_ID) -> DataFrame:
        """One search per user message: query_id, conv_id, turn, text, city, state, vector."""
        asked = self.chat().filter("role = 'user'").withColumn(
            "query_id", F.expr("conv_id || '-' || turn")
        )
        return self._with_vector(asked, vector_id).select(
            "query_id", "conv_id", "turn", "text", "city", "state", "vector"
        )

    def follow_up_queries(self) -> DataFrame:
        return self.message_queries(FOLLOW_UP_VECTOR_ID)

    def preference_queries(self) -> DataFrame:
        """One search per user with preferences: query_id is the user."""
        return self._with_vector(self.table("customer"), USER_VECTOR_ID).select(
            F.expr(render(USER["user_id"], "STRING")).alias("query_id"),
            F.expr(render(USER["city"], "STRING")).alias("city"),
            F.expr(render(USER["state"], "STRING")).alias("state"),
            "vector",
        )
