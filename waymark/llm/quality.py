"""Quality rules with risk-controlled thresholds.

Every rule rejects documents whose statistic is above a cutoff. Labelled
documents are dealt into two parts. On the first, the cutoffs of all rules of
a stratum (language) are put in an order: those that reject many bad documents
for each good one come first. On the second, held out, the documents rejected
by any cutoff up to a place in that order are counted together, and an exact
binomial test says whether their share of the good documents may be above the
risk. The tests go along the order and stop at the first that fails, so they
need no correction among themselves (fixed sequence); the error is divided by
the number of strata (Bonferroni). All cutoffs before the stop are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.shared import materialize, only

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

RISK = 0.02  # share of good documents that all rules together may reject, per stratum
ERROR = 0.05  # probability that any stratum breaks that bound
WORTH = 10.0  # a cutoff is tried if it rejects so many times the share of bad documents as of good ones

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_marks",
)
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CUTS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """Rule -> its statistic and the cutoffs tested, lowest first."""
    return {
        "symbols": (_share("n_symbols", "word_chars"), _CUTS),
        "dup_lines": (_share("n_dup_lines", "n_lines"), _CUTS),
        "repeats": (_share("n_repeat_words", "n_words"), _CUTS),
        "upper": (_share("n_upper", "word_chars"), _CUTS),
        "marks": (_share("n_marks", "n_words"), (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.5, 2.0)),
        "long_words": (_share("word_chars", "n_words"), (8.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0)),
    }


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {word: at for at, word in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    codes = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    # Each word number is scattered over 64 bits, each place has its own factor.
    codes ^= codes >> np.uint64(31)
    codes = (codes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(27)
    codes *= np.uint64(0x94D049BB133111EB)
    codes ^= codes >> np.uint64(31)
    keys = np.zeros(n, np.uint64)
    factor = 1
    for at in range(window):
        keys += codes[at : at + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(found)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _counts(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "replace").split()
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    chars = len(text) - sum(map(text.count, _SPACES))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return (
        len(words),
        chars,
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        text.count("!") + text.count("?"),
    )


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Id, stratum and the counts of COUNTS for each row; a NULL text is empty."""
    schema = "doc_id long, stratum string, " + ", ".join(f"{name} long" for name in COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_counts(body.as_py() or "") for body in batch.column(2)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(column, pa.int64()) for column in columns)],
                names=["doc_id", "stratum", *COUNTS],
            )

    rows = only(docs, doc_id=id, stratum=stratum, text=text)
    return rows.select(F.col("doc_id").cast("long"), F.col("stratum").cast("string"), "text").mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    )


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed exactly from its terms."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def _tests() -> Column:
    """All cutoffs of all rules, each with whether the document is over it."""
    return F.array(
        *(
            F.struct(F.lit(name).alias("rule"), F.lit(cut).alias("cutoff"), (statistic > cut).alias("over"))
            for name, (statistic, cuts) in rules().items()
            for cut in cuts
        )
    )


def tried_in_order(picking: DataFrame, worth: float) -> DataFrame:
    """stratum, rule, cutoff, place: the cutoffs worth trying, from 1 on. Rows
    of strata: at most one per cutoff."""
    good, over = F.col("quality") == 1, F.col("test.over")
    counted = (
        picking.select("stratum", "quality", F.explode(_tests()).alias("test"))
        .groupBy("stratum", F.col("test.rule").alias("rule"), F.col("test.cutoff").alias("cutoff"))
        .agg(
            F.count_if(good).alias("n_good"),
            F.count_if(good & over).alias("over_good"),
            F.count_if(~good).alias("n_bad"),
            F.count_if(~good & over).alias("over_bad"),
        )
    )
    # One more of each: few cases prove little.
    for_each = (F.col("over_good") + 1) / (F.col("over_bad") + 1)
    shares = F.col("over_bad") * F.col("n_good") >= worth * F.col("over_good") * F.col("n_bad")
    order = Window.partitionBy("stratum").orderBy("for_each", F.desc("over_bad"), "rule", F.desc("cutoff"))
    worthy = counted.where((F.col("over_bad") > 0) & shares).withColumn("for_each", for_each)
    return worthy.select("stratum", "rule", "cutoff", F.row_number().over(order).alias("place"))


def thresholds(
    measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, worth: float = WORTH
) -> DataFrame:
    """stratum, rule, cutoff: what each stratum may reject by.

    `labels`: doc_id and quality (1 good, 0 bad; others and NULL are left
    out). Documents that fail the base rules are rejected anyway and say
    nothing here. A document is for picking or for certifying by the hash of
    its id. The result has a row per stratum and rule at most.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    rows = measured.where(~base_failed()).join(known, "doc_id").withColumn("stratum", F.coalesce("stratum", F.lit("")))
    certifies = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    tried = materialize(tried_in_order(rows.where(~certifies), worth), "quality-order")
    by_stratum = tried.groupBy("stratum").agg(F.collect_list(F.struct("rule", "cutoff", "place")).alias("order"))
    # Where in the order each good held-out document is first rejected.
    statistics = F.create_map(*(x for name, (statistic, _) in rules().items() for x in (F.lit(name), statistic)))
    over = F.filter("order", lambda test: F.col("statistics")[test.rule] > test.cutoff)
    held = rows.where(certifies & (F.col("quality") == 1)).withColumn("statistics", statistics)
    first = F.array_min(F.transform(over, lambda test: test.place))
    counted = held.join(by_stratum, "stratum").groupBy("stratum", first.alias("place")).agg(F.count("*").alias("good"))
    n_good = counted.groupBy("stratum").agg(F.sum("good").alias("n"))
    upto = Window.partitionBy("stratum").orderBy("place")
    tests = (
        tried.join(counted.where("place is not null"), ["stratum", "place"], "left")
        .join(n_good, "stratum")
        .withColumn("k", F.sum(F.coalesce("good", F.lit(0))).over(upto))
    )

    @F.pandas_udf("double")
    def p_value(n: pd.Series, k: pd.Series) -> pd.Series:
        # At its expectation or beyond a count can't speak against the risk; its tail needs no summing.
        return pd.Series(
            [1.0 if b >= a * risk else binomial_below(int(b), int(a), risk) for a, b in zip(n, k, strict=True)],
            dtype=float,
        )

    strata = tried.select(F.greatest(F.count_distinct("stratum"), F.lit(1))).scalar()
    # k never falls along the order, so all tests before one that passes pass as well.
    passed = tests.where(p_value("n", "k") <= F.lit(error) / strata)
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """measured + base_failed, kept: rejected by a base rule, or above a cutoff
    of its stratum."""
    by_stratum = cutoffs.groupBy("stratum").agg(
        *(F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"__{name}") for name in rules())
    )
    rows = measured.withColumn("__stratum", F.coalesce("stratum", F.lit("")))
    joined = rows.join(by_stratum.withColumnRenamed("stratum", "__stratum"), "__stratum", "left")
    rejected = F.lit(False)
    for name, (statistic, _) in rules().items():
        rejected = rejected | F.coalesce(statistic > F.col(f"__{name}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).select(
        *measured.columns, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept")
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    risk: float = RISK,
    error: float = ERROR,
    id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
) -> DataFrame:
    """Counts, base_failed and kept of every row of `docs`.

    NULL texts are empty (and fail the base rules), a NULL stratum counts as
    the empty one, repeated rows stay, empty tables give no rows. Without
    labels, or with too few to certify a cutoff, only the base rules reject.
    """
    measured = materialize(measure(docs, id, text, stratum), "quality-counts")
    return judge(measured, thresholds(measured, labels, risk, error))
