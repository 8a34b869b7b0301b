"""Running values along an ordered log, safe for very long groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def running(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    befores: Mapping[str, Column] | None = None,
    totals: Sequence[str] = (),
    chunk: int | None = None,
) -> DataFrame:
    """Adds running sums and carried-forward values along each group.

    ``sums`` maps a new column to the expression it adds up, ``lasts`` to the
    expression whose latest non-NULL value it carries, both with the current
    row; ``befores`` is like ``lasts`` without it. ``totals`` names sums
    whose group total is added as ``<name>_total``. ``order`` is an integer
    position, unique within a group.

    The expressions of ``lasts`` and ``befores`` may use the new sums.

    A plain window would put a whole group in one task. Here each group is cut
    into stretches of ``chunk`` positions: stretches are scanned separately,
    and what a stretch starts with comes from one summary row per stretch.

    A stretch is keyed by one struct on purpose. Rows that an earlier join
    left together by group alone would satisfy a window over several columns,
    and a long group would stay in one task; and two structs with a NULL
    group are equal, so such rows stay.
    """
    stretch = F.struct(*group, F.floor(F.col(order) / (chunk or CHUNK)).cast("long").alias("__chunk"))
    keyed = df.withColumn("__key", stretch)
    if sums:
        keyed = _scan(keyed, list(group), order, sums, {}, {}, totals)
    if lasts or befores:
        keyed = _scan(keyed, list(group), order, {}, lasts or {}, befores or {}, ())
    return keyed.drop("__key")


def _scan(
    df: DataFrame,
    group: list[str],
    order: str,
    sums: Mapping[str, Column],
    lasts: Mapping[str, Column],
    befores: Mapping[str, Column],
    totals: Sequence[str],
) -> DataFrame:
    carried = {**lasts, **befores}
    summary = df.groupBy("__key").agg(
        *[F.sum(expr).alias(f"__s_{name}") for name, expr in sums.items()],
        *[
            F.max_by(expr, F.when(expr.isNotNull(), F.col(order))).alias(f"__l_{name}")
            for name, expr in carried.items()
        ],
    )
    whole = Window.partitionBy(*[F.col("__key")[g] for g in group])
    earlier = whole.orderBy("__key.__chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = summary.select(
        "__key",
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__s_{n}") for n in sums],
        *[F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__l_{n}") for n in carried],
        *[F.sum(f"__s_{n}").over(whole).alias(f"{n}_total") for n in totals],
    )

    stretch = Window.partitionBy("__key").orderBy(order)
    here = stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = stretch.rowsBetween(Window.unboundedPreceding, -1)
    inner = df.select(
        "*",
        *[F.sum(expr).over(here).alias(name) for name, expr in sums.items()],
        *[F.last(expr, ignorenulls=True).over(here).alias(name) for name, expr in lasts.items()],
        *[F.last(expr, ignorenulls=True).over(until).alias(name) for name, expr in befores.items()],
    )
    joined = inner.join(heads, "__key").withColumns(
        {
            **{n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"__s_{n}") for n in sums},
            **{n: F.coalesce(F.col(n), F.col(f"__l_{n}")) for n in carried},
        }
    )
    return joined.drop(*[f"__s_{n}" for n in sums], *[f"__l_{n}" for n in carried])
