"""Hard negatives: for each anchor and each of its best rows of the same
label, the best rows of other labels whose score lies in a band below it.

Vectors hold whole numbers and scores are their inner products, exactly.
Kronecker packing makes them: components, less the smallest, of several
candidates lie in separate bit fields of one wide number, wide enough for the
sum of products, so that one multiplication per anchor component scores all of
them and the fields hold the exact scores. Up to 53 bits the wide numbers are
held in doubles, exactly, and a matrix product multiplies them; wider ones are
Python's integers.

Anchors are a stated set of rows and meet all rows in blocks: first those of
their own label, for the positives, then all of their length. Blocks of both
sides are bounded; a label of any size is split over them. Only the best of a
block leave its task, pairs never become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.shared import materialize, only

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
ITEM_BLOCK = 16_384
ANCHOR_BLOCK = 4_096
CELLS = 1_000_000  # scores held at a time
EXACT = 53  # bits of a double
FIELDS = 64  # candidates in a Python integer
_MOST = (1 << 63) - 1


def steps(x: Column) -> Column:
    """floor(256 * x) of a component as a double: a whole number, however
    large. NULL and non-finite ones stay what they are."""
    scaled = x.cast("double") * 256
    return F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled).cast("double")).otherwise(scaled)


def packed_products(anchors: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers; 64-bit
    numbers, or Python's where those may not do."""
    if not len(anchors) or not len(items) or not items.shape[1]:
        return np.zeros((len(anchors), len(items)), np.int64)
    low_a, low_i = anchors.min(axis=0), items.min(axis=0)
    up_a, up_i = anchors - low_a, items - low_i
    # Each component's largest product, added up: no field can hold more.
    most = sum(int(a) * int(b) for a, b in zip(up_a.max(axis=0), up_i.max(axis=0), strict=True))
    width = max(most.bit_length(), 1)
    largest = max(abs(int(x)) for side in (anchors, items) for x in (side.min(), side.max()))
    small = items.shape[1] * (largest + 1) ** 2 < 1 << 62
    if small and width <= EXACT:
        sums = _in_doubles(up_a, up_i, width)
        shift, slope, base = (x.astype(np.int64) for x in (items, anchors, low_a))
    else:
        sums = _in_integers(up_a, up_i, width)
        shift, slope, base = (x.astype(object) for x in (items, anchors, low_a))
    low = low_i.astype(base.dtype)
    # (a - p)(b - q) summed is ab - aq - pb + pq.
    return sums + (slope @ low)[:, None] + (shift @ base)[None, :] - (base * low).sum()


def _in_doubles(anchors: np.ndarray, items: np.ndarray, width: int) -> np.ndarray:
    fields = EXACT // width
    n = -(-len(items) // fields)
    padded = np.zeros((n * fields, items.shape[1]))
    padded[: len(items)] = items
    wide = np.zeros((n, items.shape[1]))
    for k in range(fields):
        wide += padded[k * n : (k + 1) * n] * float(1 << k * width)
    sums = (anchors.astype(float) @ wide.T).astype(np.int64)
    mask = (1 << width) - 1
    return np.concatenate([sums >> k * width & mask for k in range(fields)], axis=1)[:, : len(items)]


def _in_integers(anchors: np.ndarray, items: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(anchors), len(items)), object)
    mask = (1 << width) - 1
    columns = [column.tolist() for column in items.astype(object).T]
    rows = [row.tolist() for row in anchors.astype(object)]
    for start in range(0, len(items), FIELDS):
        some = range(start, min(start + FIELDS, len(items)))
        wide = [sum(int(column[at]) << (at - start) * width for at in some) for column in columns]
        for at, row in enumerate(rows):
            total = sum(int(x) * w for x, w in zip(row, wide, strict=True))
            out[at, some.start : some.stop] = [total >> k * width & mask for k in range(len(some))]
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores that fit per row, ties by smaller
    id; rows in order, best first."""
    rows, cols = [], []
    for row in range(len(scores)):
        some = np.flatnonzero(fits[row])
        if len(some) > k:
            values = scores[row, some]
            if values.dtype != object:
                # Those that tie with the k-th best stay in, ids decide.
                some = some[values >= np.partition(values, len(values) - k)[len(values) - k]]
        order = np.lexsort((ids[some], -scores[row, some]))[:k] if scores.dtype != object else sorted(
            range(len(some)), key=lambda at, some=some, row=row: (-scores[row, some[at]], ids[some[at]])
        )[:k]
        cols.append(some[np.array(order, int)])
        rows.append(np.full(len(cols[-1]), row))
    none = np.empty(0, int)
    return np.concatenate([none, *rows]), np.concatenate([none, *cols])


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Rows of whole numbers; Python's integers where doubles hold them."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if flat.dtype.kind == "f":
        flat = np.array([int(x) for x in flat.tolist()], object)
    else:
        flat = flat.astype(np.int64)
    return flat.reshape(n, -1) if n and len(flat) else np.zeros((n, 0), np.int64)


def _clipped(scores: np.ndarray) -> pa.Array:
    if scores.dtype == object:
        return pa.array([max(-_MOST - 1, min(_MOST, int(x))) for x in scores.tolist()], pa.int64())
    return pa.array(scores, pa.int64())


def _slices(n: int, width: int):
    step = max(1, CELLS // max(width, 1))
    return (slice(at, min(at + step, n)) for at in range(0, n, step))


def _first_of_id(items: pa.Table) -> pa.Table:
    """One row per id and label: an id stands for one vector."""
    items = items.sort_by([("vec_id", "ascending"), ("label", "ascending")])
    ids, labels = items.column("vec_id").to_numpy(), items.column("label").to_numpy()
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1])
    return items if new.all() else items.filter(pa.array(new))


def _positives(anchors: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """anchor_id, label, vec_id, score: the best k of an anchor's label here."""
    items = _first_of_id(items)
    ids, labels = items.column("vec_id").to_numpy(), items.column("label").to_numpy()
    a_ids, a_labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    x, y = _matrix(anchors.column("vector"), len(a_ids)), _matrix(items.column("vector"), len(ids))
    parts = []
    for label in np.unique(a_labels):
        mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
        for some in _slices(len(mine), len(theirs)):
            scores = packed_products(x[mine[some]], y[theirs])
            other = a_ids[mine[some]][:, None] != ids[theirs][None, :]
            rows, cols = best_of(scores, ids[theirs], other, k)
            of = mine[some][rows]
            parts.append([pa.array(a_ids[of]), pa.array(a_labels[of]), pa.array(ids[theirs][cols]), _clipped(scores[rows, cols])])
    names = ["anchor_id", "label", "vec_id", "score"]
    if not parts:
        return pa.table([pa.array([], pa.int64())] * 4, names=names)
    return pa.concat_tables([pa.table(part, names=names) for part in parts])


def _negatives(anchors: pa.Table, items: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """anchor_id, positive_id, positive_score, vec_id, score: the best k here of
    another label within the band of each positive."""
    items = _first_of_id(items)
    ids, labels = items.column("vec_id").to_numpy(), items.column("label").to_numpy()
    a_ids, a_labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    x, y = _matrix(anchors.column("vector"), len(a_ids)), _matrix(items.column("vector"), len(ids))
    positives = anchors.column("positives").to_pylist()
    parts = []
    for some in _slices(len(a_ids), len(ids)):
        scores = packed_products(x[some], y)
        other = a_labels[some][:, None] != labels[None, :]
        for j in range(max(map(len, positives[some]), default=0)):
            has = [at for at, mine in enumerate(positives[some]) if len(mine) > j]
            mine = [positives[some][at][j] for at in has]
            # Whole numbers: the band's ends rounded inwards.
            least = np.array([-(-low * p["score"] // 100) for p in mine], scores.dtype)
            most = np.array([high * p["score"] // 100 for p in mine], scores.dtype)
            kept = scores[has]
            fits = other[has] & (kept >= least[:, None]) & (kept <= most[:, None])
            rows, cols = best_of(kept, ids, fits.astype(bool), k)
            of = np.array(has, int)[rows]
            parts.append(
                [
                    pa.array(a_ids[some][of]),
                    pa.array([mine[row]["vec_id"] for row in rows], pa.int64()),
                    pa.array([mine[row]["score"] for row in rows], pa.int64()),
                    pa.array(ids[cols]),
                    _clipped(kept[rows, cols]),
                ]
            )
    names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]
    if not parts:
        return pa.table([pa.array([], pa.int64())] * 5, names=names)
    return pa.concat_tables([pa.table(part, names=names) for part in parts])


def _blocks(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / size), F.lit(1)).cast("int")


def _meet(anchors: DataFrame, items: DataFrame, grid: DataFrame, on: list[str], near: Column):
    """Both sides with a `block` key: each anchor meets each row that agrees on
    `on` in exactly one block. `grid`: on, item_blocks, anchor_blocks; what a
    block's key starts with is `near`."""

    def placed(side: DataFrame, own: str, other: str) -> DataFrame:
        spread = side.join(grid, on).select(
            *side.columns,
            near.alias("near"),
            F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias(own[:-1]),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1]),
        )
        block = F.concat_ws(":", "near", "item_block", "anchor_block").alias("block")
        return spread.select(*(F.col(name).alias(name) for name in side.columns), block)

    return placed(anchors, "anchor_blocks", "item_blocks"), placed(items, "item_blocks", "anchor_blocks")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    item_block: int = ITEM_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
    id: str = "vec_id",
    embedding: str = "vector",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` hold whole numbers (of any numeric type); `is_anchor` is a
    condition on the column `vec_id`. An anchor's positives are the
    `positives` other rows of its label with the highest inner product; for
    each, the `negatives` best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score,
    ranked from 1. Ties go to the smaller id. Rows without an id, label or
    vector, or with a NULL or non-finite component, take no part, and vectors
    of different lengths don't meet. An id stands for one vector: of rows that
    repeat an id and a label one counts. Scores beyond 64 bits are compared
    exactly and returned as the nearest 64-bit number. Without anchors, or
    rows, there are no results; other columns are ignored.
    """
    rows = only(vectors, vec_id=id, vector=embedding, label=label).where(
        "vec_id is not null and label is not null and vector is not null"
    )
    doubles = F.transform("vector", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), doubles.alias("vector")).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    rows = rows.withColumn("dim", F.size("vector"))
    largest = rows.agg(F.max(F.array_max(F.transform("vector", F.abs))).alias("x")).first().x or 0.0
    # The narrowest type that holds all components; doubles hold any, too.
    kind = next((kind for kind, bits in (("smallint", 15), ("int", 31)) if largest < 1 << bits), "double")
    vector = F.transform("vector", lambda x: x.cast(kind))
    rows = materialize(rows.select("vec_id", "label", "dim", vector.alias("vector")), "negative-vectors")
    queries = rows.where(is_anchor).groupBy("vec_id", "label", "dim").agg(F.min("vector").alias("vector"))

    labels = rows.groupBy("label", "dim").agg(
        _blocks(F.count("*"), item_block).alias("item_blocks"),
        _blocks(F.count_if(is_anchor), anchor_block).alias("anchor_blocks"),
        F.count_if(is_anchor).alias("anchors"),
    )
    # Labels of less than a block share blocks.
    shared = max(1, rows.count() // item_block)
    near = F.when(
        (F.col("item_blocks") == 1) & (F.col("anchor_blocks") == 1),
        F.concat_ws("#", "dim", F.pmod(F.xxhash64("label"), F.lit(shared))),
    ).otherwise(F.concat_ws("/", "dim", "label"))
    mine, own = _meet(queries, rows, labels.where("anchors > 0").drop("anchors"), ["label", "dim"], near)
    found = (
        mine.groupBy("block")
        .cogroup(own.groupBy("block"))
        .applyInArrow(lambda a, b: _positives(a, b, positives), "anchor_id long, label long, vec_id long, score long")
    )
    order = Window.partitionBy("anchor_id", "label").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    chosen = found.groupBy(F.col("anchor_id"), F.col("label").alias("anchor_label")).agg(
        F.collect_list(F.struct("vec_id", "score")).alias("positives")
    )
    asking = queries.join(
        chosen, (F.col("vec_id") == F.col("anchor_id")) & (F.col("label") == F.col("anchor_label"))
    ).select("vec_id", "label", "dim", "vector", "positives")
    asking = materialize(asking, "negative-anchors")

    lengths = rows.groupBy("dim").agg(_blocks(F.count("*"), item_block).alias("item_blocks"))
    asked = asking.groupBy("dim").agg(_blocks(F.count("*"), anchor_block).alias("anchor_blocks"))
    theirs, all_rows = _meet(asking, rows, lengths.join(asked, "dim"), ["dim"], F.col("dim").cast("string"))
    best = (
        theirs.groupBy("block")
        .cogroup(all_rows.groupBy("block"))
        .applyInArrow(
            lambda a, b: _negatives(a, b, negatives, low, high),
            "anchor_id long, positive_id long, positive_score long, vec_id long, score long",
        )
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
