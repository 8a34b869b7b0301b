"""Packing documents into sequences of bounded length by linear grouping.

Lengths are small whole numbers, so the plan needs only their histogram (at
most `capacity` rows) however many documents there are:

1. Large lengths are cut into groups of equal cardinality and rounded up to
   the largest of their group.
2. Configurations of these few sizes are chosen one after the other: the
   largest size left, and the subset of the others that fills the rest best;
   each is used as often as its groups allow.
3. Actual lengths replace the rounded ones, which leaves some more room.
4. Small lengths go, largest first, where the least room is left.

The plan speaks of the r-th document of each length. Ranks come from one
window per length and hash bucket, and each document looks up its own place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.shared import materialize, only
from waymark.llm.tokens import encoder

CAPACITY = 4096
GROUPS = 128
SMALL_SHARE = 16
END_ID = 1
RANK_BUCKETS = 256


def pieces(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Documents as token pieces: doc_id, piece, start, length, ids_crc32.

    A document is its ids and `end_id`; only one longer than `capacity` is
    cut. A NULL or empty text is the end id alone. Rows that repeat an id are
    documents of their own.
    """
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long"
    end = np.uint32(end_id).astype("<u4").tobytes()
    step = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            ids, numbers, lengths, crcs = [], [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = encode(body.as_py() or "") + end
                for number, begin in enumerate(range(0, len(tokens), step)):
                    part = tokens[begin : begin + step]
                    ids.append(doc)
                    numbers.append(number)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
            number = pa.array(numbers, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    number,
                    pa.array(np.array(numbers, np.int64) * capacity),
                    pa.array(lengths, pa.int32()),
                    pa.array(crcs, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return only(docs, doc_id=id, text=text).mapInArrow(cut, schema)


@dataclass
class Bins:
    """`count` sequences filled alike. An item (length, first rank, copies)
    puts ranks first + i * copies ... into the i-th of them."""

    count: int
    room: int
    items: list[tuple[int, int, int]]

    def split(self, first: int) -> tuple[Bins, Bins]:
        """The first so many sequences, and the rest."""
        rest = [(length, rank + first * copies, copies) for length, rank, copies in self.items]
        return Bins(first, self.room, list(self.items)), Bins(self.count - first, self.room, rest)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Bins]:
    """Where the documents of each length go: steps 1 to 4 of the module."""
    small = capacity // SMALL_SHARE
    large = {length: count for length, count in histogram.items() if length > small and count}
    used: dict[int, int] = {}
    bins = _substitute(_group(large, groups), capacity, used)
    by_room: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for each in bins:
        by_room[each.room].append(each)
    for length in sorted((x for x in histogram if x <= small), reverse=True):
        _best_fit(length, histogram[length], by_room, capacity)
    return [each for stack in by_room for each in stack]


def _group(large: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) runs in groups of about equal cardinality, longest
    first; one length may span groups."""
    total = sum(large.values())
    size = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    free = size
    for length in sorted(large, reverse=True):
        count = large[length]
        while count:
            take = min(count, free)
            out[-1].append((length, take))
            count, free = count - take, free - take
            if not free:
                out.append([])
                free = size
    return [group for group in out if group]


def _configuration(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """The largest size left with the subset of the others that fills the
    remaining room best: group number -> copies."""
    first = next(g for g, n in enumerate(left) if n)
    room = capacity - sizes[first]
    chosen = {first: 1}
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.full(room + 1, -1, np.int32)
    for g, (size, n) in enumerate(zip(sizes, left, strict=True)):
        if size > room:
            continue
        for _ in range(min(n - (g == first), room // size)):
            new = np.zeros_like(reached)
            new[size:] = reached[: room + 1 - size]
            new &= ~reached
            if not new.any():
                break
            by[new] = g
            reached |= new
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        g = int(by[at])
        chosen[g] = chosen.get(g, 0) + 1
        at -= sizes[g]
    return chosen


def _substitute(groups: list[list[tuple[int, int]]], capacity: int, used: dict[int, int]) -> list[Bins]:
    sizes = [group[0][0] for group in groups]
    left = [sum(count for _, count in group) for group in groups]
    stock = [list(reversed(group)) for group in groups]  # longest last, to pop
    out = []
    while any(left):
        config = _configuration(sizes, left, capacity)
        times = min(left[g] // n for g, n in config.items())
        slots = []
        for g, n in sorted(config.items()):
            left[g] -= n * times
            slots += [_take(stock[g], times) for _ in range(n)]
        while times:
            run = min(slot[-1][1] for slot in slots)
            items, room = [], capacity
            for slot in slots:
                length, count = slot.pop()
                if count > run:
                    slot.append((length, count - run))
                items.append((length, used.get(length, 0), 1))
                used[length] = used.get(length, 0) + run
                room -= length
            out.append(Bins(run, room, items))
            times -= run
    return out


def _take(stock: list[tuple[int, int]], count: int) -> list[tuple[int, int]]:
    """The longest `count` of a group's stock, as runs with the longest last."""
    out = []
    while count:
        length, there = stock.pop()
        take = min(there, count)
        out.append((length, take))
        if there > take:
            stock.append((length, there - take))
        count -= take
    return out[::-1]


def _best_fit(length: int, count: int, by_room: list[list[Bins]], capacity: int) -> None:
    rank, room = 0, length
    while count:
        while room <= capacity and not by_room[room]:
            room += 1
        if room > capacity:
            per = capacity // length
            by_room[capacity].append(Bins(-(-count // per), capacity, []))
            room = length
            continue
        each = by_room[room].pop()
        # The tightest sequence stays the tightest until it is full.
        per = min(room // length, count)
        full = min(each.count, count // per)
        if full < each.count:
            each, rest = each.split(full)
            by_room[room].append(rest)
        each.items.append((length, rank, per))
        each.room = room - per * length
        by_room[each.room].append(each)
        rank, count = rank + full * per, count - full * per


def _places(bins: list[Bins]) -> dict[str, np.ndarray]:
    """The plan as a look-up table sorted by length and first rank."""
    rows, sequence = [], 0
    for each in bins:
        offset = 0
        for length, rank, copies in each.items:
            rows.append((length, rank, copies, sequence, offset))
            offset += length * copies
        sequence += each.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {
        "key": (table[:, 0] << 48) | table[:, 1],
        "rank": table[:, 1],
        "copies": table[:, 2],
        "sequence": table[:, 3],
        "offset": table[:, 4],
    }


def ranked(cut: DataFrame) -> DataFrame:
    """The pieces with `rank`, their number among those of equal length.

    A length as common as a third of all pieces is ranked in hash buckets;
    equal rows are interchangeable.
    """
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(RANK_BUCKETS)))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .drop("bucket", "inside", "before")
    )


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    end_id: int = END_ID,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every
    piece; the pieces of a sequence lie side by side from 0 on.

    An empty table gives no rows. Token ids are computed once and only their
    lengths and checksums kept; the histogram of lengths (at most `capacity`
    rows) is all the driver sees.
    """
    cut = materialize(pieces(docs, vocabulary, capacity, end_id, id, text), "packing-pieces")
    histogram = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}
    places = _places(plan(histogram, capacity, groups))
    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(places["key"], (length << 48) | rank, "right") - 1
            nth, copy = np.divmod(rank - places["rank"][at], places["copies"][at])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("doc_id", "piece", "start")),
                    pa.array(length),
                    batch.column("ids_crc32"),
                    pa.array(places["sequence"][at] + nth),
                    pa.array(places["offset"][at] + copy * length),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked(cut).mapInArrow(place, schema)
