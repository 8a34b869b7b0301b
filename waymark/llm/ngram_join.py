"""Near-duplicate documents by an exact Jaccard join on word n-grams.

A document is the set of its distinct n-grams, as 64-bit hashes. Sets are put
in one global order, rare n-grams first, and two sets that overlap enough must
share an n-gram within their prefixes. Documents meet on these n-grams; pairs
whose lengths, or whose places of the shared n-gram, rule out the overlap are
dropped, the rest is verified once per pair: first by a bound on the overlap
(the suffix filter), then in full.

* Equal sets are one class throughout, so copies are never paired.
* The order needs frequencies of all n-grams. They are counted in `BUCKETS`
  hash buckets over all documents: a table of fixed size, exact as an order
  whatever n-grams share a bucket.
* Classes meet in two steps. Each class is first paired with the hub of its
  n-gram only, which joins large groups of near copies with a pair or two per
  member. Then classes of different components still sharing a prefix n-gram
  are paired with each other, so no link between components is missed.
* All links lie within components. To count them, the classes of a component
  meet in blocks of bounded size, all overlaps of two blocks are one matrix
  product, and only counts leave the task; pairs never become rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from waymark.llm.components import connected_components
from waymark.llm.shared import materialize

BUCKETS = 1 << 20
CHUNK = 1 << 12
MEMBER_BITS = 1 << 22
ROWS_OUT = 100_000
# Classes and n-grams of a block where the links of a component are counted, columns of a product at a time.
LINK_CLASSES, LINK_GRAMS, LINK_COLUMNS = 512, 1_000_000, 8_192

_FACTORS = np.array(
    [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64
)


def ngrams(raw: bytes | None, size: int) -> np.ndarray:
    """The set of a text as ascending hashes: A to Z lower-cased, words split
    at ASCII white space; fewer words than `size` make one n-gram."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    codes = np.array([xxh3_64_intdigest(word) for word in words], np.uint64)
    n = max(1, len(words) - size + 1)
    keys = np.zeros(n, np.uint64)
    for at in range(min(size, len(words))):
        keys += codes[at : at + n] * _FACTORS[at]
    if len(words) < size:  # not to be taken for a part of longer n-grams
        keys += np.uint64(len(words))
    keys ^= keys >> np.uint64(32)
    keys *= np.uint64(0xD6E8FEB86659FD93)
    keys ^= keys >> np.uint64(32)
    return np.unique(keys)


def _key(grams: np.ndarray) -> tuple[int, int]:
    """128-bit identity of a set, as two signed numbers."""
    digest = blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _texts(docs: DataFrame, id: str, text: str, hashed: bool) -> DataFrame:
    """The texts with their ids, and if asked for a hash that tells rows of one id apart."""
    told = text_hash(F.col(text)) if hashed else F.lit(None).cast("long")
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), told.alias("text_hash"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("binary"))


def _survey(texts: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds: per document its set's key and size, and per task
    the counts of n-grams by hash bucket, in compressed chunks."""
    names = ["doc_id", "text_hash", "k1", "k2", "n", "chunk", "counts"]
    schema = "doc_id long, text_hash long, k1 long, k2 long, n int, chunk int, counts binary"

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            ids, keys, sizes = batch.column(0), [], []
            for raw in batch.column(1):
                grams = ngrams(raw.as_py(), size)
                keys.append(_key(grams) if len(grams) else (None, None))
                sizes.append(len(grams))
                np.add.at(counts, (grams >> np.uint64(44)).astype(np.int64), 1)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    batch.column(2),
                    pa.array([k for k, _ in keys], pa.int64()),
                    pa.array([k for _, k in keys], pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names=names,
            )
        chunks = [at for at in range(0, BUCKETS, CHUNK) if counts[at : at + CHUNK].any()]
        n = len(chunks)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.nulls(n, kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())),
                pa.array([at // CHUNK for at in chunks], pa.int32()),
                pa.array([zlib.compress(counts[at : at + CHUNK].tobytes(), 1) for at in chunks], pa.binary()),
            ],
            names=names,
        )

    return texts.mapInArrow(survey, schema)


def _bucket_counts(surveyed: DataFrame) -> np.ndarray:
    """The counts of all tasks added up: BUCKETS numbers, however much data."""

    counts = np.zeros(BUCKETS, np.uint32)
    rows = surveyed.where("chunk is not null").select("chunk", "counts").groupBy("chunk")

    def summed(table: pa.Table) -> pa.Table:
        added = np.zeros(CHUNK, np.uint64)
        for packed in table.column("counts"):
            added += np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
        # More than 24 bits make no difference to what is rare.
        added = added.clip(0, (1 << 24) - 1).astype(np.uint32).tobytes()
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([added], pa.binary())})

    for row in rows.applyInArrow(summed, "chunk int, counts binary").collect():
        counts[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.uint32)
    return counts


def _ceil(a: int | np.ndarray, b: int):
    return -(-a // b)


def _prefixes(texts: DataFrame, size: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """gram, k1, k2, n, pos: the probing prefix of each set, rare first. A task
    emits equal sets once."""
    schema = "gram long, k1 long, k2 long, n int, pos int"
    names = ["gram", "k1", "k2", "n", "pos"]

    def emit(parts: list[tuple[np.ndarray, tuple[int, int], int]]) -> pa.RecordBatch:
        lengths = [len(prefix) for prefix, _, _ in parts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([prefix for prefix, _, _ in parts]).view(np.int64)),
                pa.array(np.repeat(np.array([key[0] for _, key, _ in parts], np.int64), lengths)),
                pa.array(np.repeat(np.array([key[1] for _, key, _ in parts], np.int64), lengths)),
                pa.array(np.repeat(np.array([n for _, _, n in parts], np.int32), lengths)),
                pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])),
            ],
            names=names,
        )

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        parts, rows = [], 0
        for batch in batches:
            for raw in batch.column(1):
                grams = ngrams(raw.as_py(), size)
                n = len(grams)
                if not n or (key := _key(grams)) in seen:
                    continue
                seen.add(key)
                # Equal counts go by hash; `grams` ascends and the sort is stable.
                rarity = counts[(grams >> np.uint64(44)).astype(np.int64)]
                prefix = grams[np.argsort(rarity, kind="stable")[: n - _ceil(num * n, den) + 1]]
                parts.append((prefix, key, n))
                rows += len(prefix)
                if rows >= ROWS_OUT:
                    yield emit(parts)
                    parts, rows = [], 0
        if parts:
            yield emit(parts)

    return texts.mapInArrow(prefixes, schema)


def _possible(x: str, y: str, num: int, den: int) -> Column:
    """Length and positional filter for a pair that shares a gram at x.pos and y.pos."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
    return (
        (F.least(nx, ny) * den >= F.greatest(nx, ny) * num)
        & (rest * (num + den) >= (nx + ny) * num)
    )


def _indexed(n: Column, pos: Column, num: int, den: int) -> Column:
    """Whether a gram lies in the indexing prefix of a set: the first n-gram a
    set shares with a similar one of its size or larger always does."""
    return pos <= n - F.ceil(2 * num * n / F.lit(num + den))


def _member_bits(keys: DataFrame) -> np.ndarray:
    """A table of MEMBER_BITS bits with those of the given keys set."""

    def mark(table: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK, bool)
        at = table.column("bit").to_numpy()
        bits[at % CHUNK] = True
        return pa.table(
            {"chunk": pa.array([int(at[0]) // CHUNK], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())}
        )

    bit = F.pmod("k1", F.lit(MEMBER_BITS)).cast("int")
    rows = keys.select(bit.alias("bit")).distinct().groupBy(F.floor(F.col("bit") / CHUNK)).applyInArrow(
        mark, "chunk int, bits binary"
    )
    bits = np.zeros(MEMBER_BITS, bool)
    for row in rows.collect():
        bits[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.unpackbits(np.frombuffer(row["bits"], np.uint8))
    return bits


def _sets(texts: DataFrame, size: int, keys: DataFrame) -> DataFrame:
    """k1, k2, grams (packed hashes) of the sets whose keys are given. A bit
    table of fixed size keeps most others from being shuffled."""
    member = np.packbits(_member_bits(keys))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(member)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            found = []
            for raw in batch.column(1):
                grams = ngrams(raw.as_py(), size)
                if len(grams) and bits[(key := _key(grams))[0] % MEMBER_BITS] and key not in seen:
                    seen.add(key)
                    found.append((*key, grams.tobytes()))
            if found:
                k1, k2, packed = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(packed, pa.binary())],
                    names=["k1", "k2", "grams"],
                )

    rows = texts.mapInArrow(sets, "k1 long, k2 long, grams binary").dropDuplicates(["k1", "k2"])
    return rows.join(keys.distinct(), ["k1", "k2"], "left_semi")


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |a and b| >= num * |a or b|: the suffix filter, then the count."""
    least = _ceil(num * (len(a) + len(b)), num + den)
    if least > min(len(a), len(b)):
        return False
    edges = np.arange(1, 32, dtype=np.uint64) << np.uint64(59)
    in_a = np.diff(np.searchsorted(a, edges), prepend=0, append=len(a))
    in_b = np.diff(np.searchsorted(b, edges), prepend=0, append=len(b))
    if np.minimum(in_a, in_b).sum() < least:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= least


def _verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a1, a2, b1, b2) that are similar, and the sets of all pairs.
    Only sets that stand in a pair are shuffled."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den)
                for x, y in zip(batch.column(4), batch.column(5), strict=True)
            ]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:4], names=["a1", "a2", "b1", "b2"])

    first = pairs.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"))
    keys = materialize(first.union(pairs.select("b1", "b2")).distinct(), "ngram-keys")
    sets = materialize(_sets(texts, size, keys), "ngram-sets")
    left = sets.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("grams").alias("grams_b"))
    joined = pairs.join(right, ["b1", "b2"]).join(left, ["a1", "a2"])
    found = joined.select("a1", "a2", "b1", "b2", "grams_a", "grams_b").mapInArrow(
        check, "a1 long, a2 long, b1 long, b2 long"
    )
    return materialize(found, "ngram-edges"), sets


def _pair(x: str, y: str) -> list[Column]:
    """The keys of two rows, the smaller first."""
    swap = F.struct(f"{x}.k1", f"{x}.k2") > F.struct(f"{y}.k1", f"{y}.k2")
    return [
        F.when(swap, F.col(f"{second}.{k}")).otherwise(F.col(f"{first}.{k}")).alias(name)
        for first, second, k, name in ((x, y, "k1", "a1"), (x, y, "k2", "a2"), (y, x, "k1", "b1"), (y, x, "k2", "b2"))
    ]


def _first_row() -> Column:
    """For the first row of a class or component: those with an id before those without."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")


def _labelled(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """k1, k2, the component and its first row, of the classes that edges
    connect. These are numbered first, so that components are found on one
    number per class."""
    ends = edges.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).union(edges.select("b1", "b2")).distinct()
    members = classes.join(ends, ["k1", "k2"], "left_semi").select("k1", "k2", "first")
    members = materialize(members.withColumn("node", F.monotonically_increasing_id()), "ngram-members")
    first = members.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("node").alias("a"))
    second = members.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("node").alias("b"))
    links = edges.join(first, ["a1", "a2"]).join(second, ["b1", "b2"]).select("a", "b")
    labels = members.join(connected_components(links), "node")
    firsts = labels.groupBy("component").agg(F.min("first").alias("first_of_all"))
    return materialize(labels.join(firsts, "component").select("k1", "k2", "component", "first_of_all"), "ngram-labels")


def overlaps(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of n-grams that each of the sets `left` shares with each of `right`."""
    rows = np.repeat(np.arange(len(grams)), [len(one) for one in grams])
    _, column, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    often = times > 1
    kept = often[column]
    rows, column = rows[kept], (np.cumsum(often) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    shared = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(often.sum()), LINK_COLUMNS):
        begin, end = np.searchsorted(column, [start, start + LINK_COLUMNS])
        has = np.zeros((len(grams), LINK_COLUMNS), np.float32)
        has[rows[begin:end], column[begin:end] - start] = 1
        shared += (has[left] @ has[right].T).astype(np.int64)
    return shared


def _links(sets: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """k1, k2, links: the documents of other classes that each class placed
    in a component is similar to. `sets` may repeat a class."""

    def count(table: pa.Table) -> pa.Table:
        k1, k2, first = (table.column(name).to_numpy() for name in ("k1", "k2", "block"))
        _, once = np.unique(np.stack([k1, k2], axis=1), axis=0, return_index=True)
        k1, k2, first, size = k1[once], k2[once], first[once], table.column("size").to_numpy()[once]
        packed = table.column("grams")
        grams = [np.frombuffer(packed[int(at)].as_py(), np.uint64) for at in once]
        n = np.array([len(one) for one in grams], np.int64)
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.nonzero(first == low)[0], np.nonzero(first == high)[0]
        linked = overlaps(grams, left, right) * (num + den) >= num * (n[left][:, None] + n[right][None, :])
        if low == high:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(grams), np.int64)
        links[left] += linked @ size[right]
        if low != high:
            links[right] += size[left] @ linked
        return pa.table({"k1": k1, "k2": k2, "links": links})

    blocks = F.greatest(F.ceil(F.count("*") / LINK_CLASSES), F.ceil(F.sum("n") / LINK_GRAMS)).cast("int")
    components = placed.groupBy("component").agg(F.count("*").alias("classes"), blocks.alias("blocks"))
    rows = (
        placed.join(components.where("classes > 2"), "component")
        .withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
        .join(sets, ["k1", "k2"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select("component", "low", "high", "block", "k1", "k2", "size", "grams")
    )
    counted = rows.groupBy("component", "low", "high").applyInArrow(count, "k1 long, k2 long, links long")
    return counted.groupBy("k1", "k2").agg(F.sum("links").alias("links"))


def similar_documents(
    docs: DataFrame,
    size: int = 5,
    num: int = 4,
    den: int = 5,
    id: str = "doc_id",
    text: str = "text",
    links: bool = True,
    kept: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each document; linked are
    documents with den * |intersection| >= num * |union| of their n-gram sets,
    and n_links counts the other documents one is linked with. Without
    `links` that column is left out, and its work. `kept` adds the text's
    hash (`text_hash`) and whether the document is the one to keep of its
    component: the one with the smallest id, then hash.

    Rows that repeat an id and its set (with `kept`, its text) are one
    document. Rows that repeat an id with another set are documents of their
    own, with a result row each; so is every row without an id. A component takes the smallest id of its
    documents; it is NULL if none has one. NULL and wordless texts have an
    empty set and link with nothing. An empty table gives no rows; other
    columns are ignored.
    """
    texts = _texts(docs, id, text, kept)
    surveyed = materialize(_survey(texts, size), "ngram-survey")
    counts = _bucket_counts(surveyed)
    rows = surveyed.where("chunk is null").select("doc_id", *(["text_hash"] if kept else []), "k1", "k2", "n")
    # Copies go, but rows without an id, however many, need no place where they meet.
    documents = rows.where("doc_id is not null").distinct().union(rows.where("doc_id is null"))
    documents = materialize(documents, "ngram-documents")
    classes = documents.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min(_first_row() if kept else F.col("doc_id")).alias("first"), F.count("*").alias("size"), F.max("n").alias("n")
    )

    # Prefix n-grams that two classes or more share, with the hub of each: the
    # set that has the n-gram earliest, so the fewest rarer ones. In a group of
    # near copies it is the text they were made from, or next to it.
    same = Window.partitionBy("gram")
    hub = F.min(F.struct("pos", "n", "k1", "k2")).over(same)
    shared = (
        _prefixes(texts, size, num, den, counts)
        .withColumn("several", (F.min("k1").over(same) != F.max("k1").over(same)) | (F.min("k2").over(same) != F.max("k2").over(same)))
        .withColumn("hub", hub)
        # A set whose indexing prefix ends before can only meet a smaller one that has the n-gram in its own.
        .withColumn("indexed", _indexed(F.col("n"), F.col("pos"), num, den))
        .withColumn("least", F.min(F.when(F.col("indexed"), F.col("n"))).over(same))
        .where(F.col("several") & (F.col("indexed") | (F.col("n") > F.col("least"))))
        .drop("several", "indexed", "least")
        .distinct()
    )
    shared = materialize(shared, "ngram-shared")
    other = (F.col("m.k1") != F.col("m.hub.k1")) | (F.col("m.k2") != F.col("m.hub.k2"))
    members = shared.alias("m").where(other & _possible("m", "m.hub", num, den))
    stars = materialize(members.select(*_pair("m", "m.hub")).distinct(), "ngram-stars")

    edges, sets = _verified(stars, texts, size, num, den)
    labels = _labelled(edges, classes)

    # What still lies in different components and shares a prefix n-gram.
    label = F.coalesce(F.col("component"), F.xxhash64("k1", "k2"))
    rows = (
        shared.drop("hub")
        .join(labels.drop("first_of_all"), ["k1", "k2"], "left")
        .select("gram", "k1", "k2", "n", "pos", label.alias("label"))
    )
    in_label = Window.partitionBy("gram", "label")
    rows = (
        rows.repartition("gram")
        .withColumn("peers", F.count("*").over(in_label))
        .withColumn("main", F.max(F.struct("peers", "label")).over(same))
        .withColumn("mixed", F.min("label").over(same) != F.max("label").over(same))
        .where("mixed")
        .withColumn("is_main", F.col("label") == F.col("main.label"))
        .select("gram", "k1", "k2", "n", "pos", "label", "is_main")
    )
    rows = materialize(rows, "ngram-mixed")
    # The largest component of an n-gram meets the others, never itself. Of a
    # pair, the smaller set need only be within its (shorter) indexing prefix.
    x, y = rows.where("not is_main").alias("x"), rows.alias("y")

    def indexed(row: str) -> Column:
        return _indexed(F.col(f"{row}.n"), F.col(f"{row}.pos"), num, den)

    once = F.col("y.is_main") | (F.struct("x.k1", "x.k2") < F.struct("y.k1", "y.k2"))
    smaller = F.when(F.col("x.n") < F.col("y.n"), indexed("x")).when(F.col("x.n") > F.col("y.n"), indexed("y"))
    meets = (
        (F.col("x.gram") == F.col("y.gram"))
        & (F.col("x.label") != F.col("y.label"))
        & once
        & _possible("x", "y", num, den)
        & smaller.otherwise(indexed("x") & indexed("y"))
    )
    pairs = x.join(y, meets).select(*_pair("x", "y")).distinct()
    pairs = materialize(pairs.join(stars, ["a1", "a2", "b1", "b2"], "left_anti"), "ngram-pairs")
    more, more_sets = _verified(pairs, texts, size, num, den)
    if not more.isEmpty():
        labels = _labelled(edges.union(more), classes)
        sets = sets.union(more_sets)
    of_all = F.coalesce("first_of_all", "first")
    by_class = classes.join(labels, ["k1", "k2"], "left").select("k1", "k2", "size", "n", "component", of_all.alias("of_all"))
    least = F.when(~F.col("of_all.no_id"), F.col("of_all.id")) if kept else F.col("of_all")
    result = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce(least, F.col("doc_id")).alias("component_id")]
    if kept:
        result += ["text_hash", (F.col("of_all").isNull() | (F.col("of_all") == _first_row())).alias("kept")]
    if not links:
        return documents.join(by_class.select("k1", "k2", "of_all"), ["k1", "k2"], "left").select(*result)

    # Two classes in a component are linked; of more, not all need be.
    by_class = materialize(by_class, "ngram-classes")
    placed = by_class.where("component is not null").select("k1", "k2", "size", "n", "component")
    counted = materialize(_links(sets, placed, num, den), "ngram-links")
    pairs = placed.groupBy("component").agg(F.count("*").alias("classes"), F.sum("size").alias("docs")).where("classes = 2")
    by_class = by_class.join(counted, ["k1", "k2"], "left").join(pairs, "component", "left")
    others = F.coalesce(F.col("links"), F.col("docs") - F.col("size"), F.lit(0))
    by_class = by_class.select("k1", "k2", "of_all", (F.col("size") - 1 + others).alias("n_links"))
    n_links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    return documents.join(by_class, ["k1", "k2"], "left").select(*result, n_links)
