"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Only vectors of one label are compared. Equal vectors are one point with a
number of copies. The points of a label are dealt out to shards of bounded
size, a graph is built for each, and every point queries every shard of its
label, in blocks. A query whose beam is full of links is widened until its
worst result is no link any more; the beam of a whole shard is widened until
an audit of queries against brute force finds the recall asked for, or the
beam holds the shard. Every link found is verified by its cosine in double
precision. Links stay in the task that found them: it counts them and keeps a
spanning forest, so a dense group of any size leaves one edge per member.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.components import connected_components
from waymark.llm.shared import materialize, only

COSINE = 0.98
SHARD = 8_192  # points per graph
BLOCK = 2_048  # queries per task row
DEGREE = 12  # links per node above the ground layer, twice that on it
BUILD_BEAM = 48
SEARCH_BEAM = 32
RECALL = 0.99
AUDIT = 64  # queries per shard and block checked against brute force
SLACK = 1e-5  # the graph works in single precision; verification in double decides


class Graph:
    """A navigable small-world graph over the rows of a matrix of unit vectors."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.degree, self.beam = degree, beam
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / log(degree)).astype(int), 12)
        self.layers: list[dict[int, np.ndarray]] = []
        self.entry = -1
        for node in range(n):
            self._insert(node)

    def _insert(self, node: int) -> None:
        level = int(self.levels[node])
        query = self.vectors[node]
        top = len(self.layers) - 1
        if self.entry < 0:
            self.layers = [{node: np.empty(0, np.int32)} for _ in range(level + 1)]
            self.entry = node
            return
        near = [self.entry]
        for layer in range(top, level, -1):
            near = [self._search(query, near, 1, layer)[0][1]]
        for layer in range(min(top, level), -1, -1):
            found = self._search(query, near, self.beam, layer)
            near = [other for _, other in found]
            most = self.degree * 2 if layer == 0 else self.degree
            chosen = self._spread(found, self.degree)
            links = self.layers[layer]
            links[node] = np.array(chosen, np.int32)
            for other in chosen:
                theirs = np.append(links[other], np.int32(node))
                if len(theirs) > most:
                    scores = self.vectors[theirs] @ self.vectors[other]
                    order = np.argsort(-scores, kind="stable")
                    theirs = np.array(
                        self._spread([(float(scores[at]), int(theirs[at])) for at in order], most), np.int32
                    )
                links[other] = theirs
        for _ in range(top, level):
            self.layers.append({node: np.empty(0, np.int32)})
        if level > top:
            self.entry = node

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours, nearest first, leaving out one that is nearer to a
        neighbour already chosen than to the node; the rest fills up."""
        if len(found) <= most:
            return [other for _, other in found]
        members = [other for _, other in found]
        among = self.vectors[members] @ self.vectors[members].T
        chosen: list[int] = []
        spare: list[int] = []
        for at, (score, _) in enumerate(found):
            if len(chosen) == most:
                break
            if not chosen or among[at, chosen].max() < score:
                chosen.append(at)
            else:
                spare.append(at)
        chosen += spare[: most - len(chosen)]
        return [members[at] for at in chosen]

    def _search(self, query: np.ndarray, entries: list[int], beam: int, layer: int) -> list[tuple[float, int]]:
        """The `beam` best nodes found on a layer, best first."""
        links, vectors = self.layers[layer], self.vectors
        seen = set(entries)
        best = [(float(vectors[node] @ query), node) for node in entries]
        ahead = [(-score, node) for score, node in best]
        heapq.heapify(ahead)
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while ahead:
            score, node = heapq.heappop(ahead)
            if -score < best[0][0] and len(best) >= beam:
                break
            fresh = [other for other in links[node].tolist() if other not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for value, other in zip((vectors[fresh] @ query).tolist(), fresh, strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (value, other))
                    heapq.heappush(ahead, (-value, other))
                elif value > best[0][0]:
                    heapq.heapreplace(best, (value, other))
                    heapq.heappush(ahead, (-value, other))
        return sorted(best, reverse=True)

    def within(self, query: np.ndarray, least: float, beam: int) -> list[int]:
        """Nodes of at least that cosine. The beam doubles until half of it lies
        below, so that links reached by way of others that are none are seen."""
        n = len(self.vectors)
        if not n:
            return []
        query = query.astype(np.float32)
        near = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            near = [self._search(query, near, 1, layer)[0][1]]
        while True:
            found = self._search(query, near, min(beam, n), 0)
            links = [node for score, node in found if score >= least]
            if beam >= n or 2 * len(links) <= beam:
                return links
            near = [node for _, node in found]
            beam *= 2

    def dump(self) -> bytes:
        """Vectors are stored apart; links, levels and entry as arrays."""
        layers = []
        for links in self.layers:
            nodes = np.fromiter(links, np.int32, len(links))
            counts = np.array([len(links[node]) for node in nodes.tolist()], np.int32)
            layers.append((nodes, counts, np.concatenate([links[node] for node in nodes.tolist()]).astype(np.int32)))
        return zlib.compress(pickle.dumps((layers, self.entry)), 1)

    @classmethod
    def load(cls, dumped: bytes, vectors: np.ndarray) -> Graph:
        graph = cls.__new__(cls)
        graph.vectors = np.ascontiguousarray(vectors, np.float32)
        graph.degree, graph.beam = DEGREE, BUILD_BEAM
        layers, graph.entry = pickle.loads(zlib.decompress(dumped))
        graph.layers = [
            dict(zip(nodes.tolist(), np.split(flat, np.cumsum(counts)[:-1]), strict=True))
            for nodes, counts, flat in layers
        ]
        return graph


def points(rows: DataFrame) -> DataFrame:
    """label, point (its smallest id), copies, vector of the distinct usable
    vectors: not NULL or zero, without NULL or non-finite components."""
    numbers = F.transform("vector", lambda x: x.cast("double"))
    usable = rows.where("vec_id is not null and label is not null and vector is not null").withColumn("vector", numbers)
    usable = usable.where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )
    return usable.groupBy("label", "vector").agg(F.min("vec_id").alias("point"), F.count("*").alias("copies"))


def _packed(frame: DataFrame, part: str) -> DataFrame:
    """One row per (label, dimension, part): ids, copies and vectors as bytes."""
    schema = f"label string, dim int, {part} int, ids binary, copies binary, vectors binary"

    def pack(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().sort_values("point")
        matrix = np.stack(rows["vector"].to_numpy()).astype("<f8")
        return pa.table(
            {
                "label": rows["label"].iloc[:1].to_list(),
                "dim": pa.array([matrix.shape[1]], pa.int32()),
                part: pa.array([int(rows[part].iloc[0])], pa.int32()),
                "ids": pa.array([rows["point"].to_numpy("<i8").tobytes()], pa.binary()),
                "copies": pa.array([rows["copies"].to_numpy("<i8").tobytes()], pa.binary()),
                "vectors": pa.array([matrix.tobytes()], pa.binary()),
            }
        )

    return frame.groupBy("label", "dim", part).applyInArrow(pack, schema)


def _unit(packed: bytes, dim: int) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so
    that squares neither overflow nor vanish."""
    matrix = np.frombuffer(packed, "<f8").reshape(-1, dim)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix**2).sum(axis=1, keepdims=True))


def _indexed(shards: DataFrame) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                graph = Graph(_unit(row["vectors"], row["dim"])).dump()
                yield pa.RecordBatch.from_pylist([{**row, "graph": graph}], pa.schema(
                    [*batch.schema, pa.field("graph", pa.binary())]))

    return shards.mapInArrow(
        build, "label string, dim int, shard int, ids binary, copies binary, vectors binary, graph binary"
    )


class _Forest:
    """Union-find that keeps the edges that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def _root(self, node: int) -> int:
        root = node
        while (up := self.parent.get(root, root)) != root:
            root = up
        while node != root:
            self.parent[node], node = root, self.parent.get(node, node)
        return root

    def join(self, a: int, b: int) -> None:
        x, y = self._root(a), self._root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def search_block(
    graph: Graph, index: np.ndarray, queries: np.ndarray, least: float, recall: float = RECALL
) -> list[np.ndarray]:
    """Rows of the index linked to each query, verified in double precision.
    The beam doubles until the audited queries miss no more than allowed."""
    audited = np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int)
    truth = [np.flatnonzero(index @ queries[at] >= least) for at in audited]
    total = sum(map(len, truth))
    beam = SEARCH_BEAM
    while True:
        found = [graph.within(queries[at], least - SLACK, beam) for at in audited]
        hit = sum(len(np.intersect1d(a, b)) for a, b in zip(found, truth, strict=True))
        if hit >= recall * total or beam >= len(index):
            break
        beam *= 2
    out = []
    for query in queries:
        nodes = np.array(sorted(graph.within(query, least - SLACK, beam)), int)
        out.append(nodes[index[nodes] @ query >= least] if len(nodes) else nodes)
    return out


def _links(pairs: DataFrame, least: float, recall: float) -> DataFrame:
    """Rows of two kinds: (point, n) links found of a query in a shard, copies
    counted, and (point, other) edges of a spanning forest of the block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, queries = _unit(row["vectors"], row["dim"]), _unit(row["q_vectors"], row["dim"])
                ids, copies = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["copies"], "<i8")
                q_ids = np.frombuffer(row["q_ids"], "<i8")
                graph = Graph.load(row["graph"], index)
                forest, counts = _Forest(), []
                for query, nodes in zip(q_ids.tolist(), search_block(graph, index, queries, least, recall), strict=True):
                    nodes = nodes[ids[nodes] != query]
                    counts.append(int(copies[nodes].sum()))
                    for other in ids[nodes].tolist():
                        forest.join(query, other)
                edges = forest.edges
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*q_ids.tolist(), *(a for a, _ in edges)], pa.int64()),
                        pa.array([*counts, *(None for _ in edges)], pa.int64()),
                        pa.array([*(None for _ in counts), *(b for _, b in edges)], pa.int64()),
                    ],
                    names=["point", "n", "other"],
                )

    return pairs.mapInArrow(search, "point long, n long, other long")


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    shard: int = SHARD,
    block: int = BLOCK,
    recall: float = RECALL,
    id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors`.

    Rows with a NULL label, and vectors that are NULL, zero, or hold NULL or
    non-finite components, link with nothing; so do vectors of different
    length. A repeated row counts as one more vector (an id is expected to
    stand for one vector). A row without an id links with nothing and has no
    component. An empty table gives no rows; other columns are ignored.
    """
    rows = only(vectors, vec_id=id, vector=embedding, label=label).select(
        F.col("vec_id").cast("long"), "vector", F.col("label").cast("string").alias("label")
    )
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    found = materialize(
        points(rows).select("label", F.size("vector").alias("dim"), "vector", "point", "copies"), "hnsw-points"
    )
    sizes = found.groupBy("label", "dim").agg(F.count("*").alias("n_points"))
    spread = F.xxhash64("point")
    dealt = found.join(sizes, ["label", "dim"]).select(
        "label",
        "dim",
        "vector",
        "point",
        "copies",
        # By hash, so a part may hold a few more points than its size.
        F.pmod(spread, F.ceil(F.col("n_points") / shard)).cast("int").alias("shard"),
        F.pmod(spread, F.ceil(F.col("n_points") / block)).cast("int").alias("block"),
    )
    shards = materialize(_indexed(_packed(dealt.drop("block"), "shard")), "hnsw-graphs")
    blocks = _packed(dealt.drop("shard"), "block").select(
        "label", "dim", "block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")
    )
    # Few rows of bounded size each: a shard and a block of its label, spread over all tasks.
    pairs = shards.join(blocks, ["label", "dim"])
    pairs = pairs.repartition(F.xxhash64("label", "dim", "shard", "block"))
    links = materialize(_links(pairs.drop("block", "shard"), cosine, recall), "hnsw-links")
    counts = links.where("n is not null").groupBy("point").agg(F.sum("n").alias("n"))
    edges = links.where("other is not null").select(F.col("point").alias("a"), F.col("other").alias("b"))
    components = connected_components(edges)
    by_point = (
        found.join(counts, "point", "left")
        .join(components, F.col("point") == F.col("node"), "left")
        .select(
            F.col("label").alias("p_label"),
            F.col("vector").alias("p_vector"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
            F.coalesce("component", "point").alias("component"),
        )
    )
    with_id = F.col("vec_id").isNotNull()
    joined = rows.join(by_point, with_id & (F.col("label") == F.col("p_label")) & (F.col("vector") == F.col("p_vector")), "left")
    return joined.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"),
    )
