import numpy as np

from waymark.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, n int, point long, component string"


def brute(rows, least=0.98):
    usable = {}
    for n, (i, vector, label) in enumerate(rows):
        if i is None or label is None or vector is None or None in vector:
            continue
        v = np.array(vector, float)
        if np.isfinite(v).all() and v.any():
            v = v / np.abs(v).max()
            usable[n] = (label, v / np.linalg.norm(v))
    links = {n: [m for m in usable if m != n and usable[m][0] == usable[n][0] and len(usable[m][1]) == len(usable[n][1])
                 and usable[m][1] @ usable[n][1] >= least] for n in usable}
    out = []
    for n, (i, _, _) in enumerate(rows):
        reached, ahead = {n}, [n]
        while ahead:
            new = [m for m in links.get(ahead.pop(), ()) if m not in reached]
            reached.update(new)
            ahead += new
        out.append((i, len(links.get(n, ())), min((rows[m][0] for m in reached if rows[m][0] is not None), default=None)))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    frame = spark.createDataFrame([(*row, 1, 2, "c") for row in rows], SCHEMA)
    got = hnsw.near_duplicates(frame, **how).collect()
    assert all(r.kept == (None if r.vec_id is None else r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr)


def corpus(n, seed):
    """Groups of near copies of all sizes, copies, and lone vectors."""
    draw = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        center = draw.normal(size=16)
        for _ in range(int(draw.choice([1, 1, 2, 5, 60]))):
            vector = center + draw.normal(size=16) * draw.choice([0.0, 0.05, 0.12])
            rows.append((len(rows), vector.astype(np.float32).tolist(), int(draw.integers(3))))
    return rows


def test_equal_to_all_pairs(spark):
    rows = corpus(900, 1)
    assert found(spark, rows) == brute(rows)


def test_many_shards_and_blocks(spark):
    rows = corpus(600, 2)
    assert found(spark, rows, shard=64, block=50) == brute(rows)


def test_graph_recall_on_points_without_groups():
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(1_500, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw.Graph(vectors)
    graph = hnsw.Graph.load(graph.dump(), vectors)
    hits = total = 0
    for query in vectors[::10]:
        truth = set(np.flatnonzero(vectors @ query >= 0.9).tolist())
        hits += len(truth & set(graph.within(query, 0.9, 64)))
        total += len(truth)
    assert hits >= 0.97 * total


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
        (6, None, 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1),
        (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [1e-30, 0.0], 1), (15, [1e30, 0.0], 1),
        (None, [1.0, 0.0], 1), (16, [3.0, 3.0], 7), (16, [3.0, 3.0], 7),
    ]
    assert found(spark, rows) == brute(rows)
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
