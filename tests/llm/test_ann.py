import numpy as np
import pytest
from lodestone.llm import ann


def brute(rows, k, every):
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted(((-float(np.cumsum(np.array(v) * np.array(w))[-1]), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def data(n, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    x = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dims))
    x[n // 2 : n // 2 + n // 5] = x[3]
    return [(i, np.float32(v).tolist()) for i, v in enumerate(x)]


def got(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_exact_search_with_ties(spark):
    rows = data(700)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(ann.search(frame, k=7, every=10, shard=150)) == brute(rows, 7, 10)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (40, [1.0, 0.0, 0.0])]
    odd = [(3, None), (60, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, score string, rank int")
    assert got(ann.search(frame)) == brute(rows, 20, 20)
    assert ann.search(frame.limit(0)).collect() == []


@pytest.mark.parametrize("factor", [1.0, 1.3])
def test_relaxed_search_keeps_recall(factor):
    rows = data(3000, 16, 4)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    tree = ann.Tree(ids, x, 10, leaf=32)
    found, _ = tree.search(ids[::20], x[::20], factor)
    want = brute(rows, 10, 20)
    hits = sum(len({i for i, _ in want[q]} & set(f.tolist())) for q, f in zip(ids[::20].tolist(), found, strict=True))
    assert hits >= (1.0 if factor == 1 else 0.9) * 10 * len(found)


def test_repeated_ids_are_one_query_and_as_many_candidates(spark):
    rows = [(20, [2.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.0]), (4, [0.25, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(ann.search(frame, k=3)) == {20: [(3, 1.0), (3, 1.0), (4, 0.5)]}


def test_queries_pass_over_cells_that_are_too_far(spark):
    """Cells far apart: a query goes to few of them, and loses nothing."""
    rng = np.random.default_rng(9)
    centres = 30 * rng.normal(size=(12, 6))
    rows = [(i, np.float32(centres[i % 12] + 0.1 * rng.normal(size=6)).tolist()) for i in range(1200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    used = ann.usable(frame)
    cells = ann.placed(used, {6: centres})
    held = {6: (np.arange(12), centres, np.array([r.r for r in cells.groupBy("cell").agg(ann.F.max("away").alias("r")).orderBy("cell").collect()]))}
    asked = cells.filter("id % 20 = 0").withColumn("kth", ann.F.aggregate("vector", ann.F.lit(0.0), lambda s, x: s + x * x) * 0.95)
    assert ann.routed(asked, held, 1.0).count() < 0.35 * 11 * asked.count()
    assert got(ann.search(frame, k=5, shard=40)) == brute(rows, 5, 20)
