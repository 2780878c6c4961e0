import numpy as np
import pytest
from pyspark.sql import functions as F

from gigmatch.llm import neighbours


def brute(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), d[i]) for i in order]
    return out


def compare(got, want):
    hit = 0
    for q, near in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == list(range(1, len(near) + 1))
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hit += len({i for i, _ in near} & {r[1] for r in mine})
    return hit / sum(map(len, want.values()))


def test_recall_on_the_table(spark, sf1):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf1}/embeddings.parquet").collect()]
    got = neighbours.op2_learned_partition_search(spark, sf1).collect()
    assert compare(got, brute(rows, 100, 10)) >= 0.9


def test_recall_with_many_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 2
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(df, every=20, part_rows=150).collect()
    assert compare(got, brute(rows, 20, 10)) >= 0.9


def test_few_rows_are_visited_where_vectors_have_structure(spark, monkeypatch):
    kept = {}

    def keep(df, name, write=neighbours.materialise):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(neighbours, "materialise", keep)
    rng = np.random.default_rng(4)
    centres, share = rng.normal(size=(30, 24)) * 2, rng.dirichlet(np.ones(30) * 2)
    cluster = rng.choice(30, 6000, p=share)
    rows = [(i, (centres[c] + rng.normal(size=24)).tolist()) for i, c in enumerate(cluster)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, every=20, part_rows=100).collect()
    assert compare(got, brute(rows, 20, 10)) >= 0.9
    sizes = {r["part"]: r["count"] for r in kept["vectors-index"].groupBy("part").count().collect()}
    visits = [sizes.get(r["part"], 0) for r in kept["vectors-queries"].select("part").collect()]
    assert sum(visits) < 0.25 * 300 * 6000


def test_visits_end_at_the_total_and_not_before_enough_ids():
    odds, held = np.log([0.2, 0.5, 0.3]), np.array([1, 2, 9])
    router = neighbours.Router(np.zeros(2), np.ones(2), np.zeros((2, 4)), np.zeros(4), np.zeros((4, 3)), odds, mass=0.6)
    visited = lambda least: [p.tolist() for p in router.visited(np.ones((2, 2)), held, least)]
    assert visited(1) == [[1, 2]] * 2
    router.mass = 0.1
    assert visited(2) == [[1]] * 2 and visited(3) == [[1, 2]] * 2 and visited(12) == [[1, 2, 0]] * 2 and visited(99) == [[1, 2, 0]] * 2


def test_huge_and_close_vectors_keep_exact_order(spark):
    rows = [(i * 100, [1e8 + i * 1e-3, 1.0]) for i in range(40)] + [(5000 + i, [1e200, float(i)]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with np.errstate(over="ignore"):
        assert compare(neighbours.search(df).collect(), brute(rows, 100, 10)) == 1.0


def test_copies_ties_and_bad_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(0, 60)] + [(100, [1.0, 2.5]), (101, [1.0, nan]), (102, [inf, 1.0]), (103, None), (104, [0.0, 0.0]), (105, [None, 1.0]), (200, [-1.0, 2.0]), (200, [-1.0, 2.0])]
    df = spark.createDataFrame([(*r, 9, 1.0) for r in rows], "vec_id long, embedding array<float>, part int, score double")
    got = neighbours.search(df).collect()
    assert sorted({r.query_id for r in got}) == [0, 100, 200]
    first = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 0)
    assert first == [(i, i, 0.0) for i in range(1, 11)]
    near = sorted((r.rank, r.vec_id) for r in got if r.query_id == 100)
    assert near == [(i + 1, i) for i in range(10)]


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(i * 100, [1.0 + i, 0.0]) for i in range(n)], "vec_id long, embedding array<double>")
    assert neighbours.search(df).count() == n * max(n - 1, 0)


def test_parts_are_balanced():
    x = np.random.default_rng(2).normal(size=(500, 8))
    near = neighbours._nearest(x, x, 5, np.arange(500))
    sizes = np.bincount(neighbours.balanced_parts(x, near, 10), minlength=10)
    assert sizes.sum() == 500 and sizes.max() <= np.ceil(50 * 1.05)


def test_usable_keeps_the_usual_length(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in neighbours.usable(df).select(F.col("vec_id")).collect()) == [1, 2]
