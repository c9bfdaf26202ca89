import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalore.operators import search as Q
from stratalore.operators import vector_matrix as M

SCHEMA = "chunk_id long, vector array<double>, codes string, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", -1) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 24))
    x = centers[rng.integers(0, 40, 3000)] + 0.35 * rng.normal(size=(3000, 24))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def top(x, q, k=10):
    s = x @ (q / np.linalg.norm(q))
    return np.lexsort((np.arange(len(x)), -s))[:k].tolist()


def test_few_cells_answer_nearly_all(spark, points):
    matrix = M.VectorMatrix.create(table(spark, enumerate(points)), cells=50)
    rng = np.random.default_rng(2)
    hits = total = 0
    for q in points[rng.integers(0, len(points), 12)] + 0.1 * rng.normal(size=(12, 24)):
        got = matrix.search(q.tolist(), 10, cells=8).collect()
        want = top(points, q)
        hits, total = hits + len(set(want) & {r.chunk_id for r in got}), total + 10
        assert all(r.score == pytest.approx(points[r.chunk_id] @ q / np.linalg.norm(q), abs=1e-9) for r in got)
    assert hits >= 0.95 * total
    # Eight of the cells are read: their files and no others.
    files = {f.split("cell=")[1].split("/")[0] for f in matrix._rows(matrix.nearest_cells(points[0].tolist(), 8)).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(files) == 8
    exact = matrix.search(points[5].tolist(), 10)
    assert [r.chunk_id for r in exact.collect()] == top(points, points[5])
    plain = Q.vector_search(table(spark, enumerate(points)), points[5].tolist(), 10)
    assert [tuple(r) for r in exact.collect()] == [tuple(r) for r in plain.collect()]


def test_code_scores_are_close(points):
    codes, scale, offset = M.encoded(points)
    stand = codes * scale[:, None] + offset[:, None]
    got = M.code_scores(codes, scale, offset, codes.sum(axis=1, dtype=np.int64), np.linalg.norm(stand, axis=1), points[0])
    assert np.abs(got - points @ points[0]).max() < 0.01


def test_appending_replacing_and_deleting(spark, points):
    x = points[:300].copy()
    matrix = M.VectorMatrix.create(table(spark, enumerate(x[:200])), cells=10)
    x[7] = x[250]
    matrix = matrix.append(table(spark, [(7, x[7]), *((i, x[i]) for i in range(200, 300))]))
    matrix = matrix.delete(spark.createDataFrame([(i,) for i in (250, 3, 9999)], "chunk_id long"))
    left = [i for i in range(300) if i not in (250, 3)]

    def check(m):
        for q in (x[7], x[100], x[299]):
            want = [left[i] for i in top(x[left], q)]
            assert [r.chunk_id for r in m.search(q.tolist(), 10).collect()] == want
            assert [r.chunk_id for r in m.search(q.tolist(), 10, cells=10).collect()] == want
        assert m.vectors.count() == len(left)

    check(matrix)
    check(M.VectorMatrix.load(spark, matrix.path))
    small = matrix.compact()
    check(small)
    assert len(small.folders) == 1 and not small.deleted
    back = small.append(table(spark, [(250, x[250])]))
    assert back.vectors.count() == len(left) + 1
    with pytest.raises(Exception, match="(?i)exists"):
        small.append(table(spark, [(1, x[1])]))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [])]
    matrix = M.VectorMatrix.create(table(spark, rows), cells=2)
    assert sorted(r.chunk_id for r in matrix.vectors.collect()) == [1, 2, 8]
    assert [r.chunk_id for r in matrix.search([2.0, 0.0]).collect()] == [1, 2, 8]
    assert matrix.search([0.0, 0.0]).count() == 0 and matrix.search([1.0, 0.0, 0.0]).count() == 0
    assert sorted(r.chunk_id for r in matrix.append(table(spark, [(10, [1.0, 2.0, 3.0]), (11, [0.5, 0.5])])).vectors.collect()) == [1, 2, 8, 11]
    empty = M.VectorMatrix.create(table(spark, []))
    assert empty.search([1.0]).count() == 0 and empty.vectors.count() == 0
    assert empty.append(table(spark, [(1, [1.0])])).search([1.0]).count() == 1
