import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.operators import factor, gemm, neighbors, reshard, views
from tilespark.operators.reduce import arg_extreme, reduce
from tilespark.plans import program
from tilespark.sources import matrix
from tilespark.sources.matrix import Meta

rng = np.random.default_rng(1)


def dense(tiles, meta):
    return matrix.to_numpy(matrix.to_cells(tiles, meta), meta.shape)


@pytest.mark.parametrize(("shape", "tile"), [((5, 5), (2, 2)), ((7, 3), (3, 2)), ((1, 4), (1, 4)), ((20, 20), (11, 11))])
def test_ragged_roundtrip_and_reshard(spark, shape, tile):
    a, meta = rng.normal(size=shape), Meta(shape, tile)
    tiles = matrix.from_numpy(spark, a, tile)
    assert np.array_equal(dense(tiles, meta), a)
    again, new = reshard.reshard(tiles, meta, (3, 4))
    assert np.array_equal(dense(again, new), a)


def test_save_and_load(spark, tmp_path):
    a, meta = rng.normal(size=(8, 6)), Meta((8, 6), (4, 4))
    matrix.save(matrix.from_numpy(spark, a, (4, 4)), meta, str(tmp_path / "m"))
    tiles, found = matrix.load(spark, str(tmp_path / "m"))
    assert found == meta and np.array_equal(dense(tiles, found), a)
    assert matrix.free(spark, str(tmp_path / "m"))


@pytest.mark.parametrize("slices", [(1,), ([2],), ([1, 3], None), ([0, None, 2], [1, None]), (None, 2)])
def test_submatrix(spark, slices):
    a, meta = rng.normal(size=(11, 10)), Meta((11, 10), (3, 4))
    cells = matrix.to_cells(matrix.from_numpy(spark, a, (3, 4)), meta)
    found, shape = views.submatrix(cells, meta, *slices)

    def picked(s, n, t, size):
        s = [s, s + 1] if isinstance(s, int) else [0, None] if s is None else [0, s[0]] if len(s) == 1 else s
        return [k for b in range(*slice(*s).indices(n)) for k in range(b * t, min(size, (b + 1) * t))]

    rows = picked(slices[0], 4, 3, 11)
    cols = picked(slices[1] if len(slices) > 1 else None, 3, 4, 10)
    assert shape.shape == (len(rows), len(cols))
    assert np.array_equal(matrix.to_numpy(found, shape.shape), a[np.ix_(rows, cols)])


def test_chain_order():
    assert gemm.chain_order([(10, 100), (100, 5), (5, 50)]) == ((0, 1), 2)
    assert gemm.chain_order([(50, 5), (5, 100), (100, 10)]) == (0, (1, 2))


@pytest.mark.parametrize(("n", "tile"), [(12, 4), (13, 4), (9, 2), (4, 4)])
def test_factorisations(spark, n, tile):
    x = rng.normal(size=(n, n))
    a, meta = x @ x.T + n * np.eye(n), Meta((n, n), (tile, tile))
    tiles = matrix.from_numpy(spark, a, (tile, tile))
    low = dense(factor.cholesky(tiles, meta, tiled=True), meta)
    assert np.allclose(low, np.linalg.cholesky(a))
    r = dense(factor.qr(matrix.from_numpy(spark, x, (tile, tile)), meta, tiled=True), meta)
    assert np.allclose(r, np.triu(r)) and np.allclose(r.T @ r, x.T @ x)
    for tiled in (True, False):
        band = factor.bdfac(matrix.from_numpy(spark, x, (tile, tile)), meta, tiled=tiled)
        assert all(0 <= r.bj - r.bi <= 1 for r in band.select("bi", "bj").collect())
        assert np.allclose(np.linalg.svd(dense(band, meta), compute_uv=False), np.linalg.svd(x, compute_uv=False))
    b = rng.normal(size=(n, 2))
    found = factor.posv(tiles, meta, matrix.from_numpy(spark, b, (tile, 2)), tiled=True)
    assert np.allclose(dense(found, Meta((n, 2), (tile, 2))), np.linalg.solve(a, b))


def test_sparse_cholesky_fills_in(spark):
    a = np.eye(6) * 4
    a[0, :] = a[:, 0] = 1
    a[0, 0] = 9
    tiles = matrix.from_numpy(spark, a, (2, 2)).where("exists(data, x -> x <> 0)")
    meta = Meta((6, 6), (2, 2))
    assert np.allclose(dense(factor.cholesky(tiles, meta, tiled=True), meta), np.linalg.cholesky(a))


@pytest.mark.parametrize(("rows", "parts"), [(40, 1), (40, 7), (3, 2), (0, 1)])
def test_tsqr(spark, rows, parts):
    from pyspark.sql import functions as F

    x = rng.normal(size=(rows, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "vec array<double>").repartition(parts)
    r = matrix.to_numpy(factor.tsqr(df, F.col("vec"), 5), (5, 5))
    assert np.allclose(r.T @ r, x.T @ x) and (np.diag(r) >= 0).all()


def test_argmin_counts_absent_cells(spark):
    a = np.array([[1.0, 2, 3], [0, 5, 0], [-1, 0, 4], [2, 0, 1]])
    cells = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, v double")
    for large, f in ((False, np.argmin), (True, np.argmax)):
        found = {r.i: r["at"] for r in arg_extreme(cells, "i", 3, large).collect()}
        assert found == dict(enumerate(f(a, axis=1).tolist()))
    assert {r.i: r.v for r in reduce(cells, "min", "i", 3).collect()} == dict(enumerate(a.min(axis=1)))
    assert {r.i: r.v for r in reduce(cells, "prod", "i", 3).collect()} == {0: 6, 1: 0, 2: 0, 3: 0}


def test_distances_of_rows_without_a_common_column(spark):
    x, y = np.array([[3.0, 0], [0, 4]]), np.array([[3.0, 0], [0, 4], [1, 1]])
    cells = [matrix.to_cells(matrix.from_numpy(spark, a, (2, 2)), Meta(a.shape, (2, 2))).where("v <> 0") for a in (x, y)]
    found = matrix.to_numpy(neighbors.distances(*cells), (2, 3))
    assert neighbors.distances(*cells).count() == 6
    assert np.allclose(found, ((x[:, None] - y[None]) ** 2).sum(2))


@pytest.mark.parametrize(("blocks", "truncate"), [(3, 0), (5, 2)])
def test_orthogonal_factors(spark, blocks, truncate):
    n = 3 * blocks - 1
    x, meta = rng.normal(size=(n, n)), Meta((n, n), (3, 3))
    tiles = matrix.from_numpy(spark, x, (3, 3))
    eye = matrix.from_numpy(spark, np.eye(n), (3, 3))
    band, rest, q, p = factor.bdfac_factors(tiles, meta, truncate)
    left, right = (dense(o.times(eye, meta), meta) for o in (q, p))
    assert np.allclose(left.T @ left, np.eye(n)) and np.allclose(right.T @ right, np.eye(n))
    middle = dense(band.unionByName(rest), meta)
    assert np.allclose(left @ middle @ right.T, x)
    steps = 3 * (blocks - truncate)
    assert np.allclose(middle[:steps], np.triu(middle[:steps])) and rest.isEmpty() == (truncate == 0)
    assert np.allclose(dense(factor.bdfac(tiles, meta, truncate, tiled=True), meta)[:steps], middle[:steps])
    assert np.allclose(dense(q.times(eye, meta, transposed=True), meta), left.T)
    assert q.reflectors().count() > 0


def test_qr_of_a_tall_matrix_gives_both_factors(spark):
    x, meta = rng.normal(size=(10, 4)), Meta((10, 4), (2, 2))
    r, q = factor.qr_factors(matrix.from_numpy(spark, x, (2, 2)), meta)
    whole = np.zeros((10, 4))
    found = dense(r, meta)
    whole[: len(found)] = found
    back = dense(q.times(matrix.from_numpy(spark, whole, (2, 2)), meta), meta)
    assert np.allclose(back, x)


def test_saved_matrices(spark, tmp_path):
    a, meta = rng.normal(size=(5, 7)), Meta((5, 7), (2, 3))
    matrix.save(matrix.from_numpy(spark, a, (2, 3)), meta, str(tmp_path / "one"))
    assert matrix.exists(spark, str(tmp_path / "one")) and not matrix.exists(spark, str(tmp_path / "two"))
    assert [(r.path.rsplit("/", 1)[1], r.shape, r.tile) for r in matrix.saved(spark, str(tmp_path)).collect()] == [("one", [5, 7], [2, 3])]
    assert matrix.saved(spark, str(tmp_path / "none")).collect() == []
    line = {r.j: r.v for r in matrix.load_line(spark, str(tmp_path / "one"), 3).collect()}
    assert [line[j] for j in range(7)] == a[3].tolist()


def test_an_absent_diagonal_tile_is_an_error(spark):
    tiles = matrix.from_numpy(spark, np.eye(4), (2, 2)).where("bi = 0")
    with pytest.raises(np.linalg.LinAlgError):
        factor.cholesky(tiles, Meta((4, 4), (2, 2)), tiled=True)


def test_compiler_refuses_what_it_does_not_know(spark):
    for body in ("A[i] = f(B[k])", "i = 3", "A[i] = f(B['x'])"):
        with pytest.raises((NameError, SyntaxError)):
            program.compiled(f"def f(A, B, N):\n    for i in range(N):\n        {body}", ("B",), ("A",), N=3)
    p = program.compiled("def f(A, B, N):\n    for i in range(N):\n        A[i] = unheard_of(B[i])", ("B",), ("A",), N=3)
    with pytest.raises(KeyError):
        program.flops(p, spark, 8)


GRAPHS = [
    (program.gemm_program(4, 4, 4), 96, 80, 64, 16), (program.cholesky_program(4), 20, 30, 1, 10), (program.cholesky_program(16), 816, 2040, 1, 136),
    (program.tsqr_program(8), 15, 14, 8, 15), (program.tsqr_program(16), 31, 30, 16, 31), (program.qr_program(4), 59, 99, 4, 23),
    (program.qr_program(8), 426, 859, 8, 97), (program.bdfac_program(4), 88, 164, 4, 27), (program.bdfac_program(8), 730, 1574, 8, 123),
]


@pytest.mark.parametrize(("p", "tasks", "edges", "starters", "terminators"), GRAPHS)
def test_task_graphs(spark, p, tasks, edges, starters, terminators):
    assert (p.tasks(spark).count(), p.edges(spark).count(), p.starters(spark).count(), p.terminators(spark).count()) == (tasks, edges, starters, terminators)
    assert p.doubly_written(spark).isEmpty()


def exchanged_rows(df):
    """The most rows that an exchange of the run moved."""

    def below(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plan = plan.executedPlan()
        own = [plan.metrics().apply("shuffleRecordsWritten").value()] if plan.nodeName() == "Exchange" else []
        inner = [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(k) for k in range(plan.children().size())]
        return own + [x for p in inner for x in below(p)]

    df.collect()
    return max(below(df._jdf.queryExecution().executedPlan()), default=0)


def test_pairs_over_few_columns_are_not_shuffled(spark):
    a = rng.integers(0, 3, (40, 4))
    cells = spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, v long").localCheckpoint()
    whole, used = a @ a.T, a != 0
    there = used.astype(int) @ used.T.astype(int) > 0
    products = {
        "gemm": (gemm.gemm(cells, cells, transpose_y=True), there), "syrk": (gemm.syrk_lower(cells), np.tril(there)),
        "missing": (gemm.gemm_missing(cells, views.transpose(cells), cells.where("false"), (10, 10)), there),
    }
    for name, (found, wanted) in products.items():
        assert {(r.i, r.j): r.v for r in found.collect()} == {(i, j): whole[i, j] for i, j in zip(*np.nonzero(wanted))}, name
        assert exchanged_rows(found) <= cells.count(), name
    assert exchanged_rows(neighbors.distances(cells, cells)) <= cells.count()


def test_rows_that_are_too_many_to_broadcast(spark, monkeypatch):
    a = rng.integers(1, 3, (12, 3))
    cells = spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, v long")
    monkeypatch.setattr(gemm, "MOST_BROADCAST", 4)
    for found in (gemm.gemm(cells, cells, transpose_y=True), gemm.gemm_missing(cells, views.transpose(cells), cells.where("false"), (5, 5))):
        assert {(r.i, r.j): r.v for r in found.collect()} == {(i, j): (a @ a.T)[i, j] for i in range(12) for j in range(12)}


def test_grid_of_a_parent_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(matrix, "STRETCH", 7)
    rows = [(0, 0, 5), (0, 6, 6), (0, 7, None), (2, 19, 8), (2, 3, 9), (2, 3, 10), (9, 0, 1), (1, 20, 1), (None, 1, 1)]
    cells = spark.createDataFrame(rows, "i long, j long, v long")
    found = matrix.with_parent(cells, Meta((4, 20), (2, 2)), -F.col("i") * 100 - F.col("j"))
    wanted = [(i, j, v) for i in range(4) for j in range(20) for v in ([c if c is not None else -i * 100 - j for a, b, c in rows if (a, b) == (i, j)] or [-i * 100 - j])]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert exchanged_rows(found) < 20


def bytes_a_row(df, path):
    df.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / df.sparkSession.read.parquet(str(path)).count()


def test_written_distances_and_products_are_small(spark, tmp_path):
    few = spark.range(50).selectExpr("id AS i", "0L AS j", "1L AS v")
    many = spark.range(40_000).selectExpr("id AS i", "0L AS j", "1L AS v")
    assert bytes_a_row(neighbors.distances(few, many), tmp_path / "distances") < 1
    assert bytes_a_row(gemm.gemm(few, many, transpose_y=True), tmp_path / "products") < 1


def test_written_grid_is_small(spark, tmp_path):
    cells = spark.range(50).selectExpr("id AS i", "id * 7 AS j", "id AS v")
    whole = matrix.with_parent(cells, matrix.Meta((50, 40_000), (10, 10)), F.lit(-1).cast("long"))
    assert bytes_a_row(whole, tmp_path / "grid") < 1
    found = spark.read.parquet(str(tmp_path / "grid"))
    assert found.count() == found.select("i", "j").distinct().count() == 2_000_000
    assert found.where("i BETWEEN 0 AND 49 AND j BETWEEN 0 AND 39999").count() == 2_000_000
    assert sorted(tuple(r) for r in found.where("v >= 0").collect()) == [(k, 7 * k, k) for k in range(50)]
