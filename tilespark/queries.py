"""A query for each operator, over whole tables, and the same in SQL.

Inputs: E, the embeddings as cells in ten-thousandths; Q, the quantity of each part from each supplier; U, the events of each
user by type. Integers keep sums exact in any order. The SQL of each input is a CTE; a query's SQL follows it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels
from .operators import elementwise, factor, gemm, intervals, neighbors, reduce, reshard, views
from .plans import program
from .session import shared_folder
from .sources import matrix
from .sources.matrix import Meta
from .streaming import gram as streaming

WIDTH = 64
TYPES = ("click", "error", "purchase", "signup", "view")
QUANT = "CAST(floor(CAST({x} AS DOUBLE) * 10000 + 0.5) AS BIGINT)"

CTES = {
    "E": f"E AS (SELECT vec_id AS i, t.j AS j, {QUANT.format(x='embedding[t.j + 1]')} AS v FROM embeddings, range(0, {WIDTH}) t(j))",
    "Q": "Q AS (SELECT l_partkey AS i, l_suppkey AS j, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL)",
    "U": "U AS (SELECT user_id AS i, CAST(CASE event_type " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(TYPES)) + " END AS BIGINT) AS j, count(*) AS v FROM events GROUP BY ALL)",
    "G": "G AS (SELECT a.j AS i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM E a JOIN E b USING (i) GROUP BY ALL)",
    "U2": "U2 AS (SELECT i + 1 AS i, j, v FROM U WHERE j <> 2)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, ctes: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            names = ctes.split()
            ORACLE_SQL[name] = ("WITH " + ", ".join(CTES[c] for c in names) + " " if names else "") + sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def e_cells(s: SparkSession, d: str) -> DataFrame:
    return matrix.cells_from_rows(table(s, d, "embeddings"), "vec_id", "embedding", lambda x: F.floor(x.cast("double") * 10000 + 0.5).cast("long"))


def q_cells(s: SparkSession, d: str) -> DataFrame:
    return matrix.cells_from_table(table(s, d, "lineitem"), "l_partkey", "l_suppkey", F.sum("l_quantity").cast("long"))


def u_cells(s: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(*[F.when(F.col("event_type") == t, k) for k, t in enumerate(TYPES)])
    return matrix.cells_from_table(table(s, d, "events").select("user_id", code.alias("code")), "user_id", "code", F.count(F.lit(1)))


def u2_cells(s: SparkSession, d: str) -> DataFrame:
    return u_cells(s, d).where("j <> 2").withColumn("i", F.col("i") + 1)


def e_meta(s: SparkSession, d: str, tile: tuple[int, int] = (100, 16)) -> Meta:
    return Meta((table(s, d, "embeddings").count(), WIDTH), tile)


def q_meta(s: SparkSession, d: str) -> Meta:
    return Meta((table(s, d, "part").count(), table(s, d, "supplier").count()), (250, 7))


def e_gram(s: SparkSession, d: str) -> DataFrame:
    return gemm.gram(e_cells(s, d))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else c for c in df.columns])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("v", F.round(F.col("v") + 0.0, digits))


# Sources and block access

query("cells_from_rows", "E", "SELECT i, j, v FROM E")(e_cells)


@query("tiles_roundtrip", "E", "SELECT i, j, CAST(v AS DOUBLE) AS v FROM E")
def _(s, d):
    meta = e_meta(s, d, (101, 30))
    return matrix.to_cells(matrix.to_tiles(e_cells(s, d), meta), meta)


_GRID = "SELECT CAST(a.bi AS INTEGER) AS bi, CAST(b.bj AS INTEGER) AS bj, CAST(least(250, n.m - a.bi * 250) AS INTEGER) AS nrows, CAST(least(7, n.k - b.bj * 7) AS INTEGER) AS ncols FROM (SELECT (SELECT count(*) FROM part) AS m, (SELECT count(*) FROM supplier) AS k) n, range(0, 1 + (n.m - 1) // 250) a(bi), range(0, 1 + (n.k - 1) // 7) b(bj)"
_HELD = "(bi, bj) {} (SELECT i // 250, j // 7 FROM Q WHERE v > 150)"


@query("block_grid", "", _GRID)
def _(s, d):
    return matrix.block_grid(s, q_meta(s, d))


@query("blocks_existing", "Q", f"SELECT * FROM ({_GRID}) WHERE {_HELD.format('IN')}")
def _(s, d):
    return matrix.blocks_existing(q_cells(s, d).where("v > 150"), q_meta(s, d))


@query("blocks_missing", "Q", f"SELECT * FROM ({_GRID}) WHERE {_HELD.format('NOT IN')}")
def _(s, d):
    return matrix.blocks_missing(q_cells(s, d).where("v > 150"), q_meta(s, d))


@query("get_block", "E", "SELECT i, j, v FROM E WHERE i BETWEEN 200 AND 299 AND j BETWEEN 16 AND 31")
def _(s, d):
    return views.get_block(e_cells(s, d), e_meta(s, d), 2, 1)


@query("get_row", "Q", "SELECT i, j, v FROM Q WHERE i BETWEEN 250 AND 499")
def _(s, d):
    return views.get_rows(q_cells(s, d), q_meta(s, d), [1])


@query("get_rows", "Q", "SELECT i, j, v FROM Q WHERE i // 250 IN (0, 3)")
def _(s, d):
    return views.get_rows(q_cells(s, d), q_meta(s, d), [0, 3])


@query("get_col", "Q", "SELECT i, j, v FROM Q WHERE j // 7 = 2")
def _(s, d):
    return views.get_col(q_cells(s, d), q_meta(s, d), 2)


@query("get_line", "E", "SELECT i, j, v FROM E WHERE i = 203")
def _(s, d):
    return views.get_line(e_cells(s, d), 203)


@query("load_line", "E", "SELECT i, j, CAST(v AS DOUBLE) AS v FROM E WHERE i = 203")
def _(s, d):
    meta = e_meta(s, d)
    path = f"{shared_folder(s)}/saved-{uuid.uuid4().hex}"
    matrix.save(matrix.to_tiles(e_cells(s, d), meta), meta, path)
    return matrix.load_line(s, path, 203)


@query("saved_list", "", f"SELECT name, n || ',{WIDTH}' AS shape, '100,' || w AS tile FROM (SELECT count(*) AS n FROM embeddings) CROSS JOIN (VALUES ('narrow', 8), ('wide', 16)) t(name, w)")
def _(s, d):
    folder = f"{shared_folder(s)}/saved-{uuid.uuid4().hex}"
    for name, width in (("narrow", 8), ("wide", 16)):
        meta = e_meta(s, d, (100, width))
        matrix.save(matrix.to_tiles(e_cells(s, d), meta), meta, f"{folder}/{name}")
    return matrix.saved(s, folder).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("shape", "tile")])


# Views


@query("submatrix_range", "E", "SELECT i - 100 AS i, j - 16 AS j, v FROM E WHERE i BETWEEN 100 AND 299 AND j BETWEEN 16 AND 47")
def _(s, d):
    return views.submatrix(e_cells(s, d), e_meta(s, d), [1, 3], [1, 3])[0]


@query("submatrix_step", "E", "SELECT (i // 200) * 100 + i % 100 AS i, ((j - 16) // 32) * 16 + j % 16 AS j, v FROM E WHERE (i // 100) % 2 = 0 AND (j // 16) % 2 = 1")
def _(s, d):
    return views.submatrix(e_cells(s, d), e_meta(s, d), [0, None, 2], [1, 4, 2])[0]


@query("submatrix_multi", "E", "SELECT i, j - 48 AS j, v FROM E WHERE i < 300 AND j >= 48")
def _(s, d):
    return views.submatrix(e_cells(s, d), e_meta(s, d), [3], 3)[0]


@query("view_blocks_missing", "Q", "SELECT CAST(a.bi AS INTEGER) AS bi, CAST(b.bj AS INTEGER) AS bj FROM (SELECT (SELECT count(*) FROM part) AS m, (SELECT count(*) FROM supplier) AS k) n, range(0, 1 + (n.k - 1) // 7) a(bi), range(0, (2 + (n.m - 1) // 250) // 2) b(bj) WHERE (bi, bj) NOT IN (SELECT j // 7, i // 500 FROM Q WHERE v > 150 AND (i // 250) % 2 = 0)")
def _(s, d):
    """The missing blocks of a transposed view of every second block row."""
    cells, meta = views.submatrix(q_cells(s, d).where("v > 150"), q_meta(s, d), [0, None, 2])
    return matrix.blocks_missing(views.transpose(cells), Meta(meta.shape[::-1], meta.tile[::-1])).select("bi", "bj")


@query("subtensor", "", "SELECT user_id - 16 AS x, d // 14 * 7 + d % 7 AS y, z - 6 AS z, v FROM (SELECT user_id, CAST(extract(day FROM ts) AS BIGINT) AS d, CAST(extract(hour FROM ts) AS BIGINT) AS z, count(*) AS v FROM events GROUP BY ALL) WHERE user_id BETWEEN 16 AND 47 AND d // 7 IN (0, 2, 4) AND z >= 6")
def _(s, d):
    """A strided view over three axes: users, every second week, the hours from six on."""
    cells = table(s, d, "events").groupBy(F.col("user_id").alias("x"), F.dayofmonth("ts").cast("long").alias("y"), F.hour("ts").cast("long").alias("z")).agg(F.count(F.lit(1)).alias("v"))
    n = table(s, d, "events").agg(F.max("user_id")).first()[0] + 1
    return views.submatrix(cells, Meta((n, 32, 24), (16, 7, 6)), [1, 3], [0, None, 2], [1, None], axes=("x", "y", "z"))[0]


@query("transpose", "E", "SELECT j AS i, i AS j, v FROM E")
def _(s, d):
    return views.transpose(e_cells(s, d))


@query("transpose_submatrix", "E", "SELECT j AS i, i - 100 AS j, v FROM E WHERE i BETWEEN 100 AND 199")
def _(s, d):
    return views.transpose(views.submatrix(e_cells(s, d), e_meta(s, d), 1)[0])


@query("permute_rows", "E", "SELECT CASE WHEN i < 100 THEN 99 - i ELSE i END AS i, j, v FROM E")
def _(s, d):
    swap = s.range(100).select(F.col("id").alias("src"), (99 - F.col("id")).alias("dst"))
    return views.permute_rows(e_cells(s, d), swap)


@query("put_overlay", "U U2", "SELECT i, j, v FROM U2 UNION ALL SELECT i, j, v FROM U WHERE (i, j) NOT IN (SELECT i, j FROM U2)")
def _(s, d):
    return views.put(u_cells(s, d), u2_cells(s, d))


@query("delete_block", "Q", "SELECT i, j, v FROM Q WHERE NOT (i // 250 = 1 AND j // 7 = 1)")
def _(s, d):
    return views.delete_block(q_cells(s, d), q_meta(s, d), 1, 1)


@query("ridge", "E G", "SELECT i, j, CASE WHEN i = j THEN v + 1000 ELSE v END AS v FROM G")
def _(s, d):
    return views.with_ridge(e_gram(s, d), F.lit(1000))


@query("parent_constant", "Q", "SELECT a.i, b.j, coalesce(v, -1) AS v FROM range(0, (SELECT count(*) FROM part)) a(i) CROSS JOIN range(0, (SELECT count(*) FROM supplier)) b(j) LEFT JOIN Q ON Q.i = a.i AND Q.j = b.j")
def _(s, d):
    return matrix.with_parent(q_cells(s, d), q_meta(s, d), F.lit(-1).cast("long"))


_TILE_SUMS = "SELECT CAST(i // {a} AS INTEGER) AS bi, CAST(j // {b} AS INTEGER) AS bj, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM E GROUP BY ALL"


def _tile_sums(tiles):
    total = F.aggregate("data", F.lit(0.0), lambda x, v: x + v)
    return tiles.select("bi", "bj", F.size("data").cast("long").alias("n"), total.cast("long").alias("total"))


@query("reshard_down", "E", _TILE_SUMS.format(a=50, b=4))
def _(s, d):
    meta = e_meta(s, d)
    return _tile_sums(reshard.reshard_down(matrix.to_tiles(e_cells(s, d), meta), meta, (2, 4))[0])


@query("reshard_general", "E", _TILE_SUMS.format(a=77, b=9))
def _(s, d):
    meta = e_meta(s, d)
    return _tile_sums(reshard.reshard(matrix.to_tiles(e_cells(s, d), meta), meta, (77, 9))[0])


@query("reshard_tensor", "", "SELECT user_id // 16 AS b0, CAST(extract(day FROM ts) AS BIGINT) // 7 AS b1, CAST(extract(hour FROM ts) AS BIGINT) // 6 AS b2, count(DISTINCT (user_id, extract(day FROM ts), extract(hour FROM ts))) AS n, count(*) AS total FROM events GROUP BY ALL")
def _(s, d):
    cells = table(s, d, "events").groupBy(F.col("user_id").alias("x"), F.dayofmonth("ts").cast("long").alias("y"), F.hour("ts").cast("long").alias("z")).agg(F.count(F.lit(1)).alias("v"))
    tiles = reshard.reshard_tensor(cells, ["x", "y", "z"], (16, 7, 6))
    return tiles.select("b0", "b1", "b2", F.size("cells").cast("long").alias("n"), F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + c["v"]).alias("total"))


@query("get_blocks", "Q", "SELECT i, j, v FROM Q WHERE i // 250 IN (0, 2) AND j // 7 IN (1, 3, 4)")
def _(s, d):
    return views.get_blocks(q_cells(s, d), q_meta(s, d), [0, 2], [1, 3, 4])


@query("put_missing", "Q", "SELECT i, j, v FROM Q WHERE i < 100 UNION ALL SELECT i, j, v * 2 FROM Q WHERE i // 250 > 0 OR j // 7 NOT IN (SELECT j // 7 FROM Q WHERE i < 100)")
def _(s, d):
    q = q_cells(s, d)
    return views.put_missing(q.where("i < 100"), q.withColumn("v", F.col("v") * 2), q_meta(s, d))


@query("put_row", "E", "SELECT i, j, CASE WHEN i BETWEEN 100 AND 199 THEN i - 100 + j ELSE v END AS v FROM E")
def _(s, d):
    row = s.range(100).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WIDTH - 1).cast("long"))).alias("j"))
    return views.put_row(e_cells(s, d), e_meta(s, d), 1, row.withColumn("v", F.col("i") + F.col("j")))


@query("put_col", "E", "SELECT i, j, CASE WHEN j BETWEEN 16 AND 31 THEN i * 100 + j - 16 ELSE v END AS v FROM E")
def _(s, d):
    col = table(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("j"))
    return views.put_col(e_cells(s, d), e_meta(s, d), 1, col.withColumn("v", F.col("i") * 100 + F.col("j")))


@query("from_lower", "E G", "SELECT i, j, v FROM G")
def _(s, d):
    return views.from_lower(views.transpose(gemm.gram_upper(e_cells(s, d))))


@query("without_zeros", "E", "SELECT i, j, v // 200 AS v FROM E WHERE v // 200 <> 0")
def _(s, d):
    return views.without_zeros(elementwise.unary(e_cells(s, d), lambda v: F.call_function("div", v, F.lit(200).cast("long"))))


@query("saved_and_loaded", "E", "SELECT i, j, CAST(v AS DOUBLE) AS v FROM E")
def _(s, d):
    meta = e_meta(s, d)
    path = f"{shared_folder(s)}/saved-{uuid.uuid4().hex}"
    matrix.save(matrix.to_tiles(e_cells(s, d), meta), meta, path)
    return matrix.to_cells(*matrix.load(s, path))


# Products


@query("gemm", "E Q", "SELECT a.j AS i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM E a JOIN Q b ON a.i = b.i GROUP BY ALL")
def _(s, d):
    return gemm.gemm(e_cells(s, d), q_cells(s, d), transpose_x=True)


@query("gemm_transposed", "U", "SELECT a.i AS i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM U a JOIN U b ON a.j = b.j GROUP BY ALL")
def _(s, d):
    u = u_cells(s, d)
    return gemm.gemm(u, u, transpose_y=True)


query("gram", "E G", "SELECT i, j, v FROM G")(e_gram)


@query("gram_rows", "E G", "SELECT i, j, v FROM G")
def _(s, d):
    rows = table(s, d, "embeddings").select(F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000 + 0.5).cast("double")).alias("vec"))
    return longs(gemm.gram_rows(rows, "vec", WIDTH), "v")


@query("gemv", "Q", "SELECT i, CAST(sum(v * (j + 1)) AS BIGINT) AS v FROM Q GROUP BY ALL")
def _(s, d):
    x = table(s, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") + 1).alias("v"))
    return gemm.gemv(q_cells(s, d), x)


@query("syrk_lower", "U", "SELECT a.i AS i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM U a JOIN U b ON a.j = b.j AND b.i <= a.i GROUP BY ALL")
def _(s, d):
    return gemm.syrk_lower(u_cells(s, d))


@query("matrix_chain", "U", "SELECT a.i AS i, c.j AS j, CAST(sum(a.v * g.v * c.v) AS BIGINT) AS v FROM U a JOIN (SELECT x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM U x JOIN U y ON x.i = y.i GROUP BY ALL) g ON a.j = g.i JOIN U c ON c.i = g.j GROUP BY ALL")
def _(s, d):
    u = u_cells(s, d)
    n = table(s, d, "events").select("user_id").distinct().count()
    return longs(gemm.matrix_chain([u, views.transpose(u), u, u], [(n, 5), (5, n), (n, 5), (n, 5)]), "v")


@query("gemm_tiled", "E G", "SELECT i, j, v FROM G")
def _(s, d):
    meta, turned = e_meta(s, d), Meta((WIDTH, e_meta(s, d).shape[0]), (16, 100))
    x = e_cells(s, d)
    tiles = gemm.gemm_tiles(matrix.to_tiles(views.transpose(x), turned), matrix.to_tiles(x, meta))
    return longs(matrix.to_cells(tiles, Meta((WIDTH, WIDTH), (16, 16))), "v")


@query("gemm_missing_only", "U", "SELECT a.i AS i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM U a JOIN U b ON a.j = b.j WHERE (a.i // 10 + b.i // 10) % 2 = 1 GROUP BY ALL")
def _(s, d):
    u = u_cells(s, d)
    done = gemm.gemm(u, u, transpose_y=True).where("(i div 10 + j div 10) % 2 = 0")
    return gemm.gemm_missing(u, views.transpose(u), done, (10, 10))


# Elementwise

_BOTH = "FROM U FULL JOIN U2 ON U.i = U2.i AND U.j = U2.j"
_IJ = "SELECT coalesce(U.i, U2.i) AS i, coalesce(U.j, U2.j) AS j, "
for _name, _f, _v, _how in (
    ("add", elementwise.add, "coalesce(U.v, 0) + coalesce(U2.v, 0)", _BOTH),
    ("sub", elementwise.sub, "coalesce(U.v, 0) - coalesce(U2.v, 0)", _BOTH),
    ("mul", elementwise.mul, "U.v * U2.v", _BOTH.replace("FULL ", "")),
    ("div", elementwise.div, "CAST(U.v AS DOUBLE) / U2.v", _BOTH.replace("FULL ", "")),
    ("logical_and", elementwise.logical_and, "U.v <> 0 AND U2.v <> 0", _BOTH.replace("FULL ", "")),
    ("logical_or", elementwise.logical_or, "coalesce(U.v, 0) <> 0 OR coalesce(U2.v, 0) <> 0", _BOTH),
    ("xor", elementwise.logical_xor, "(coalesce(U.v, 0) <> 0) <> (coalesce(U2.v, 0) <> 0)", _BOTH),
    ("binop_custom", lambda x, y: elementwise.binary(x, y, lambda a, b: a * 3 - b), "coalesce(U.v, 0) * 3 - coalesce(U2.v, 0)", _BOTH),
):
    query(_name, "U U2", f"{_IJ}{_v} AS v {_how}")(lambda s, d, f=_f: f(u_cells(s, d), u2_cells(s, d)))

for _name, _v in (
    ("abs", "abs(v)"), ("neg", "-v"), ("square", "v * v"), ("sqrt", "sqrt(v)"), ("sin", "sin(v)"), ("cos", "cos(v)"),
    ("tan", "tan(v)"), ("exp", "exp(v)"), ("sign", "sign(v)"),
):
    if _name in ("abs", "neg", "square"):
        query(_name, "E", f"SELECT i, j, {_v} AS v FROM E")(lambda s, d, f=_name: elementwise.unary(e_cells(s, d), f))
    else:
        _x = "abs(v) / 10000.0" if _name == "sqrt" else "v / 10000.0"
        query(_name, "E", f"SELECT i, j, round({_v.replace('(v)', f'(CAST({_x} AS DOUBLE))')} + 0.0, 6) AS v FROM E")(
            lambda s, d, f=_name: rounded(elementwise.unary(e_cells(s, d).select("i", "j", ((F.abs("v") if f == "sqrt" else F.col("v")) / 10000.0).alias("v")), f))
        )


@query("power", "E", "SELECT i, j, round(power(CAST(v AS DOUBLE), 3), 0) AS v FROM E")
def _(s, d):
    return rounded(elementwise.power(e_cells(s, d), 3), 0)


@query("scale", "Q", "SELECT i, j, v * 7 AS v FROM Q")
def _(s, d):
    return elementwise.scale(q_cells(s, d), F.lit(7).cast("long"))


@query("uop_custom", "E", "SELECT i, j, greatest(v, 0) AS v FROM E")
def _(s, d):
    return elementwise.unary(e_cells(s, d), lambda v: F.greatest(v, F.lit(0).cast("long")))


@query("add_matrices", "", "SELECT user_id AS i, month(ts) * 100 + dayofmonth(ts) % 3 AS j, CAST(count(*) AS BIGINT) AS v FROM events GROUP BY ALL")
def _(s, d):
    events = table(s, d, "events").select(F.col("user_id").alias("i"), (F.month("ts") * 100 + F.dayofmonth("ts") % 3).cast("long").alias("j"), F.dayofweek("ts").alias("day"))
    days = [events.where(F.col("day") == k).groupBy("i", "j").agg(F.count(F.lit(1)).alias("v")) for k in range(1, 8)]
    return elementwise.add_matrices(*days)


# Reductions; Q has absent cells, which count as zeros

_N = {"i": "(SELECT count(*) FROM supplier)", "j": "(SELECT count(*) FROM part)"}
for _axis, _label in (("i", "row"), ("j", "col")):
    _sqls = {
        "sum": "CAST(sum(v) AS BIGINT)",
        "min": f"CASE WHEN count(*) < {_N[_axis]} THEN least(min(v), 0) ELSE min(v) END",
        "max": f"CASE WHEN count(*) < {_N[_axis]} THEN greatest(max(v), 0) ELSE max(v) END",
        "norm": "round(sqrt(sum(CAST(v AS DOUBLE) * v)), 6)",
    }
    for _op, _sql in _sqls.items():
        query(f"{_op}_by_{_label}", "Q", f"SELECT {_axis}, {_sql} AS v FROM Q GROUP BY {_axis}")(
            lambda s, d, op=_op, axis=_axis: (rounded if op == "norm" else lambda x: x)(reduce.reduce(q_cells(s, d), op, axis, q_meta(s, d).shape[1 if axis == "i" else 0]))
        )


@query("sum_total", "E", "SELECT CAST(sum(v) AS BIGINT) AS v FROM E")
def _(s, d):
    return reduce.reduce(e_cells(s, d), "sum", None, 0)


for _op, _sql in (("min", "least(min(v), 0)"), ("max", "greatest(max(v), 0)"), ("norm", "round(sqrt(sum(CAST(v AS DOUBLE) * v)), 6)")):
    query(f"{_op}_total", "Q", f"SELECT {_sql} AS v FROM Q")(lambda s, d, op=_op: (rounded if op == "norm" else lambda x: x)(reduce.reduce(q_cells(s, d), op, None, 1 << 62)))


@query("prod_by_row", "U", "SELECT i, CASE WHEN count(*) < 5 THEN 0.0 ELSE product(v) END AS v FROM U GROUP BY i")
def _(s, d):
    return reduce.reduce(u_cells(s, d), "prod", "i", len(TYPES))


_ARG = "SELECT {axis}, \"at\", CAST(v AS DOUBLE) AS v FROM (SELECT {axis}, {other} AS \"at\", v, row_number() OVER (PARTITION BY {axis} ORDER BY v {desc}, {other}) AS r FROM {table}) WHERE r = 1"
for _name, _axis, _large in (("argmin_col", "j", False), ("argmax_col", "j", True), ("argmin_row", "i", False)):
    query(_name, "E", _ARG.format(axis=_axis, other="ij".replace(_axis, ""), desc="DESC" if _large else "", table="E"))(
        lambda s, d, axis=_axis, large=_large: reduce.arg_extreme(e_cells(s, d), axis, WIDTH if axis == "i" else e_meta(s, d).shape[0], large)
    )


@query("argmin_sparse", "Q", _ARG.format(axis="i", other="j", desc="", table="(SELECT a.i, b.j, coalesce(Q.v, 0) AS v FROM (SELECT DISTINCT i FROM Q) a CROSS JOIN range(0, (SELECT count(*) FROM supplier)) b(j) LEFT JOIN Q ON Q.i = a.i AND Q.j = b.j)"))
def _(s, d):
    return reduce.arg_extreme(q_cells(s, d), "i", q_meta(s, d).shape[1])


# Factorisations of E's Gram matrix plus a ridge; invariants that SQL can compute

RIDGE = 10**9
SMALL = Meta((WIDTH, WIDTH), (16, 16))
RAGGED = Meta((WIDTH, WIDTH), (15, 15))
_A = f"SELECT i, j, CASE WHEN i = j THEN v + {RIDGE} ELSE v END AS v FROM G"


def _a_cells(s, d):
    return views.with_ridge(e_gram(s, d), F.lit(RIDGE))


def _near(x: DataFrame) -> DataFrame:
    return x.select("i", "j", F.round("v", 0).cast("long").alias("v"))


_A_NEAR = f"SELECT i, j, CAST(v AS BIGINT) AS v FROM ({_A})"


def _lt_l(low: DataFrame) -> DataFrame:
    return gemm.gemm(low, low, transpose_y=True)


@query("cholesky_reconstruct", "E G", _A_NEAR)
def _(s, d):
    low = factor.cholesky(matrix.to_tiles(_a_cells(s, d), SMALL), SMALL, tiled=True)
    return _near(_lt_l(matrix.to_cells(low, SMALL).where("j <= i")))


@query("cholesky_one_task", "E G", _A_NEAR)
def _(s, d):
    low = factor.cholesky(matrix.to_tiles(_a_cells(s, d), SMALL), SMALL)
    return _near(_lt_l(matrix.to_cells(low, SMALL).where("j <= i")))


@query("cholesky_truncated", "E G", f"SELECT * FROM ({_A_NEAR}) WHERE i < 45 AND j < 45")
def _(s, d):
    low = factor.cholesky(matrix.to_tiles(_a_cells(s, d), RAGGED), RAGGED, truncate=2, tiled=True)
    return _near(_lt_l(matrix.to_cells(low, RAGGED).where("j <= i")))


_OLS = "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem"


def _ols_cells(s, d):
    x = table(s, d, "lineitem").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_quantity").alias("q"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("qq"), F.sum("l_extendedprice").alias("p"), F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("qp")).first()
    a = s.createDataFrame([(0, 0, x.n), (0, 1, x.q), (1, 0, x.q), (1, 1, x.qq)], "i long, j long, v double")
    return a, s.createDataFrame([(0, 0, x.p), (1, 0, x.qp)], "i long, j long, v double")


@query("posv_ols", "", _OLS)
def _(s, d):
    (a, b), m = _ols_cells(s, d), Meta((2, 2), (1, 1))
    x = factor.posv(matrix.to_tiles(a, m), m, matrix.to_tiles(b, Meta((2, 1), (1, 1))), tiled=True)
    found = matrix.to_cells(x, Meta((2, 1), (1, 1)))
    return found.agg(F.round(F.max(F.when(F.col("i") == 0, F.col("v"))), 3).alias("intercept"), F.round(F.max(F.when(F.col("i") == 1, F.col("v"))), 3).alias("slope"))


@query("trisolve", "E G", f"SELECT i, CAST(v AS BIGINT) AS v FROM (SELECT i, sum(v * (j + 1)) AS v FROM ({_A}) GROUP BY i)")
def _(s, d):
    """L (Lᵀ x) for x = 1, 2, ...: solving it back and multiplying again gives A x."""
    from .session import cut_lineage

    a = cut_lineage(_a_cells(s, d))
    low = cut_lineage(factor.cholesky(matrix.to_tiles(a, SMALL), SMALL, tiled=True))
    x = s.range(WIDTH).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v"))
    one = Meta((WIDTH, 1), (16, 1))
    b = gemm.gemv(a, x).select("i", F.lit(0).cast("long").alias("j"), "v")
    y = factor.trisolve(low, SMALL, matrix.to_tiles(b, one))
    back = gemm.gemv(matrix.to_cells(low, SMALL), matrix.to_cells(y, one).select("i", "v"))
    return back.select("i", F.round("v", 0).cast("long").alias("v"))


@query("tsqr_gram", "E G", "SELECT i, j, v FROM G")
def _(s, d):
    rows = table(s, d, "embeddings").select(F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000 + 0.5)).alias("vec"))
    r = factor.tsqr(rows.repartition(5), F.col("vec"), WIDTH)
    return gemm.gemm(r, r, transpose_x=True).select("i", "j", F.round("v", 0).cast("long").alias("v"))


@query("tsqr_r_small", "", "SELECT round(sqrt(n), 4) AS r00, round(q / sqrt(n), 4) AS r01, round(sqrt(qq - q * q / n), 4) AS r11 FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS q, sum(l_quantity * l_quantity) AS qq FROM lineitem)")
def _(s, d):
    rows = table(s, d, "lineitem").select(F.array(F.lit(1.0), F.col("l_quantity")).alias("vec"))
    r = factor.tsqr(rows, F.col("vec"), 2)
    cell = lambda i, j: F.round(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v"))), 4)
    return r.agg(cell(0, 0).alias("r00"), cell(0, 1).alias("r01"), cell(1, 1).alias("r11"))


def _scaled(s, d):
    return _a_cells(s, d).select("i", "j", (F.col("v") / float(RIDGE)).alias("v"))


_S = f"SELECT i, j, v / {RIDGE}.0::DOUBLE AS v FROM ({_A})"
_STS = f"SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v) + 0.0, 6) AS v FROM ({_S}) x JOIN ({_S}) y ON x.i = y.i GROUP BY ALL"


def _rt_r(tiles, meta):
    r = matrix.to_cells(tiles, meta)
    return rounded(gemm.gemm(r, r, transpose_x=True))


@query("qr_gram", "E G", _STS)
def _(s, d):
    return _rt_r(factor.qr(matrix.to_tiles(_scaled(s, d), SMALL), SMALL, tiled=True), SMALL)


@query("qr_ragged", "E G", _STS)
def _(s, d):
    return _rt_r(factor.qr(matrix.to_tiles(_scaled(s, d), RAGGED), RAGGED, tiled=True), RAGGED)


@query("qr_one_task", "E G", _STS)
def _(s, d):
    return _rt_r(factor.qr(matrix.to_tiles(_scaled(s, d), SMALL), SMALL), SMALL)


@query("bdfac_frobenius", "E G", f"SELECT round(sum(v * v), 5) AS v FROM ({_S})")
def _(s, d):
    tiles = factor.bdfac(matrix.to_tiles(_scaled(s, d), SMALL), SMALL, tiled=True)
    return matrix.to_cells(tiles, SMALL).agg(F.round(F.sum(F.col("v") * F.col("v")), 5).alias("v"))


@query("bdfac_band", "", "SELECT CAST(bi AS INTEGER) AS bi, CAST(bi + x AS INTEGER) AS bj FROM range(0, 4) a(bi), range(0, 2) b(x) WHERE bi + x < 4")
def _(s, d):
    return factor.bdfac(matrix.to_tiles(_scaled(s, d), SMALL), SMALL, tiled=True).select("bi", "bj")


@query("bdfac_one_task", "E G", f"SELECT round(sum(v * v), 5) AS v FROM ({_S})")
def _(s, d):
    tiles = factor.bdfac(matrix.to_tiles(_scaled(s, d), RAGGED), RAGGED)
    return matrix.to_cells(tiles, RAGGED).agg(F.round(F.sum(F.col("v") * F.col("v")), 5).alias("v"))


@query("singular_values", "E G", f"SELECT CAST({WIDTH} AS BIGINT) AS n, round(sum(CASE WHEN i = j THEN v END), 5) AS total, round(sum(v * v), 5) AS squares FROM ({_S})")
def _(s, d):
    found = factor.singular_values(matrix.to_tiles(_scaled(s, d), SMALL), SMALL)
    return found.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 5).alias("total"), F.round(F.sum(F.col("v") * F.col("v")), 5).alias("squares"))


@query("bidiagonal", "E G", f"SELECT CAST({WIDTH} AS BIGINT) AS n, round(sum(v * v), 5) AS squares, round(sum(CASE WHEN i = j THEN v END), 5) AS total FROM ({_S})")
def _(s, d):
    """Of a symmetric positive matrix the singular values sum up to the trace, so they are recomputed from the two diagonals."""
    diagonal, over = kernels.bidiagonal(matrix.to_numpy(_scaled(s, d), (WIDTH, WIDTH)))
    values = np.linalg.svd(np.diag(diagonal) + np.diag(over, 1), compute_uv=False)
    rows = s.createDataFrame([(float(x),) for x in [*diagonal, *over]], "v double").agg(F.round(F.sum(F.col("v") * F.col("v")), 5).alias("squares"))
    return rows.select(F.lit(len(diagonal)).cast("long").alias("n"), "squares", F.round(F.lit(float(values.sum())), 5).alias("total"))


_ONE = f"SELECT a.i, b.j, CASE WHEN a.i = b.j THEN 1.0 ELSE 0.0 END AS v FROM range(0, {WIDTH}) a(i), range(0, {WIDTH}) b(j)"


def _identity(s, meta):
    return matrix.from_numpy(s, np.eye(WIDTH), meta.tile)


def _cells_near(tiles, meta):
    """The scaled matrix as whole numbers again."""
    return matrix.to_cells(tiles, meta).select("i", "j", F.round(F.col("v") * float(RIDGE), 0).cast("long").alias("v"))


def _squared(q, meta):
    cells = matrix.to_cells(q, meta)
    return gemm.gemm(cells, cells, transpose_x=True).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("qr_orthogonal", "", _ONE)
def _(s, d):
    """QᵀQ."""
    q = factor.qr_factors(matrix.to_tiles(_scaled(s, d), SMALL), SMALL)[1]
    return _squared(q.times(_identity(s, SMALL), SMALL), SMALL)


@query("qr_product", "E G", _A_NEAR)
def _(s, d):
    """Q R, with ragged tiles and five block rows."""
    r, q = factor.qr_factors(matrix.to_tiles(_scaled(s, d), RAGGED), RAGGED)
    return _cells_near(q.times(r, RAGGED), RAGGED)


@query("qr_transposed", "E G", "SELECT i, CAST(0 AS BIGINT) AS j, CAST(round(sum(v * (j + 1)), 0) AS BIGINT) AS v FROM (" + _A + ") GROUP BY i")
def _(s, d):
    """A x from R x by Q, with x = 1, 2, ... and columns of another width than the tiles."""
    cells = _a_cells(s, d)
    r, q = factor.qr_factors(matrix.to_tiles(cells, SMALL), SMALL)
    x = s.range(WIDTH).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v"))
    b = gemm.gemv(matrix.to_cells(r, SMALL), x).select("i", F.lit(0).cast("long").alias("j"), "v")
    one = Meta((WIDTH, 1), (16, 1))
    return matrix.to_cells(q.times(matrix.to_tiles(b, one), one), one).select("i", "j", F.round("v", 0).cast("long").alias("v"))


def _bdfac_whole(s, d, truncate):
    """Q (band + rest) Pᵀ."""
    band, rest, q, p = factor.bdfac_factors(matrix.to_tiles(_scaled(s, d), SMALL), SMALL, truncate)
    left = matrix.to_cells(q.times(band.unionByName(rest), SMALL), SMALL)
    turned = p.times(matrix.to_tiles(views.transpose(left), SMALL), SMALL)
    return views.transpose(_cells_near(turned, SMALL))


@query("bdfac_product", "E G", _A_NEAR)
def _(s, d):
    return _bdfac_whole(s, d, 0)


@query("bdfac_truncated", "E G", _A_NEAR)
def _(s, d):
    return _bdfac_whole(s, d, 2)


@query("bdfac_orthogonal", "", _ONE)
def _(s, d):
    """PᵀP of the right factor."""
    p = factor.bdfac_factors(matrix.to_tiles(_scaled(s, d), SMALL), SMALL)[3]
    return _squared(p.times(_identity(s, SMALL), SMALL), SMALL)


def _vector_rows(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000 + 0.5)).alias("vec"))
    return rows, F.col("vec")


def _row_cells(rows):
    return matrix.cells_from_rows(rows, "id", "vec", lambda x: x)


@query("tsqr_orthogonal", "", _ONE)
def _(s, d):
    q = _row_cells(factor.tsqr_factors(*_vector_rows(s, d), WIDTH)[0])
    return gemm.gemm(q, q, transpose_x=True).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("tsqr_product", "E", "SELECT i, j, v FROM E")
def _(s, d):
    q, r = factor.tsqr_factors(*_vector_rows(s, d), WIDTH)
    right = matrix.to_cells(matrix.from_numpy(s, r, (16, 16)), SMALL)
    return _near(gemm.gemm(_row_cells(q), right))


@query("svd_tall_product", "E", "SELECT i, j, v FROM E")
def _(s, d):
    """U diag(s) Vᵀ."""
    u, values, v = factor.svd_tall(*_vector_rows(s, d), WIDTH)
    right = matrix.to_cells(matrix.from_numpy(s, values[:, None] * v.T, (16, 16)), SMALL)
    return _near(gemm.gemm(_row_cells(u), right))


@query("qr_ols", "", _OLS)
def _(s, d):
    """The regression of ``posv_ols`` by QR, without forming the normal equations."""
    rows = table(s, d, "lineitem")
    x = factor.least_squares(rows, F.array(F.lit(1.0), F.col("l_quantity")), F.col("l_extendedprice"), 2)
    return s.createDataFrame([tuple(float(v) for v in x)], "intercept double, slope double").select(F.round("intercept", 3).alias("intercept"), F.round("slope", 3).alias("slope"))


@query("singular_values_tall", "", "SELECT round(sum(CAST(x AS DOUBLE) * x), 5) AS squares FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def _(s, d):
    found = factor.singular_values_tall(table(s, d, "embeddings"), F.col("embedding"), WIDTH)
    return found.agg(F.round(F.sum(F.col("v") * F.col("v")), 5).alias("squares"))


# Neighbours

_VEC = "SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 10000 + 0.5)) AS v, label FROM embeddings"
_APART = "list_dot_product(q.v, q.v) + list_dot_product(d.v, d.v) - 2 * list_dot_product(q.v, d.v)"
_NN = f"SELECT q.vec_id AS i, d.vec_id AS j, CAST({_APART} AS BIGINT) AS v, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_APART}, d.vec_id) AS place, q.label AS own, d.label AS near FROM ({_VEC}) q, ({_VEC}) d WHERE {{}}"
#: Searches ask with every fiftieth row, against all others; the accuracy trains on even rows and tests on odd ones.
_FIFTIETH, _SPLIT = "q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id", "q.vec_id % 2 = 1 AND d.vec_id % 2 = 0"


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000 + 0.5).cast("double")).alias("vec"))


def _nearest(s, d, k):
    rows = _vectors(s, d)
    return neighbors.nearest(rows.where("id % 50 = 0"), rows, k, others=True).select("i", "j", F.col("v").cast("long").alias("v"), F.col("place").cast("long").alias("place"))


@query("nearest_neighbor", "", f"SELECT i, j, v, place FROM ({_NN.format(_FIFTIETH)}) WHERE place = 1")
def _(s, d):
    return _nearest(s, d, 1)


@query("nn_topk", "", f"SELECT i, j, v, place FROM ({_NN.format(_FIFTIETH)}) WHERE place <= 5")
def _(s, d):
    return _nearest(s, d, 5)


@query("nn_accuracy", "", f"SELECT round(avg(CASE WHEN own = near THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_NN.format(_SPLIT)}) WHERE place = 1")
def _(s, d):
    rows, labels = _vectors(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    found = neighbors.nearest(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"))
    return neighbors.accuracy(found, labels).select(F.round("accuracy", 6).alias("accuracy"))


@query("distances", "U", "SELECT a.i AS i, b.i AS j, CAST(sum(a.v * a.v) + sum(b.v * b.v) - 2 * sum(a.v * b.v) AS BIGINT) AS v FROM (SELECT x.i, y.j, coalesce(U.v, 0) AS v FROM (SELECT DISTINCT i FROM U) x CROSS JOIN range(0, 5) y(j) LEFT JOIN U ON U.i = x.i AND U.j = y.j) a JOIN (SELECT x.i, y.j, coalesce(U.v, 0) AS v FROM (SELECT DISTINCT i FROM U) x CROSS JOIN range(0, 5) y(j) LEFT JOIN U ON U.i = x.i AND U.j = y.j) b USING (j) GROUP BY a.i, b.i")
def _(s, d):
    u = u_cells(s, d)
    return neighbors.distances(u, u)


# Programs as relations

_PROGRAMS = {
    "gemm": (program.gemm_program(2, 3, 5), 54, 48, 4, 30, 6),
    "chol": (program.cholesky_program(8), 120, 252, 22, 1, 36),
    "chol_truncated": (program.cholesky_program(8, 2), 56, 105, 16, 1, 21),
    "tsqr": (program.tsqr_program(5), 11, 10, 4, 5, 11),
    "qr": (program.qr_program(5), 118, 213, 17, 5, 38),
    "bdfac": (program.bdfac_program(5), 178, 352, 30, 5, 45),
}
#: Tasks ``stmt, i, j, k, level`` and edges, as closed forms in SQL; absent variables are -1.
_TASKS_SQL = {
    "gemm": """SELECT 0 AS stmt, i, j, k, NULL AS level FROM range(0, 2) a(i), range(0, 3) b(j), range(0, 5) c(k)
        UNION ALL SELECT 1, i, j, k, level FROM range(0, 2) a(i), range(0, 3) b(j), (VALUES (0, 0), (0, 4), (1, 0)) c(level, k)
        UNION ALL SELECT 2, i, j, NULL, NULL FROM range(0, 2) a(i), range(0, 3) b(j)""",
    "tsqr": "SELECT 0 AS stmt, NULL AS i, j, NULL AS k, NULL AS level FROM range(0, 5) a(j) UNION ALL SELECT 1, NULL, j, NULL, level FROM range(0, 3) a(level), range(0, 5) b(j) WHERE j % (2 << level) = 0",
}
_CHOL_TASKS = """SELECT CASE WHEN i = 0 THEN 0 ELSE 3 END AS stmt, CASE WHEN i > 0 THEN i END AS i, NULL AS j, NULL AS k, NULL AS level FROM range(0, {n}) a(i)
        UNION ALL SELECT CASE WHEN i = 0 THEN 1 ELSE 4 END, CASE WHEN i > 0 THEN i END, j, NULL, NULL FROM range(0, {n}) a(i), range(i + 1, {n}) b(j)
        UNION ALL SELECT CASE WHEN i = 0 THEN 2 ELSE 5 END, CASE WHEN i > 0 THEN i END, j, k, NULL FROM range(0, {n}) a(i), range(i + 1, {n}) b(j), range(i + 1, j + 1) c(k)"""
#: Parent and child as (kind, i, j, k): chol at step i, trsm of row j, update of tile j, k.
_CHOL_EDGES = """SELECT 'c' AS pk, i AS pi, i AS pj, i AS pl, 't' AS ck, i AS ci, j AS cj, i AS cl FROM range(0, {n}) a(i), range(i + 1, {n}) b(j)
    UNION ALL SELECT 't', i, j, i, 's', i, j, k FROM range(0, {n}) a(i), range(i + 1, {n}) b(j), range(i + 1, j + 1) c(k)
    UNION ALL SELECT 't', i, k, i, 's', i, j, k FROM range(0, {n}) a(i), range(i + 1, {n}) b(j), range(i + 1, j) c(k)
    UNION ALL SELECT 's', i, j, k, CASE WHEN j = i + 1 THEN 'c' WHEN k = i + 1 THEN 't' ELSE 's' END, i + 1, j, k FROM range(0, {n}) a(i), range(i + 1, {n}) b(j), range(i + 1, j + 1) c(k)"""


def _chol_task(prefix, kind, i, j, k):
    stmt = f"CASE {kind} WHEN 'c' THEN 0 WHEN 't' THEN 1 ELSE 2 END + CASE WHEN {i} > 0 THEN 3 ELSE 0 END"
    return f"{stmt} AS {prefix}stmt, CASE WHEN {i} > 0 THEN {i} END AS {prefix}i, CASE WHEN {kind} <> 'c' THEN {j} END AS {prefix}j, CASE WHEN {kind} = 's' THEN {k} END AS {prefix}k, NULL AS {prefix}level"


_CHOL = f"SELECT {_chol_task('p_', 'pk', 'pi', 'pj', 'pl')}, {_chol_task('c_', 'ck', 'ci', 'cj', 'cl')} FROM ({_CHOL_EDGES})"
_EDGES_SQL = {
    "gemm": """SELECT 0 AS p_stmt, i AS p_i, j AS p_j, k AS p_k, NULL AS p_level, 1 AS c_stmt, i AS c_i, j AS c_j, k // 4 * 4 AS c_k, 0 AS c_level FROM range(0, 2) a(i), range(0, 3) b(j), range(0, 5) c(k)
        UNION ALL SELECT 1, i, j, k, 0, 1, i, j, 0, 1 FROM range(0, 2) a(i), range(0, 3) b(j), (VALUES (0), (4)) c(k)
        UNION ALL SELECT 1, i, j, 0, 1, 2, i, j, NULL, NULL FROM range(0, 2) a(i), range(0, 3) b(j)""",
    "tsqr": """SELECT 0 AS p_stmt, NULL AS p_i, j AS p_j, NULL AS p_k, NULL AS p_level, 1 AS c_stmt, NULL AS c_i, j // 2 * 2 AS c_j, NULL AS c_k, 0 AS c_level FROM range(0, 5) a(j)
        UNION ALL SELECT 1, NULL, j, NULL, level, 1, NULL, j // (4 << level) * (4 << level), NULL, level + 1 FROM range(0, 2) a(level), range(0, 5) b(j) WHERE j % (2 << level) = 0""",
}
for _name, _n in (("chol", 8), ("chol_truncated", 6)):
    _TASKS_SQL[_name], _EDGES_SQL[_name] = _CHOL_TASKS.format(n=_n), _CHOL.format(n=_n)


def _whole_numbers(sql):
    return f"SELECT CAST(coalesce(COLUMNS(*), -1) AS INTEGER) FROM ({sql})"


def _flat(task, prefix=""):
    return [F.coalesce(F.col(f"{task}.{c}" if task else c), F.lit(-1)).alias(prefix + c) for c in ("stmt", *program.VARIABLES)]


#: Counts of the two largest programs are numbers worked out by hand; the smaller ones are compared task by task and edge by edge.
for _name, (_p, _tasks, _edges, _depth, _starts, _ends) in _PROGRAMS.items():
    if _name in _TASKS_SQL:
        _all = _TASKS_SQL[_name]
        _ender = {"gemm": "stmt = 2", "tsqr": "true"}.get(_name, "stmt IN (0, 1, 3, 4)")
        query(f"{_name}_edges", "", _whole_numbers(_EDGES_SQL[_name]))(lambda s, d, p=_p: p.edges(s).select(*_flat("parent", "p_"), *_flat("child", "c_")))
        query(f"{_name}_tasks", "", _whole_numbers(_all))(lambda s, d, p=_p: p.tasks(s).select(*_flat("")))
        query(f"{_name}_starters", "", _whole_numbers(f"SELECT * FROM ({_all}) WHERE stmt = 0"))(lambda s, d, p=_p: p.starters(s).select(*_flat("task")))
        query(f"{_name}_terminators", "", _whole_numbers(f"SELECT * FROM ({_all}) WHERE {_ender}"))(lambda s, d, p=_p: p.terminators(s).select(*_flat("task")))
    else:
        query(f"{_name}_edges", "", f"SELECT CAST({_edges} AS BIGINT) AS n")(lambda s, d, p=_p: p.edges(s).agg(F.count(F.lit(1)).alias("n")))
        query(f"{_name}_tasks", "", f"SELECT CAST({_tasks} AS BIGINT) AS n")(lambda s, d, p=_p: p.tasks(s).agg(F.count(F.lit(1)).alias("n")))
        query(f"{_name}_starters", "", f"SELECT CAST({_starts} AS BIGINT) AS n")(lambda s, d, p=_p: p.starters(s).agg(F.count(F.lit(1)).alias("n")))
        query(f"{_name}_terminators", "", f"SELECT CAST({_ends} AS BIGINT) AS n")(lambda s, d, p=_p: p.terminators(s).agg(F.count(F.lit(1)).alias("n")))
    query(f"{_name}_ssa_check", "", "SELECT CAST(0 AS BIGINT) AS n")(lambda s, d, p=_p: p.doubly_written(s).agg(F.count(F.lit(1)).alias("n")))


@query("chol_walk", "", "SELECT CAST(5 AS INTEGER) AS stmt, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k FROM range(1, 8) a(i), range(i + 1, 8) b(j), range(i + 1, j + 1) c(k)")
def _(s, d):
    return program.cholesky_program(8).tasks(s).where("stmt = 5").select("stmt", "i", "j", "k")


@query("chol_levels", "", "SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n FROM (SELECT 3 * i + 1 AS depth FROM range(0, 8) a(i) UNION ALL SELECT 3 * i + 2 FROM range(0, 8) a(i), range(i + 1, 8) b(j) UNION ALL SELECT 3 * i + 3 FROM range(0, 8) a(i), range(i + 1, 8) b(j), range(i + 1, j + 1) c(k)) GROUP BY ALL")
def _(s, d):
    """A step's factor, panel and update come three levels after those of the step before."""
    return program.cholesky_program(8).levels(s).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("tsqr_levels", "", "SELECT depth, CAST(n AS BIGINT) AS n FROM (VALUES (1, 5), (2, 3), (3, 2), (4, 1)) t(depth, n)")
def _(s, d):
    return program.tsqr_program(5).levels(s).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


_FLOPS_SQL = "SELECT kernel, CAST(sum(tasks) AS BIGINT) AS tasks, CAST(sum(tasks * each) AS DOUBLE) AS flops FROM (VALUES {}) t(kernel, tasks, each) GROUP BY kernel"
_B3 = "96.0::DOUBLE * 96 * 96"
_REFLECT = {"leaf": f"3 * {_B3} + 96 * 96", "pair": f"4 * {_B3} + 96 * 96", "one": f"{_B3} * 4 / 3", "two": f"{_B3} * 10 / 3"}
for _name, _p, _rows in (
    ("chol", program.cholesky_program(8), f"('chol', 8, {_B3} / 3), ('trsm', 28, {_B3}), ('syrk', 84, 2 * {_B3} + 96 * 96)"),
    ("gemm", program.gemm_program(2, 3, 5), f"('gemm', 30, 2 * {_B3}), ('add_matrices', 18, 3.0 * 96 * 96), ('identity', 6, 0.0)"),
    ("tsqr", program.tsqr_program(4), f"('qr_factor', 4, {_REFLECT['one']}), ('qr_factor', 3, {_REFLECT['two']})"),
    ("qr", program.qr_program(2), f"('qr_factor', 3, {_REFLECT['one']}), ('qr_factor_triangular', 1, {_REFLECT['two']}), ('qr_leaf', 2, {_REFLECT['leaf']}), ('qr_trailing_update', 1, {_REFLECT['pair']}), ('identity', 1, 0.0)"),
    ("bdfac", program.bdfac_program(2), f"('qr_factor', 3, {_REFLECT['one']}), ('qr_factor', 1, {_REFLECT['two']}), ('qr_leaf', 2, {_REFLECT['leaf']}), ('qr_trailing_update', 1, {_REFLECT['pair']}), ('lq_factor', 1, {_REFLECT['one']}), ('lq_leaf', 1, {_REFLECT['leaf']})"),
):
    query(f"{_name}_flops", "", _FLOPS_SQL.format(_rows))(lambda s, d, p=_p: program.flops(p, s, 96))


@query("chol_counters", "", f"SELECT kernel, tasks, CAST(tasks * reads AS BIGINT) AS tiles_read, CAST(tasks AS BIGINT) AS tiles_written, CAST(tasks * reads * 8 * 96 * 96 AS BIGINT) AS bytes_read FROM (SELECT kernel, count(*) AS tasks, max(reads) AS reads FROM (SELECT CASE stmt % 3 WHEN 0 THEN 'chol' WHEN 1 THEN 'trsm' ELSE 'syrk' END AS kernel, stmt % 3 + 1 AS reads FROM ({_TASKS_SQL['chol']})) GROUP BY kernel)")
def _(s, d):
    return program.counters(program.cholesky_program(8), s, 96).select("kernel", "tasks", "tiles_read", "tiles_written", "bytes_read")


@query("chol_status", "", "SELECT status, CAST(n AS BIGINT) AS tasks FROM (VALUES ('FINISHED', 8), ('READY', 28), ('NOT_READY', 84)) t(status, n)")
def _(s, d):
    """Once the first factor and its panel are done, all updates of the first step can run, and nothing else."""
    p = program.cholesky_program(8)
    done = p.tasks(s).where("stmt <= 1").select(F.struct("stmt", *program.VARIABLES).alias("task"))
    return program.status(p, s, done)


TRIANGLE = """
def triangle(A, B, N):
    for i in range(N):
        for j in range(i + 1, N):
            A[j, i] = identity(A[i, j])
    for z in range(N):
        for k in range(N):
            B[z, k] = identity(A[z, k])
"""
BRANCHES = """
def branches(X, O, N):
    for i in range(N):
        if i % 2 == 0:
            if i % 3 == 0 or i == 8:
                O[i] = triple(X[i])
            else:
                O[i] = identity(X[i])
        else:
            O[i] = double(X[i])
"""
HALVING = """
def halving(A, B, N):
    for i in range(N):
        depth = ceiling(log(N - i) / log(2))
        for level in range(0, ceiling(log(N - i) / log(2))):
            for k in range(0, N, 2 ** (level + 1)):
                A[depth - level - 1, i, k] = add(A[depth - level, i, k], A[depth - level, i, k + 2 ** level])
        B[i] = identity(A[1, i, 0])
"""


@query("compiled_edges", "", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(j AS INTEGER) AS z, CAST(i AS INTEGER) AS k FROM range(0, 6) a(i), range(i + 1, 6) b(j)")
def _(s, d):
    """Of a program given as text: the tasks that mirror a triangle, and those that copy what they wrote."""
    p = program.compiled(TRIANGLE, ("A",), ("B",), N=6)
    return p.edges(s).select("parent.i", "parent.j", "child.z", "child.k")


@query("compiled_branches", "", "SELECT CASE WHEN i % 2 = 1 THEN 'double' WHEN i % 3 = 0 OR i = 8 THEN 'triple' ELSE 'identity' END AS kernel, CAST(i AS INTEGER) AS i FROM range(0, 13) t(i)")
def _(s, d):
    return program.compiled(BRANCHES, ("X",), ("O",), N=13).tasks(s).select("kernel", "i")


@query("compiled_halving", "", "SELECT CAST(i AS INTEGER) AS i, CAST(level AS INTEGER) AS level, CAST(k AS INTEGER) AS k FROM range(0, 8) a(i), range(0, 3) b(level), range(0, 8) c(k) WHERE (1 << level) < 8 - i AND k % (2 << level) = 0")
def _(s, d):
    """Bounds that are not linear in the loop's variables, through a local value."""
    return program.compiled(HALVING, ("A",), ("B",), N=8).tasks(s).where("stmt = 0").select("i", "level", "k")


_TASK = "CAST(stmt AS INTEGER) AS stmt, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k"


@query("chol_children", "", f"SELECT {_TASK} FROM (SELECT 5 AS stmt, 2 AS i, 5 AS j, k FROM range(3, 6) t(k) UNION ALL SELECT 5, 2, j, 5 FROM range(6, 8) t(j))")
def _(s, d):
    return program.cholesky_program(8).children(s, stmt=4, i=2, j=5).select("stmt", "i", "j", "k")


@query("chol_parents", "", f"SELECT {_TASK} FROM (VALUES (4, 2, 5, -1), (4, 2, 4, -1), (5, 1, 5, 4)) t(stmt, i, j, k)")
def _(s, d):
    return program.cholesky_program(8).parents(s, stmt=5, i=2, j=5, k=4).select("stmt", "i", "j", F.coalesce("k", F.lit(-1)).alias("k"))


@query("edge_symmetry", "", "SELECT CAST(0 AS BIGINT) AS n")
def _(s, d):
    """Edges that one of parents and children lacks."""
    p = program.qr_program(4)
    writes = p.accesses(s, "writes").select(F.col("task").alias("parent"), "mat", "idx")
    reads = p.accesses(s, "reads").select(F.col("task").alias("child"), "mat", "idx")
    down = writes.join(reads, ["mat", "idx"]).select("parent", "child").distinct()
    up = reads.join(writes, ["mat", "idx"]).select("parent", "child").distinct()
    return down.exceptAll(up).unionByName(up.exceptAll(down)).agg(F.count(F.lit(1)).alias("n"))


# Intervals and streams


@query("busy_time", "", "SELECT event_type, CAST(sum(greatest(stop - greatest(start, coalesce(before, start)), 0)) AS BIGINT) AS busy FROM (SELECT *, max(stop) OVER (PARTITION BY event_type ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 10) AS BIGINT) AS stop FROM events)) GROUP BY event_type")
def _(s, d):
    start = F.floor(F.unix_timestamp("ts")).cast("long")
    rows = table(s, d, "events").select("event_type", start.alias("start"), (start + F.floor(F.col("value") * 10).cast("long")).alias("stop"))
    return intervals.busy_time(rows, ["event_type"])


@query("gram_increments", "E G", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, v FROM G WHERE i <= j")
def _(s, d):
    rows = table(s, d, "embeddings").select(F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000 + 0.5).cast("long")).alias("vec"))
    return streaming.streaming_gram(rows, "vec")


@query("windowed_counts", "", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return streaming.windowed_counts(table(s, d, "events"), "ts", "event_type", "1 day", "1 hour")
