"""Blocked algorithms as relations: statements with loop nests become tables of tasks, and dependencies equi-joins.

Loop bounds and indices are SQL expressions over the loop variables and the program's parameters. A task is a row
``(stmt, i, j, k, level)``, unused variables null; an access is a row ``(task, mat, idx)``.
"""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..session import cut_lineage

VARIABLES = ("i", "j", "k", "level")


@dataclass(frozen=True)
class Statement:
    """``loops``: (variable, low, high, step), high excluded; ``reads`` and ``writes``: (matrix, indices); ``where``: a condition."""

    kernel: str
    loops: tuple[tuple[str, str, str, str], ...]
    reads: tuple[tuple[str, tuple[str, ...]], ...]
    writes: tuple[tuple[str, tuple[str, ...]], ...]
    where: str = "true"


@dataclass(frozen=True)
class Program:
    statements: tuple[Statement, ...]
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    variables: tuple[str, ...] = VARIABLES

    def tasks(self, spark: SparkSession) -> DataFrame:
        """All tasks: ``stmt, kernel, i, j, k, level``."""
        out = None
        for number, s in enumerate(self.statements):
            rows = _domain(spark, s)
            have = {v for v, *_ in s.loops}
            rows = rows.select(F.lit(number).alias("stmt"), F.lit(s.kernel).alias("kernel"), *[(F.col(v) if v in have else F.lit(None)).cast("int").alias(v) for v in self.variables])
            out = rows if out is None else out.unionByName(rows)
        return out

    def accesses(self, spark: SparkSession, mode: str) -> DataFrame:
        """``task`` (a struct of stmt and variables), ``mat``, ``idx`` of every read or write."""
        out = None
        for number, s in enumerate(self.statements):
            have = {v for v, *_ in s.loops}
            task = F.struct(F.lit(number).alias("stmt"), *[(F.col(v) if v in have else F.lit(None)).cast("int").alias(v) for v in self.variables])
            each = [F.struct(F.lit(m).alias("mat"), F.array(*[F.expr(f"int({x})") for x in idx]).alias("idx")) for m, idx in getattr(s, mode)]
            rows = _domain(spark, s).select(task.alias("task"), F.explode(F.array(*each)).alias("a")).select("task", "a.mat", "a.idx")
            out = rows if out is None else out.unionByName(rows)
        return out

    def edges(self, spark: SparkSession) -> DataFrame:
        """``parent, child``: writers met with readers of the same index."""
        writes = self.accesses(spark, "writes").withColumnRenamed("task", "parent")
        reads = self.accesses(spark, "reads").withColumnRenamed("task", "child")
        return writes.join(reads, ["mat", "idx"]).select("parent", "child").distinct()

    def children(self, spark: SparkSession, **task: int) -> DataFrame:
        """Tasks that read what ``task`` (stmt and variables) writes."""
        return self._next(spark, "parent", "child", task)

    def parents(self, spark: SparkSession, **task: int) -> DataFrame:
        """Tasks that write what ``task`` reads."""
        return self._next(spark, "child", "parent", task)

    def _next(self, spark: SparkSession, here: str, there: str, task: dict[str, int]) -> DataFrame:
        """The filter on one task reaches its side of the join before the join."""
        rows = self.edges(spark)
        for name in ("stmt", *self.variables):
            rows = rows.where(F.col(here)[name].eqNullSafe(F.lit(task.get(name))))
        return rows.select(F.col(f"{there}.*"))

    def doubly_written(self, spark: SparkSession) -> DataFrame:
        """Indices with several writers: none in a single-assignment program."""
        return self.accesses(spark, "writes").groupBy("mat", "idx").agg(F.count(F.lit(1)).alias("writers")).where("writers > 1")

    def starters(self, spark: SparkSession) -> DataFrame:
        """Tasks that read nothing but inputs."""
        reads = self.accesses(spark, "reads").groupBy("task").agg(F.min(F.col("mat").isin(list(self.inputs))).alias("ready"))
        return reads.where("ready").select("task")

    def terminators(self, spark: SparkSession) -> DataFrame:
        """Tasks that write an output."""
        return self.accesses(spark, "writes").where(F.col("mat").isin(list(self.outputs))).select("task").distinct()

    def levels(self, spark: SparkSession) -> DataFrame:
        """``task, depth``: each task on its longest path from a source, from 1."""
        edges = cut_lineage(self.edges(spark))
        task = F.struct("stmt", *self.variables).alias("task")
        depth = cut_lineage(self.tasks(spark).select(task, F.lit(1).alias("depth")))
        frontier = depth
        while True:
            reach = edges.join(frontier, edges["parent"] == frontier["task"]).groupBy("child").agg((F.max("depth") + 1).alias("next"))
            better = depth.join(reach, depth["task"] == reach["child"]).where("next > depth").select("task", F.col("next").alias("depth"))
            frontier = cut_lineage(better)
            if frontier.isEmpty():
                return depth
            depth = cut_lineage(depth.join(frontier.withColumnRenamed("depth", "more"), "task", "left").select("task", F.coalesce("more", "depth").alias("depth")))


def _domain(spark: SparkSession, s: Statement) -> DataFrame:
    rows = spark.range(1).drop("id")
    for v, low, high, step in s.loops:
        last = f"int({high}) - 1"
        places = F.expr(f"if({last} >= int({low}), sequence(int({low}), {last}, int({step})), array())")
        rows = rows.withColumn(v, F.explode(places))
    return rows.where(s.where)


class _Compiler(ast.NodeVisitor):
    """Statements of a function's loops and branches; integer arguments are put in, local values substituted."""

    SIGNS = {ast.Add: "({} + {})", ast.Sub: "({} - {})", ast.Mult: "({} * {})", ast.Div: "({} / {})", ast.FloorDiv: "floor({} / {})", ast.Mod: "pmod({}, {})", ast.Pow: "power({}, {})",
             ast.Eq: "({} = {})", ast.NotEq: "({} <> {})", ast.Lt: "({} < {})", ast.LtE: "({} <= {})", ast.Gt: "({} > {})", ast.GtE: "({} >= {})"}
    CALLS = {"ceiling": "ceil(round({}, 9))", "floor": "floor(round({}, 9))", "log": "ln({})"}

    def __init__(self, sizes: dict[str, int]):
        self.names = {k: str(v) for k, v in sizes.items()}
        self.loops: list[tuple[str, str, str, str]] = []
        self.conditions: list[str] = []
        self.made: list[Statement] = []
        self.variables: list[str] = []

    def sql(self, e: ast.expr) -> str:
        if isinstance(e, ast.Constant) and isinstance(e.value, (bool, int, float)):
            return str(e.value).lower()
        if isinstance(e, ast.Name):
            if e.id not in self.names:
                raise NameError(f"{e.id} has no value in line {e.lineno}")
            return self.names[e.id]
        if isinstance(e, ast.BinOp):
            return self.SIGNS[type(e.op)].format(self.sql(e.left), self.sql(e.right))
        if isinstance(e, ast.Compare):
            sides = [self.sql(x) for x in (e.left, *e.comparators)]
            return "(" + " AND ".join(self.SIGNS[type(op)].format(a, b) for op, a, b in zip(e.ops, sides, sides[1:])) + ")"
        if isinstance(e, ast.BoolOp):
            return "(" + (" AND " if isinstance(e.op, ast.And) else " OR ").join(map(self.sql, e.values)) + ")"
        if isinstance(e, ast.UnaryOp):
            return f"({'NOT ' if isinstance(e.op, ast.Not) else '-'}{self.sql(e.operand)})"
        if isinstance(e, ast.Call) and getattr(e.func, "id", "") in self.CALLS:
            return self.CALLS[e.func.id].format(*map(self.sql, e.args))
        raise SyntaxError(f"line {e.lineno}: {ast.unparse(e)}")

    def tile(self, e: ast.expr) -> tuple[str, tuple[str, ...]]:
        return e.value.id, tuple(map(self.sql, e.slice.elts if isinstance(e.slice, ast.Tuple) else [e.slice]))

    def visit_For(self, node: ast.For) -> None:
        bounds = [self.sql(x) for x in node.iter.args]
        low, high, step = ["0", *bounds, "1"] if len(bounds) == 1 else [*bounds, "1"][:3]
        name, outer = node.target.id, self.names.get(node.target.id)
        if outer == name:
            raise SyntaxError(f"line {node.lineno}: {name} is a loop's variable already")
        self.names[name] = name
        self.variables += [name] if name not in self.variables else []
        self.loops.append((name, low, high, step))
        for x in node.body:
            self.visit(x)
        self.loops.pop()
        del self.names[name]

    def visit_If(self, node: ast.If) -> None:
        test = self.sql(node.test)
        for condition, body in ((test, node.body), (f"(NOT {test})", node.orelse)):
            self.conditions.append(condition)
            for x in body:
                self.visit(x)
            self.conditions.pop()

    def visit_Assign(self, node: ast.Assign) -> None:
        target, value = node.targets[0], node.value
        targets = target.elts if isinstance(target, ast.Tuple) else [target]
        if isinstance(targets[0], ast.Name):
            if targets[0].id in self.variables:
                raise SyntaxError(f"line {node.lineno}: {targets[0].id} is a loop's variable")
            self.names[targets[0].id] = self.sql(value)
            return
        reads = tuple(self.tile(a) for a in value.args if isinstance(a, ast.Subscript))
        where = " AND ".join(self.conditions) or "true"
        self.made.append(Statement(value.func.id, tuple(self.loops), reads, tuple(map(self.tile, targets)), where))


def compiled(source: str | Callable, inputs: tuple[str, ...], outputs: tuple[str, ...], **sizes: int) -> Program:
    """The program of a Python function, or of its text: ``for`` over ``range``, ``if`` and ``else``, and calls that assign tiles.

    ``sizes`` are the values of its integer arguments. The function is only read, never run.
    """
    tree = ast.parse(textwrap.dedent(source if isinstance(source, str) else inspect.getsource(source)))
    walk = _Compiler(sizes)
    for x in next(x for x in tree.body if isinstance(x, ast.FunctionDef)).body:
        walk.visit(x)
    return Program(tuple(walk.made), tuple(inputs), tuple(outputs), tuple(walk.variables))


def _log(n: str, base: int = 2) -> str:
    return f"ceil(log2({n}) / {base.bit_length() - 1})"


def gemm_program(m: int, n: int, k: int) -> Program:
    d = _log(str(k), 4)
    box = (("i", "0", str(m), "1"), ("j", "0", str(n), "1"))
    four = tuple(("Temp", ("i", "j", f"k + {c} * power(4, level)", "level")) for c in range(4))
    return Program(
        (
            Statement("gemm", (*box, ("k", "0", str(k), "1")), (("A", ("i", "k")), ("B", ("k", "j"))), (("Temp", ("i", "j", "k", "0")),)),
            Statement("add_matrices", (*box, ("level", "0", d, "1"), ("k", "0", str(k), "power(4, level + 1)")), four, (("Temp", ("i", "j", "k", "level + 1")),)),
            Statement("identity", box, (("Temp", ("i", "j", "0", d)),), (("Out", ("i", "j")),)),
        ),
        ("A", "B"), ("Out",),
    )


def cholesky_program(blocks: int, truncate: int = 0) -> Program:
    n = str(blocks - truncate)
    return Program(
        (
            Statement("chol", (), (("I", ("0", "0")),), (("O", ("0", "0")),)),
            Statement("trsm", (("j", "1", n, "1"),), (("O", ("0", "0")), ("I", ("j", "0"))), (("O", ("j", "0")),)),
            Statement("syrk", (("j", "1", n, "1"), ("k", "1", "j + 1", "1")), (("I", ("j", "k")), ("O", ("j", "0")), ("O", ("k", "0"))), (("S", ("1", "j", "k")),)),
            Statement("chol", (("i", "1", n, "1"),), (("S", ("i", "i", "i")),), (("O", ("i", "i")),)),
            Statement("trsm", (("i", "1", n, "1"), ("j", "i + 1", n, "1")), (("O", ("i", "i")), ("S", ("i", "j", "i"))), (("O", ("j", "i")),)),
            Statement("syrk", (("i", "1", n, "1"), ("j", "i + 1", n, "1"), ("k", "i + 1", "j + 1", "1")), (("S", ("i", "j", "k")), ("O", ("j", "i")), ("O", ("k", "i"))), (("S", ("i + 1", "j", "k")),)),
        ),
        ("I",), ("O",),
    )


def _factors(mats: str, *idx: str) -> tuple:
    return tuple((m, idx) for m in mats.split())


def tsqr_program(blocks: int) -> Program:
    d = _log(str(blocks))
    return Program(
        (
            Statement("qr_factor", (("j", "0", str(blocks), "1"),), (("A", ("j", "0")),), _factors("V T R", "0", "j")),
            Statement("qr_factor", (("level", "0", d, "1"), ("j", "0", str(blocks), "power(2, level + 1)")), (("R", ("level", "j")), ("R", ("level", "j + power(2, level)"))), _factors("V T R", "level + 1", "j")),
        ),
        ("A",), ("V", "T", "R"),
    )


def qr_program(blocks: int) -> Program:
    n = str(blocks)
    statements: list[Statement] = []
    for later in (False, True):
        i, loop = ("i", (("i", "1", n, "1"),)) if later else ("0", ())
        src = lambda r, c, i=i, later=later: ("S", (r, c, i, "0")) if later else ("I", (r, c))
        d = _log(f"{n} - {i}")
        tree = (("level", "0", d, "1"), ("j", i, n, "power(2, level + 1)"))
        after = ("k", f"{i} + 1", n, "1")
        statements += [
            Statement("qr_factor", (*loop, ("j", i, n, "1")), (src("j", i),), _factors("V T R", "j", i, d)),
            Statement("qr_factor_triangular", (*loop, *tree), (("R", ("j", i, f"{d} - level")), ("R", ("j + power(2, level)", i, f"{d} - level"))), _factors("V T R", "j", i, f"{d} - level - 1")),
            Statement("qr_leaf", (*loop, ("j", i, n, "1"), after), (*_factors("V T", "j", i, d), src("j", "k")), (("S", ("j", "k", f"{i} + 1", d)),)),
            Statement("qr_trailing_update", (*loop, after, *tree), (*_factors("V T", "j", i, f"{d} - 1 - level"), ("S", ("j", "k", f"{i} + 1", f"{d} - level")), ("S", ("j + power(2, level)", "k", f"{i} + 1", f"{d} - level"))), (("S", ("j", "k", f"{i} + 1", f"{d} - 1 - level")), ("S", ("j + power(2, level)", "k", f"{i} + 1", "0")))),
            Statement("identity", (*loop, after), (("S", (i, "k", f"{i} + 1", "0")),), (("R", (i, "k", "0")),)),
        ]
    return Program(tuple(statements), ("I",), ("R",))


def bdfac_program(blocks: int, truncate: int = 0) -> Program:
    n = str(blocks)
    statements: list[Statement] = []
    for later in (False, True):
        i, loop = ("i", (("i", "1", f"{n} - 1 - {truncate}", "1"),)) if later else ("0", ())
        src = lambda r, c, i=i, later=later: ("S_LQ", (f"{i} - 1", _log(f"{n} - {i}"), r, c)) if later else ("I", (r, c))
        d, e = _log(f"{n} - {i}"), _log(f"{n} - {i} - 1")
        half = "power(2, level - 1)"
        down, after = ("j", i, n, "1"), ("k", f"{i} + 1", n, "1")
        tree = (("level", "1", f"{d} + 1", "1"), ("j", i, n, "power(2, level)"))
        across = (("level", "1", f"{e} + 1", "1"), ("k", f"{i} + 1", n, "power(2, level)"))
        below = ("j", f"{i} + 1", n, "1")
        statements += [
            Statement("qr_factor", (*loop, down), (src("j", i),), _factors("V_QR T_QR R_QR", i, "0", "j")),
            Statement("qr_leaf", (*loop, down, after), (*_factors("V_QR T_QR", i, "0", "j"), src("j", "k")), (("S_QR", (i, "0", "j", "k")),)),
            Statement("qr_factor", (*loop, *tree), (("R_QR", (i, "level - 1", "j")), ("R_QR", (i, "level - 1", f"j + {half}"))), _factors("V_QR T_QR R_QR", i, "level", "j")),
            Statement("qr_trailing_update", (*loop, *tree, after), (*_factors("V_QR T_QR", i, "level", "j"), ("S_QR", (i, "level - 1", "j", "k")), ("S_QR", (i, "level - 1", f"j + {half}", "k"))), (("S_QR", (i, "level", "j", "k")), ("S_QR", (i, d, f"j + {half}", "k")))),
            Statement("lq_factor", (*loop, after), (("S_QR", (i, d, i, "k")),), _factors("V_LQ T_LQ L_LQ", i, "0", "k")),
            Statement("lq_leaf", (*loop, below, after), (*_factors("V_LQ T_LQ", i, "0", "k"), ("S_QR", (i, d, "j", "k"))), (("S_LQ", (i, "0", "j", "k")),)),
            Statement("lq_factor", (*loop, *across), (("L_LQ", (i, "level - 1", "k")), ("L_LQ", (i, "level - 1", f"k + {half}"))), _factors("V_LQ T_LQ L_LQ", i, "level", "k")),
            Statement("lq_trailing_update", (*loop, *across, below), (*_factors("V_LQ T_LQ", i, "level", "k"), ("S_LQ", (i, "level - 1", "j", "k")), ("S_LQ", (i, "level - 1", "j", f"k + {half}"))), (("S_LQ", (i, "level", "j", "k")), ("S_LQ", (i, e, "j", f"k + {half}")))),
        ]
    m = blocks - 1
    statements.append(Statement("qr_factor", (), (("S_LQ", (str(m - 1), "0", str(m), str(m))),), _factors("V_QR T_QR R_QR", str(m), "0", str(m))))
    return Program(tuple(statements), ("I",), ("R_QR", "L_LQ"))


def flops(program: Program, spark: SparkSession, tile: int) -> DataFrame:
    """``kernel, tasks, flops`` over tiles of ``tile`` by ``tile``. A kernel without a model is an error."""
    return counters(program, spark, tile).select("kernel", "tasks", "flops")


def counters(program: Program, spark: SparkSession, tile: int) -> DataFrame:
    """``kernel, tasks, flops, tiles_read, tiles_written, bytes_read, bytes_written`` of a whole run, tiles being doubles."""
    costs = []
    for number, s in enumerate(program.statements):
        if s.kernel not in kernels.FLOPS:
            raise KeyError(f"no flop model of {s.kernel}")
        costs.append((number, float(kernels.FLOPS[s.kernel](tile, len(s.reads))), len(s.reads), len(s.writes)))
    cost = spark.createDataFrame(costs, "stmt int, each double, reads long, writes long")
    sums = program.tasks(spark).join(F.broadcast(cost), "stmt").groupBy("kernel").agg(F.count(F.lit(1)).alias("tasks"), F.sum("each").alias("flops"), F.sum("reads").alias("tiles_read"), F.sum("writes").alias("tiles_written"))
    size = 8 * tile * tile
    return sums.withColumns({"bytes_read": F.col("tiles_read") * size, "bytes_written": F.col("tiles_written") * size})


def status(program: Program, spark: SparkSession, finished: DataFrame) -> DataFrame:
    """``status, tasks``: FINISHED, READY (all that it reads from is finished) or NOT_READY, given the finished tasks (``task``)."""
    every = program.tasks(spark).select(F.struct("stmt", *program.variables).alias("task"))
    done = finished.select("task").distinct().withColumn("done", F.lit(True))
    waiting = program.edges(spark).join(done.select(F.col("task").alias("parent")), "parent", "left_anti").select(F.col("child").alias("task")).distinct().withColumn("waits", F.lit(True))
    state = F.when(F.col("done"), "FINISHED").when(F.col("waits"), "NOT_READY").otherwise("READY")
    return every.join(done, "task", "left").join(waiting, "task", "left").groupBy(state.alias("status")).agg(F.count(F.lit(1)).alias("tasks"))
