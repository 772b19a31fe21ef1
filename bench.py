"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and GFLOP/s of products and factorisations; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tilespark import queries as core
from tilespark.operators import factor, gemm
from tilespark.session import get_session
from tilespark.sources.matrix import TILES, Meta

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = (
    "gram", "gram_rows", "gemm", "gemm_tiled", "syrk_lower", "transpose", "submatrix_step", "reshard_general", "add",
    "norm_by_row", "argmin_col", "cholesky_reconstruct", "cholesky_one_task", "posv_ols", "tsqr_gram", "tsqr_r_small",
    "qr_gram", "tsqr_product", "qr_ols", "bdfac_frobenius", "singular_values", "nearest_neighbor", "chol_edges", "qr_edges", "busy_time",
)


#: Operation, rows, tile and flops per cubed row.
RATES = (("gemm", 1024, 128, 2.0), ("gemm", 2048, 256, 2.0), ("cholesky", 1024, 256, 1 / 3), ("qr", 512, 128, 4 / 3), ("bdfac", 256, 64, 8 / 3))


def random_tiles(spark, n: int, tile: int, dominant: bool = False):
    """A seeded matrix made where it is used; symmetric with a heavy diagonal if ``dominant``."""
    blocks = n // tile

    def make(frames):
        for f in frames:
            rows = []
            for bi, bj in f.itertuples(index=False):
                lo, hi = sorted((bi, bj)) if dominant else (bi, bj)
                x = np.random.default_rng([lo, hi]).normal(size=(tile, tile))
                x = x.T if dominant and bi > bj else x
                x = x + x.T + 8 * n * np.eye(tile) if dominant and bi == bj else x
                rows.append((bi, bj, tile, tile, x.reshape(-1)))
            yield pd.DataFrame(rows, columns=["bi", "bj", "nrows", "ncols", "data"])

    grid = spark.range(blocks * blocks).select(F.expr(f"int(id div {blocks})").alias("bi"), F.expr(f"int(id % {blocks})").alias("bj"))
    return grid.repartition(min(64, blocks * blocks)).mapInPandas(make, TILES)


def rate(spark, kind: str, n: int, tile: int, each: float) -> float:
    """GFLOP/s of a tiled run, all stages and checkpoints included."""
    x, meta = random_tiles(spark, n, tile, kind == "cholesky"), Meta((n, n), (tile, tile))
    began = time.time()
    out = gemm.gemm_tiles(x, x) if kind == "gemm" else factor.cholesky(x, meta, tiled=True) if kind == "cholesky" else getattr(factor, kind)(x, meta, tiled=True)
    out.write.format("noop").mode("overwrite").save()
    return each * n**3 / (time.time() - began) / 1e9


def main() -> None:
    spark = get_session(f"local[{CPUS}]", CPUS, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    core.QUERIES["transpose"](spark, SF_DIR).count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        core.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    rates = {f"{kind}_{n}_tile{tile}": round(rate(spark, kind, n, tile, each), 3) for kind, n, tile, each in RATES}
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "gflops": rates, "sf": sf, "cpus": CPUS}))


if __name__ == "__main__":
    main()
