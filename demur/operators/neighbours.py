"""Exact mean distance to the k nearest rows of a fit set.

Fit rows are dealt to pivots, centres of a bounded sample, and every cell knows the least and the largest distance from its pivot. A first round compares each query
with its home cells only and so gives it an upper bound; the second visits just those cells that can hold something nearer: by the triangle inequality a cell
whose pivot is at distance d holds nothing nearer than d less its radius. Every comparison that could matter is made, so the result is exact for any
pivots, and the sizes of cells only decide where work is done. On data without any structure all cells have to be visited, each query once per cell.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from demur.sources.staging import open_store, shared_folder, stage

K = 10
BROADCAST_BYTES = 256 << 20
#: Fit rows of a cell that are wanted, rows of a chunk of a cell or of its queries, pivots, and bytes of the sample they are made from.
BLOCK_ROWS, CHUNK_ROWS = 2048, 8192
MOST_PIVOTS, SAMPLE_BYTES, ROUNDS = 2048, 64 << 20, 5


def nearest_squares(x: np.ndarray, fit: np.ndarray | Iterable[np.ndarray], k: int) -> np.ndarray:
    """Squared distances to the k nearest fit rows, ascending; ``fit`` is one matrix or its parts, one after the other.

    Blocks of queries meet parts of the fit rows, so the memory is that of a block whatever the number of rows. One matrix product finds the neighbours; their
    distances are then taken from differences, which is exact where the expansion cancels (a row against itself).
    """
    width = max(1, x.shape[1])
    step, rows = int(np.clip((1 << 18) // width, 64, 1024)), part_rows(width)
    parts = (fit[i:i + rows] for i in range(0, len(fit), rows)) if isinstance(fit, np.ndarray) else fit
    found, exact, n = np.full((len(x), k), np.inf), np.full((len(x), k), np.inf), 0
    for part in parts:
        norms, n = np.einsum("ij,ij->i", part, part), n + len(part)
        for i in range(0, len(x), step):
            q, best = x[i:i + step], found[i:i + step]
            d = q @ part.T
            d *= -2
            d += norms
            row, col = np.divmod(np.flatnonzero(d < best.max(1)[:, None]), len(part))
            if len(row) > 4 * k * len(q):
                m = min(k, len(part))
                row, col = np.repeat(np.arange(len(q)), m), np.argpartition(d, m - 1, axis=1)[:, :m].ravel()
            if not len(row):
                continue
            of = np.concatenate([np.repeat(np.arange(len(q)), k), row])
            value = np.concatenate([best.ravel(), d[row, col]])
            square = np.concatenate([exact[i:i + step].ravel(), ((q[row] - part[col]) ** 2).sum(1)])
            order = np.lexsort((value, of))
            kept = order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < k]
            found[i:i + step], exact[i:i + step] = value[kept].reshape(-1, k), square[kept].reshape(-1, k)
    out = np.sort(exact[:, :min(k, n)], axis=1)
    out[~np.isfinite(out)] = np.nan
    return out


def part_rows(width: int) -> int:
    """Fit rows that are compared at once."""
    return int(np.clip((1 << 21) // max(1, width), 256, 4096))


@dataclass(frozen=True)
class RowFiles:
    """Rows of equal width as plain numbers in files of the shared folder, read a part at a time."""
    folder: str
    files: list[str]
    width: int

    def parts(self) -> Iterator[np.ndarray]:
        store, root = open_store(self.folder)
        size = part_rows(self.width) * self.width * 8
        for name in self.files:
            with store.open_input_stream(f"{root}/{name}") as file:
                while len(data := file.read(size)):
                    yield np.frombuffer(data).reshape(-1, self.width)


def write_rows(rows: DataFrame, x: str, width: int) -> RowFiles:
    """Write the arrays of ``x`` from the tasks that have them; the driver learns a name per task."""
    folder = f"{shared_folder(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name, out = uuid.uuid4().hex, None
        for batch in batches:
            if len(batch):
                out = out or store.open_output_stream(f"{root}/{name}")
                out.write(np.ascontiguousarray(_wide(batch.column(0)), np.float64).tobytes())
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    names = rows.select(F.col(x).cast("array<double>").alias("x")).mapInArrow(write, "file string").collect()
    return RowFiles(folder, sorted(r["file"] for r in names), width)


def _stack(s: pd.Series) -> np.ndarray:
    return np.vstack(s.to_numpy()).astype(np.float64)


def broadcast_fit(fit: DataFrame, x: str, limit: int = BROADCAST_BYTES) -> RowFiles | None:
    """The fit rows as files that every task walks over, if they are not larger than ``limit`` bytes, else None."""
    first = fit.select(x).first()
    if first is None or fit.count() * len(first[0]) * 8 > limit:
        return None
    return write_rows(fit, x, len(first[0]))


def knn_distance(queries: DataFrame, fit: DataFrame, x: str, ident: str, k: int = K,
                 broadcast_bytes: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Columns ``ident`` and ``knn_dist``, one row per row of ``queries``; none where the fit set is empty.

    ``broadcast_bytes`` lets every task walk over a fit set of at most so many bytes instead.
    """
    held = broadcast_fit(fit, x, broadcast_bytes) if broadcast_bytes else None
    if held is not None:
        @F.pandas_udf("double")
        def distance(v: pd.Series) -> pd.Series:
            return pd.Series(np.sqrt(nearest_squares(_stack(v), held.parts(), k)).mean(1)) if len(v) else pd.Series([], dtype=float)

        return queries.select(ident, distance(F.col(x)).alias("knn_dist"))
    # A key of its own for every query, as ids may repeat; written, so that all rounds see the same.
    keyed = stage(queries.select(F.col(ident).alias("id"), F.col(x).cast("array<double>").alias("x"), F.monotonically_increasing_id().alias("key")), "queries")
    near = nearest_by_pivots(keyed.select("key", "x"), fit.select(F.col(x).cast("array<double>").alias("x")), k, block_rows)
    mean = near.groupBy("key").agg(F.avg(F.sqrt("d2")).alias("knn_dist"))
    return keyed.select("key", F.col("id").alias(ident)).join(mean, "key").select(ident, "knn_dist")


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` centres of the sample by a few rounds of k-means; they need not be good ones."""
    centres = sample[np.random.default_rng(3).permutation(len(sample))[:n]].copy()
    for _ in range(ROUNDS):
        at = np.concatenate([_to_centres(sample[i:i + 4096], centres).argmin(1) for i in range(0, len(sample), 4096)])
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _to_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows to centres, from differences where the expansion would cancel."""
    squares = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    small = np.argwhere(squares < 1e-6 * ((x * x).sum(1)[:, None] + 1e-300))
    squares[small[:, 0], small[:, 1]] = ((x[small[:, 0]] - centres[small[:, 1]]) ** 2).sum(1)
    return np.sqrt(np.maximum(squares, 0))


def _wide(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def visits(to_pivot: np.ndarray, bound: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which cells (columns) can hold a row nearer than ``bound`` to a query (rows); a little slack covers rounding."""
    slack = 1e-7 * (to_pivot + most)
    return np.maximum(to_pivot - most, least - to_pivot) - slack < bound[:, None]


def homes(to_pivot: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The nearest cells of every query until they hold k rows."""
    order = np.argsort(to_pivot, axis=1, kind="stable")
    before = np.cumsum(counts[order], axis=1) - counts[order]
    out = np.zeros(to_pivot.shape, bool)
    np.put_along_axis(out, order, (before < k) & (counts[order] > 0), axis=1)
    return out


def nearest_by_pivots(queries: DataFrame, fit: DataFrame, k: int, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """key, d2: squared distances of every query (key, x) to its k nearest rows of ``fit`` (x)."""
    spark, schema = fit.sparkSession, "key long, d2 double"
    n, first = fit.count(), fit.first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = len(first["x"])
    pivots = int(np.clip(-(-n // block_rows), 1, MOST_PIVOTS))
    sampled = max(pivots, min(20 * pivots, SAMPLE_BYTES // (8 * max(1, width))))
    sample = _wide(fit.orderBy(F.xxhash64("x")).limit(sampled).toArrow().column(0).combine_chunks())
    centres = spark.sparkContext.broadcast(_centres(sample, pivots))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = _to_centres(_wide(batch.column(0)), centres.value)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at])], names=["x", "cell", "d"])

    cells = stage(fit.mapInArrow(dealt, "x array<double>, cell int, d double"), "cells")
    known = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least"), F.max("d").alias("most")).toArrow().to_pydict()  # a row per pivot
    counts, least, most = np.zeros(pivots, np.int64), np.full(pivots, np.inf), np.full(pivots, -np.inf)
    counts[known["cell"]], least[known["cell"]], most[known["cell"]] = known["n"], known["least"], known["most"]

    def compare(asking: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """Nearest rows in the chosen cells of every query (key, x, bound) that are nearer than its bound."""
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            for batch in batches:
                for i in range(0, len(batch), 1024):
                    some = batch.slice(i, 1024)
                    yield some, chosen(_to_centres(_wide(some.column(1)), centres.value), some.column(2).to_numpy(zero_copy_only=False))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((c.sum(0) for _, c in walk(batches)), np.zeros(pivots, np.int64))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some, c in walk(batches):
                row, cell = np.nonzero(c)
                for i in range(0, len(row), 4096):
                    took = some.take(pa.array(row[i:i + 4096]))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell[i:i + 4096], pa.int32())], names=["key", "x", "bound", "cell"])

        asked = {r["cell"]: r["n"] for r in asking.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            return spark.createDataFrame([], schema)
        table = F.broadcast(spark.createDataFrame([(c, max(1, -(-int(counts[c]) // chunk_rows)), -(-m // chunk_rows)) for c, m in asked.items()], "cell int, chunks int, deals int"))
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        rows = cells.join(table, "cell").select("cell", F.pmod(F.xxhash64("x", "d"), "chunks").cast("int").alias("chunk"), each("deals").alias("deal"), "x")
        visiting = asking.mapInArrow(spread, "key long, x array<double>, bound double, cell int").join(table, "cell").select(
            "cell", each("chunks").alias("chunk"), F.pmod(F.xxhash64("key"), "deals").cast("int").alias("deal"), "key", "x", "bound")

        def near(mine: pa.Table, there: pa.Table) -> pa.Table:
            if not len(mine) or not len(there):
                return pa.table({"key": pa.array([], pa.int64()), "d2": pa.array([], pa.float64())})
            d2 = nearest_squares(_wide(mine["x"].combine_chunks()), _wide(there["x"].combine_chunks()), k)
            kept = d2 < (mine["bound"].to_numpy() ** 2)[:, None]
            return pa.table({"key": mine["key"].to_numpy()[np.nonzero(kept)[0]], "d2": d2[kept]})

        keys = ["cell", "chunk", "deal"]
        return visiting.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(near, schema)

    best = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("d2"))).where(F.col("place") <= k).select("key", "d2")
    at_home = stage(best(compare(queries.withColumn("bound", F.lit(float("inf"))), lambda d, _: homes(d, counts, k))), "near")
    bounds = at_home.groupBy("key").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d2"))).otherwise(F.lit(float("inf"))).alias("bound"))
    away = compare(queries.join(bounds, "key").select("key", "x", "bound"), lambda d, b: visits(d, b, least, most) & ~homes(d, counts, k))
    return best(at_home.unionByName(away))
