"""Heads trained on shuffled errors, dealt over tasks: no shuffled column is written or travels.

A shuffle is an order of hashes, so a task makes the shuffles of its placebos itself, from one copy of the rows in files. A head of two features needs only the products of
the features with the shuffled errors, and its effect only the least scores of each band; neither needs a sort over all tasks. What is written does not depend on the
number of placebos, and a task holds at most about ``HELD`` rows: larger tables are shuffled by ranges of the hash, larger bands narrowed by counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType, StructType

from .draws import slices, write_runs

#: Rows a task holds, counts of a narrowing step, bits of a hash.
HELD, BINS, BITS = 8_000_000, 65_536, 52


def hashes(placebo: int, ids: np.ndarray) -> np.ndarray:
    """``functions.draws.uniform("permute", placebo, id)`` times 2 ** 52."""
    md5, start = hashlib.md5, f"permute|{placebo}|".encode()
    return np.frombuffer(b"".join([md5(b"%b%d" % (start, i)).digest()[:8] for i in ids.tolist()]), ">u8").astype(np.uint64) >> np.uint64(64 - BITS)


def _dealt(spark, count: int, work: Callable[[list[int]], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``work`` makes of a task's share of the numbers below ``count``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [i for batch in batches for i in batch.column(0).to_pylist()]
        if mine:
            yield pa.RecordBatch.from_pylist([dict(zip(wanted.names, row)) for row in work(mine)], schema=wanted)

    return spark.range(0, count, 1, max(1, min(count, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def _by_code(code: np.ndarray, codes: int) -> list[np.ndarray]:
    """Positions of every code, in order."""
    order = np.argsort(code, kind="stable")
    return np.split(order, np.searchsorted(code[order], np.arange(1, codes)))


def shuffled_products(rows: DataFrame, placebos: int, a: str, b: str, y: str, centres: tuple[float, float, float], ident: str = "id", band: str = "band") -> DataFrame:
    """``kind``, ``placebo``, ``ay``, ``by``: sums of centred products with ``y`` shuffled, over all rows (global) and inside bands (band), a row per part of the hashes.

    As in ``splits.permute``, the row at place r by id gets the ``y`` of the row at place r by hash; bands are numbered from 0.
    """
    if not isinstance(rows.schema[ident].dataType, IntegralType):
        raise ValueError("ids are hashed as whole numbers")
    ma, mb, my = centres
    columns = [F.col(ident).alias("id"), F.col(band).alias("code"), *[F.col(c).cast("double").alias(n) for n, c in (("a", a), ("b", b), ("y", y))]]
    runs = write_runs(rows.select(*columns), [], ["id"], {"id": "<i8", "code": "<i4", "a": "<f8", "b": "<f8", "y": "<f8"})
    cut = [c for _, stretches in runs.groups for c in slices(stretches)]
    parts = max(1, -(-sum(n for _, _, n in cut) // HELD))

    def products(placebo: int, part: int) -> list[tuple]:
        read = runs.reader()
        low, high = (part << BITS) // parts, (part + 1 << BITS) // parts
        before, held = np.zeros(1, np.int64), []
        for c in cut:
            u, code = hashes(placebo, read("id", *c)), read("code", *c)
            under = np.bincount(code[u < low], minlength=len(before))
            under[:len(before)] += before
            before = np.pad(under, (0, max(0, code.max() + 1 - len(under))))
            there = (u >= low) & (u < high)
            held.append((u[there], code[there], read("y", *c)[there]))
        u, code, y = (np.concatenate(h) for h in zip(*held))
        held.clear()
        # Rows come in the order of ids, which settles equal hashes.
        order = np.argsort(u, kind="stable")
        code, y = code[order], y[order] - my
        codes = len(before)
        # For both kinds the errors of every group in drawn order, the place of the first of them, and the rows of the group met so far.
        views = {"global": ([y], [int(before.sum())], [0]), "band": ([y[at] for at in _by_code(code, codes)], before.tolist(), [0] * codes)}
        sums = {kind: [0.0, 0.0] for kind in views}
        for c in cut:
            xa, xb, code = read("a", *c) - ma, read("b", *c) - mb, read("code", *c)
            for kind, places in (("global", [slice(None)]), ("band", _by_code(code, codes))):
                drawn, first, met = views[kind]
                for g, at in enumerate(places):
                    ga, gb = xa[at], xb[at]
                    start, stop = max(0, first[g] - met[g]), min(len(ga), first[g] + len(drawn[g]) - met[g])
                    if start < stop:
                        some = drawn[g][met[g] + start - first[g]:met[g] + stop - first[g]]
                        sums[kind][0] += float(ga[start:stop] @ some)
                        sums[kind][1] += float(gb[start:stop] @ some)
                    met[g] += len(ga)
        return [(kind, placebo, *s) for kind, s in sums.items()]

    def work(mine: list[int]) -> list[tuple]:
        return [row for i in mine for row in products(i // parts + 1, i % parts)]

    return _dealt(rows.sparkSession, placebos * parts if cut else 0, work, "kind string, placebo int, ay double, by double")


def placebo_heads(rows: DataFrame, placebos: int, a: str, b: str, y: str, alpha: float, ident: str = "id", band: str = "band") -> DataFrame:
    """``kind``, ``placebo``, ``ma, mb, my, wa, wb`` (``lines.pair_heads``): the real head (placebo 0) and heads on errors shuffled over all rows or inside bands."""
    n = F.count(F.lit(1))
    m = rows.agg(n.alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"), (F.var_pop(a) * n + alpha).alias("aa"), (F.var_pop(b) * n + alpha).alias("bb"),
                 (F.covar_pop(a, b) * n).alias("ab"), (F.covar_pop(a, y) * n).alias("ay"), (F.covar_pop(b, y) * n).alias("by")).first()
    real = rows.sparkSession.createDataFrame([(kind, 0, m["ay"], m["by"]) for kind in ("global", "band") if m["n"]], "kind string, placebo int, ay double, by double")
    fake = shuffled_products(rows, placebos, a, b, y, (m["ma"], m["mb"], m["my"]), ident, band).groupBy("kind", "placebo").agg(F.sum("ay").alias("ay"), F.sum("by").alias("by"))
    aa, bb, ab = (F.lit(m[c]) for c in ("aa", "bb", "ab"))
    det = aa * bb - ab * ab
    return real.unionByName(fake).select("kind", "placebo", *[F.lit(m[c]).alias(c) for c in ("ma", "mb", "my")],
                                         ((F.col("ay") * bb - F.col("by") * ab) / det).alias("wa"), ((F.col("by") * aa - F.col("ay") * ab) / det).alias("wb"))


def _least(parts: Callable[[], Iterator[np.ndarray]], n: int, k: int) -> int:
    """The ``k``-th smallest of ``n`` whole numbers that come in parts, as often as asked for."""
    low, high, below, inside = None, None, 0, n
    while inside > HELD:
        if low is None:
            ends = [(p.min(), p.max()) for p in parts()]
            low, high = int(min(e[0] for e in ends)), int(max(e[1] for e in ends))
        if low == high:
            return low
        width = (high - low) // BINS + 1
        counts = sum(np.bincount((p[(p >= low) & (p <= high)] - low) // width, minlength=BINS) for p in parts())
        upto = below + np.cumsum(counts)
        at = int(np.searchsorted(upto, k))
        below, inside = int(upto[at] - counts[at]), int(counts[at])
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    held = np.concatenate([p if low is None else p[(p >= low) & (p <= high)] for p in parts()])
    return int(np.partition(held, k - below - 1)[k - below - 1])


def kept_by_head(rows: DataFrame, heads: list[dict], a: str, b: str, units: str, coverage: float, ident: str = "id", band: str = "band", digits: int = 5) -> DataFrame:
    """``kind``, ``placebo``, ``k``, ``kept``: rows and whole ``units`` that every head keeps, the same share inside every band, by score rounded to ``digits``, then id."""
    columns = [F.col(band).alias("band"), F.col(ident).alias("id"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(units).cast("long").alias("units")]
    runs = write_runs(rows.select(*columns), ["band"], ["id"], {"a": "<f8", "b": "<f8", "units": "<i8"})
    scale = 10.0 ** digits

    def score(head: dict, xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
        """Rounded half away from zero, as whole numbers."""
        s = ((xa - head["ma"]) * head["wa"] + (xb - head["mb"]) * head["wb"] + head["my"]) * scale
        size = np.floor(np.abs(s))
        size += np.abs(s) - size >= 0.5
        return np.copysign(size, s).astype(np.int64)

    def work(mine: list[int]) -> list[tuple]:
        read, total = runs.reader(), {i: [0, 0] for i in mine}
        for _, stretches in runs.groups:
            cut, n = slices(stretches), sum(s[2] for s in stretches)
            load = lambda c: (read("a", *c), read("b", *c), read("units", *c))
            whole = [tuple(np.concatenate(x) for x in zip(*map(load, cut)))] if n <= HELD else None
            every = lambda: whole or map(load, cut)
            k = int(max(1, np.rint(coverage * n)))
            for i in mine:
                at = _least(lambda: (score(heads[i], xa, xb) for xa, xb, _ in every()), n, k)
                kept, count, ties = 0, 0, []
                for xa, xb, loss in every():
                    s = score(heads[i], xa, xb)
                    kept += int(loss[s < at].sum())
                    count += int((s < at).sum())
                    ties.append(loss[s == at][:k])
                kept += int(np.concatenate(ties)[:k - count].sum())
                total[i] = [total[i][0] + k, total[i][1] + kept]
        return [(heads[i]["kind"], heads[i]["placebo"], *total[i]) for i in mine]

    return _dealt(rows.sparkSession, len(heads) if runs.groups else 0, work, "kind string, placebo int, k long, kept long")
