"""Ranks, running sums and order statistics over a global order.

A window without partition keys, or with a key that holds most rows, sorts everything in one task. Here a
group that is larger than ``ROWS_PER_BUCKET`` is split into ordered buckets at sampled split points. The
split points only decide where rows are sorted; results are exact for any split points, ties included,
because a split point is a full ``(order columns)`` tuple.

* ``running``  every row with its rank and running sums: buckets are sorted in parallel and shifted by the
  totals of the buckets before them.
* ``take_at``  the prefix sums at chosen ranks only. Whole buckets are summed without sorting, and only the
  buckets that hold a wanted rank are sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from demur.functions.expr import half_even_k
from demur.sources.staging import stage

ROWS_PER_BUCKET = 2_000_000
SAMPLES_PER_BUCKET = 20
_FAN = 64


@dataclass
class Splits:
    """Split points of the large groups, as a small table ``(keys, tops, edges)``."""
    table: DataFrame
    keys: list[str]


def find_splits(df: DataFrame, keys: list[str], order: list[str],
                rows_per_bucket: int | None = None) -> Splits | None:
    """Sample ordered split points for groups that need more than one bucket.

    The sample is a fixed fraction of the rows (20 per bucket, 10 rows per million), so it needs no count first. It is
    counted, ranked and thinned on the executors; the driver sees one number. The table has one tuple per bucket,
    and rows at any split points give the same result. Returns None when every group is small.
    """
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    step, columns = SAMPLES_PER_BUCKET, list(keys) + list(order)
    picked = df.select(*columns)
    sample = picked.sample(fraction=min(1.0, step / rows_per_bucket), seed=7)
    largest = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if (largest or 0) <= 2 * step:
        return None
    part = Window.partitionBy(*keys)
    at = F.row_number().over(part.orderBy(*_order_columns(order))) - 1
    thin = (sample.select("*", at.alias("_at"), F.count(F.lit(1)).over(part).alias("_n"))
            .filter((F.col("_n") > 2 * step) & (F.col("_at") > 0) & (F.col("_at") % step == 0)))
    edges = thin.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(*[F.col(c) for c in order]))).alias("edges"))
    tops = F.transform(F.sequence(F.lit(1), F.size("edges"), F.lit(_FAN)), lambda i: F.get("edges", i - 1))
    return Splits(stage(edges.withColumn("tops", tops), "splits"), list(keys))


def with_bucket(df: DataFrame, keys: list[str], order: list[str], splits: Splits) -> DataFrame:
    """Add ``_bucket``: how many split points of the row's group are at or before the row.

    The split table holds a tuple per ROWS_PER_BUCKET rows, a millionth of the data, so it is broadcast. Two levels of 64
    keep the search short.
    """
    at = F.struct(*[F.col(c) for c in order])
    small = F.broadcast(splits.table)
    if splits.keys:
        joined = _null_safe(df, small, splits.keys, "left")
    else:
        joined = df.withColumn("__one", F.lit(1)).join(
            small.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")
    joined = joined.withColumn("__at", at).withColumn(
        "__top", F.size(F.filter("tops", lambda e: e <= F.col("__at"))))
    fine = F.slice(F.col("edges"), (F.col("__top") - 1) * _FAN + 1, F.lit(_FAN))
    bucket = (F.when(F.col("tops").isNull() | (F.col("__top") == 0), F.lit(0))
              .otherwise((F.col("__top") - 1) * _FAN
                         + F.size(F.filter(fine, lambda e: e <= F.col("__at")))))
    return joined.withColumn("__bucket", bucket.cast("int")).drop("tops", "edges", "__top", "__at")


def _order_columns(order: list[str]) -> list[Column]:
    return [F.col(c).asc() for c in order]


def running(df: DataFrame, order: list[str], keys: list[str] = (), sums: dict[str, str] | None = None,
            rank: str = "rank", weight: str | None = None, size: str | None = None,
            rows_per_bucket: int | None = None, split_source: DataFrame | None = None,
            split_keys: list[str] | None = None) -> DataFrame:
    """Add the 1-based rank (or running weight) and inclusive running sums inside each key group.

    ``sums`` maps new column -> summed column. ``size`` names a column for the group's total count or weight.
    ``order`` must be a total order. Split points are sampled from ``split_source`` by ``split_keys`` when the
    rows are a replicated form of it.
    """
    keys, sums = list(keys), dict(sums or {})
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    splits = find_splits(df if split_source is None else split_source,
                         keys if split_keys is None else list(split_keys), order, rows_per_bucket)
    if splits is None:
        part = Window.partitionBy(*keys)
        ordered = part.orderBy(*_order_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn(rank, F.sum(w).over(ordered))
        for new, col in sums.items():
            out = out.withColumn(new, F.sum(col).over(ordered))
        return out.withColumn(size, F.sum(w).over(part)) if size else out

    rows = with_bucket(df, keys, order, splits)
    totals = rows.groupBy(*keys, "__bucket").agg(
        F.sum(w).alias("__w"), *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    part = Window.partitionBy(*keys)
    before = part.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *keys, "__bucket", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__w0"),
        F.sum("__w").over(part).alias("__n"),
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums])
    local = Window.partitionBy(*keys, "__bucket").orderBy(*_order_columns(order)).rowsBetween(
        Window.unboundedPreceding, 0)
    out = rows.withColumn(rank, F.sum(w).over(local))
    for new, col in sums.items():
        out = out.withColumn(new, F.sum(col).over(local))
    out = _join_keys(out, shifts, keys + ["__bucket"])
    out = out.withColumn(rank, F.col(rank) + F.col("__w0"))
    for new in sums:
        out = out.withColumn(new, F.col(new) + F.col(f"__s_{new}"))
    if size:
        out = out.withColumn(size, F.col("__n"))
    return out.drop("__bucket", "__w0", "__n", *[f"__s_{n}" for n in sums])


def _join_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi-join that keeps null keys and the left columns."""
    return _null_safe(left, right, on, "inner")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    other = {k: f"__k_{k}" for k in on}
    right = right.withColumnsRenamed(other)
    return left.join(right, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()], how).drop(*other.values())


@dataclass(frozen=True)
class Targets:
    """Wanted ranks: an array of structs that name them, and the rank as an expression over the fields of a
    struct and ``n``, the group's total weight."""
    cells: Column
    k: Column

    def explode(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", F.inline(self.cells)).withColumn("k", self.k.cast("bigint"))


def take_at(df: DataFrame, keys: list[str], order: list[str], targets: Targets, values: dict[str, str],
            weight: str | None = None, splits: Splits | None = None) -> DataFrame:
    """Prefix sums at wanted ranks: one row per key group and target.

    Result columns: keys, the target's fields, ``k``, ``n``, one column per entry of ``values`` (sum of the first
    ``k`` copies) and the order columns of the row that holds copy ``k``. ``splits`` come from ``find_splits``; its
    keys may be a subset of ``keys``. A row is matched with the targets by an explode and a filter, which is one
    loop in generated code; testing all targets in one expression makes a method too long to compile.
    """
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    part = Window.partitionBy(*keys)
    if splits is None:
        ordered = part.orderBy(*_order_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
        rows = df.select(*keys, *order, w.alias("__m"), *[F.col(c).alias(f"__v_{n}") for n, c in values.items()])
        rows = rows.select("*", F.sum("__m").over(ordered).alias("__w"),
                           *[F.sum(F.col("__m") * F.col(f"__v_{n}")).over(ordered).alias(f"__e_{n}")
                             for n in values])
        # The total after the running sums: it reuses their sort.
        rows = rows.select("*", F.sum("__m").over(part).alias("n"))
    else:
        rows = with_bucket(df, splits.keys, order, splits)
        rows = rows.select(*keys, "__bucket", *order, w.alias("__m"),
                           *[F.col(c).alias(f"__v_{n}") for n, c in values.items()])
        totals = rows.groupBy(*keys, "__bucket").agg(
            F.sum("__m").alias("__bw"), *[F.sum(F.col("__m") * F.col(f"__v_{n}")).alias(f"__bt_{n}") for n in values])
        before = part.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(
            "*", F.sum("__bw").over(part).alias("n"), F.coalesce(F.sum("__bw").over(before), F.lit(0)).alias("__w0"),
            *[F.coalesce(F.sum(f"__bt_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in values])
        wanted = targets.explode(totals).filter("k > __w0 AND k <= __w0 + __bw").select(
            *keys, "__bucket", "n", "__w0", *[f"__s_{n}" for n in values]).distinct()
        rows = _join_keys(rows, wanted, list(keys) + ["__bucket"])
        local = Window.partitionBy(*keys, "__bucket").orderBy(*_order_columns(order)).rowsBetween(
            Window.unboundedPreceding, 0)
        rows = rows.select("*", (F.sum("__m").over(local) + F.col("__w0")).alias("__w"),
                           *[(F.sum(F.col("__m") * F.col(f"__v_{n}")).over(local) + F.col(f"__s_{n}"))
                             .alias(f"__e_{n}") for n in values])
    hit = targets.explode(rows).filter("k > __w - __m AND k <= __w")
    over = F.col("__w") - F.col("k")
    fields = [c for c in hit.columns if c not in rows.columns]
    return hit.select(*keys, *fields, "n",
                      *[(F.col(f"__e_{n}") - over * F.col(f"__v_{n}")).alias(n) for n in values], *order)


def coverage_targets(coverages) -> Targets:
    """One target per coverage, at the half-even kept count."""
    cells = F.array(*[F.struct(F.lit(float(c)).alias("coverage")) for c in coverages])
    return Targets(cells, half_even_k(F.col("coverage"), F.col("n")))


def conformal_rank(n: Column, alpha: float) -> Column:
    """1-based rank ``min(ceil((n + 1)(1 - alpha)), n)``."""
    return F.least(F.ceil((n + 1) * F.lit(1.0 - alpha)).cast("bigint"), n.cast("bigint"))


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct value with its count, so that a value shared by most rows is one row."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))


def order_statistic(df: DataFrame, keys: list[str], value: str, alpha: float, name: str = "q",
                    rows_per_bucket: int | None = None) -> DataFrame:
    """The conformal quantile of ``value`` in each key group: columns keys, ``n``, ``k`` and ``name``."""
    keys = list(keys)
    counted = _counted(df, keys, value)
    targets = Targets(F.array(F.struct(F.lit(float(alpha)).alias("alpha"))), conformal_rank(F.col("n"), alpha))
    splits = find_splits(df, keys, [value], rows_per_bucket)
    got = take_at(counted, keys, [value], targets, {}, weight="__c", splits=splits)
    return got.select(*keys, "n", "k", F.col(value).alias(name))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
              rows_per_bucket: int | None = None, dealt: DataFrame | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: columns keys, ``n``, ``prob``, ``value``.

    Sorting spills to disk and large groups are split, so a group of any size works; ``percentile`` would
    hold it in one buffer. ``dealt`` are the same rows dealt by some of the keys, which saves the later shuffles.
    """
    keys = list(keys)
    counted = _counted(df if dealt is None else dealt, keys, value)
    place = lambda p: (F.col("n") - 1) * p
    both = Targets(
        F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side")) for p in probs for side in (0, 1)]),
        F.least(F.floor(place(F.col("prob"))) + 1 + F.col("side"), F.col("n")))
    splits = find_splits(df, keys, [value], rows_per_bucket)
    got = take_at(counted, keys, [value], both, {}, weight="__c", splits=splits)
    ends = got.groupBy(*keys, "prob").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("side") == 0, F.col(value))).alias("__lo"),
        F.max(F.when(F.col("side") == 1, F.col(value))).alias("__hi"))
    frac = place(F.col("prob")) - F.floor(place(F.col("prob")))
    # Shares of both ends: their difference would lose digits, and a median of decimals could miss the half it is rounded at.
    between = F.when((frac == 0) | (F.col("__lo") == F.col("__hi")), F.col("__lo")).otherwise(F.col("__lo") * (1 - frac) + F.col("__hi") * frac)
    return ends.select(*keys, "n", "prob", between.alias("value"))


def medians(df: DataFrame, keys: list[str], value: str, name: str, dealt: DataFrame | None = None) -> DataFrame:
    return quantiles(df, keys, value, [0.5], dealt=dealt).select(*keys, F.col("value").alias(name))
