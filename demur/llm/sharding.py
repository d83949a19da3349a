r"""Sharding by proportional stratified interleaving: every shard is a small copy of the mixture of sources.

Rows are shuffled inside their source by a seeded digest, so the row with rank r of n has the fractional rank (r + phase) / n. ``phase`` is a
draw of the source in [0, 1): sources of a few rows then lie anywhere and not all in the middle. All rows are sorted by the fractional
rank and cut into shards whose counts differ by one at most; ``slot`` counts inside the shard from 0. A shard holds the share of every source that the whole
table has, give or take two rows; the roundings of many small sources, each by its own phase, can add up to about the root of their number in a large one.

No task ranks a whole source: the digest's leading bits deal a source into buckets, bucket counts are summed up first, and only rows of one bucket are
ordered against each other; the fractional ranks, which are even by construction, are dealt the same way. A source with a third of all rows
takes as many buckets as the others. The deal is of rows: equal texts go where their own ranks send them, as shards of equal counts have no room for a group larger than one.

Rows: null sources are one source, which comes first; null ids and texts are values like any other; rows that are alike in source and identity are interchangeable and take
neighbouring ranks; more shards than rows leave some without rows; an empty table gives no rows; extra columns are kept, also under the names
of the results, which come last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from demur.sources.staging import stage

SEED = 17
#: Rows that one bucket holds at the most wanted, and the fewest buckets; ranks are the same for any number.
PER_BUCKET, LEAST_BITS, MOST_BITS = 1 << 20, 8, 44
DRAW_BITS = 52


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))


def _draw(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def _with_starts(rows: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """``rows`` with ``start``, the rows of the group in earlier buckets, and ``inside``, those of the group; only counts pass through the windows."""
    whole = Window.partitionBy(*group)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("n")).select(
        *group, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("inside"))
    return rows.join(starts, [*group, bucket])


def interleave(docs: DataFrame, shards: int, source: str = "source", identity: tuple[str, ...] = ("doc_id",), seed: int = SEED,
               per_bucket: int = PER_BUCKET) -> DataFrame:
    """All columns of ``docs``, then shard (0 to ``shards`` - 1) and slot.

    ``identity`` names the columns whose values are shuffled by; they should tell most rows apart, as rows alike in all of them share a bucket. ``docs`` is
    read three times, so it should be a table.
    """
    names = docs.columns
    inside = [f"kept {i}" for i in range(len(names))]
    rows = docs.toDF(*inside)
    of = F.col(inside[names.index(source)]).cast("string")
    digest = _digest(F.lit(seed), *[F.col(inside[names.index(c)]) for c in identity])
    total = docs.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, total / per_bucket)))))
    # Null sorts before every text, so that plain keys serve for joins, windows and order.
    told = rows.select("*", F.coalesce(F.concat(F.lit("="), of), F.lit("-")).alias("of"), digest.alias("digest"))
    told = told.withColumn("bucket", F.shiftright(_draw(F.col("digest")), DRAW_BITS - bits))
    rank = F.row_number().over(Window.partitionBy("of", "bucket").orderBy("digest")) - 1 + F.col("start")
    phase = _draw(_digest(F.lit(seed), F.col("of"))) / F.lit(2.0 ** DRAW_BITS)
    ranked = _with_starts(told, ["of"], "bucket").select(*inside, "of", "digest", ((rank + phase) / F.col("inside")).alias("at"))
    ranked = stage(ranked, "ranked")
    wide = 1 << bits
    cut = ranked.withColumn("bucket", F.least(F.floor(F.col("at") * wide), F.lit(wide - 1)))
    order = Window.partitionBy("bucket").orderBy("at", "of", "digest")
    placed = _with_starts(cut, [], "bucket").withColumn("place", F.row_number().over(order) - 1 + F.col("start"))
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.expr(f"place - (shard * {total} + {shards - 1}) div {shards}"))
    return placed.select(*[F.col(f"`{i}`").alias(n) for i, n in zip(inside, names)], F.col("shard").cast("int").alias("shard"), "slot")


def write_shards(placed: DataFrame, folder: str, files_per_shard: int = 1) -> None:
    """One folder ``shard=N`` per shard with rows in slot order; ``files_per_shard`` cuts each into runs of slots."""
    shards = placed.agg(F.max("shard")).first()[0]
    if shards is None:
        placed.write.mode("errorifexists").parquet(folder)
        return
    (placed.repartitionByRange((shards + 1) * files_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("errorifexists").partitionBy("shard").parquet(folder))
