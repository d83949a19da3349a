"""Helpers shared by the text operators: inputs, hash splits and bounded training samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from demur.sources.staging import stage

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
HOLD_OUT = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; other scripts keep their case."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's digits divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 0


def sample_per_class(df: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label, those with the smallest hashes of ``key``.

    A first pass counts the labels; rows far beyond the wanted share go before anything is shuffled, so that
    the ranking sees about twice the sample for every label whatever the size of the table.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_rows"))
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    near = (df.withColumn("draw", draw).join(F.broadcast(counts), label)
            .where(F.col("draw") * F.col("class_rows") <= 2.0 * per_class + 50)
            .select(key, label, "draw"))
    ranked = near.selectExpr("*", f"row_number() OVER (PARTITION BY {label} ORDER BY draw, {key}) AS place")
    return ranked.where(F.col("place") <= per_class).select(key, label)


#: Rows of texts that travel to Python at once.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long: lowers the session's rows per Arrow batch to TEXT_ROWS where it is larger, which bounds the memory of a task."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting, "10000")) <= TEXT_ROWS:
        spark.conf.set(setting, str(TEXT_ROWS))


_held: dict[str, object] = {}


def held(key: str, build):
    """What a worker keeps between its tasks: one thing at a time, of the operator that ran last."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def map_text(df: DataFrame, keep: list[str], run, results: str) -> DataFrame:
    """``keep`` columns of ``df`` beside what ``run`` makes of each array of texts: columns by the names and types of ``results``.

    Columns travel by position, so that a kept column may have the name of a result; it then stands first. The text travels once.
    """
    small_batches(df.sparkSession)
    inside = [f"kept {i}" for i in range(len(keep))]
    read = keep.index("text") if "text" in keep else len(keep)
    extra = [] if "text" in keep else [F.col("text").alias("text to read")]
    passed = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inside)], *extra)
    made = [r.strip().split(" ") for r in results.split(",")]

    def whole(batches):
        import pyarrow as pa
        for batch in batches:
            columns = [batch.column(i) for i in range(len(inside))] + run(batch.column(read))
            yield pa.RecordBatch.from_arrays(columns, names=inside + [f"made {n}" for n, _ in made])
        pa.default_memory_pool().release_unused()

    schema = ", ".join([f"`{i}` {f.dataType.simpleString()}" for i, f in zip(inside, passed.schema)] + [f"`made {n}` {t}" for n, t in made])
    out = passed.mapInArrow(whole, schema)
    return out.select(*[F.col(f"`{i}`").alias(c) for c, i in zip(keep, inside)], *[F.col(f"`made {n}`").alias(n) for n, _ in made])


#: Ids that may be broadcast to drop their rows, 8 bytes each.
BROADCAST_IDS = 2_000_000


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` and ``lone_row``: numbers from 1 for the rows with a null doc_id, and 0 for all others.

    The rows without an id are written with their numbers, so that every read sees the same; counts of their parts, a row each, go through the driver.
    """
    lone = stage(docs.where(F.col("doc_id").isNull()).withColumn("lone_row", F.monotonically_increasing_id()), "lone")
    part = F.shiftright("lone_row", 33)
    counts = lone.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    if not counts:
        return docs.withColumn("lone_row", F.lit(0).cast("long"))
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(offsets, "part long, start long"))
    numbered = lone.join(starts, part == F.col("part")).withColumn("lone_row", F.col("start") + F.col("lone_row") % (1 << 33) + 1)
    return docs.where(F.col("doc_id").isNotNull()).withColumn("lone_row", F.lit(0).cast("long")).unionByName(numbered.drop("part", "start"))


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` and ``key``: the doc_id, or for each row without one a number that is no doc_id, above all of them where there is room."""
    told = told_apart(docs)
    span = told.agg(F.max("doc_id").alias("last"), F.max("lone_row").alias("n")).first()
    base, n = span["last"] or 0, span["n"] or 0
    draw = random.Random(n)
    while base + n >= 1 << 63 or n and docs.where(F.col("doc_id").between(base + 1, base + n)).limit(1).count():
        base = draw.randrange(-(1 << 63), (1 << 63) - n - 1)
    return told.withColumn(key, F.coalesce("doc_id", F.lit(base) + F.col("lone_row"))).drop("lone_row")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows of ``ids``; rows with a null key stay. ``ids`` is a written table; it is broadcast where its count allows."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, "left_anti")
