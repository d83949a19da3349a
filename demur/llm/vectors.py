"""Nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and split in two halves; each half has its own centroids, fitted on a bounded sample. A vector lies in the cell of
its two nearest centroids. A query walks through pairs of centroids in order of the summed distances of its halves, with a heap, until the cells
it has met hold a share of all entries (``CANDIDATES`` at least), and its candidates are ranked again by the exact cosine on the
original vectors. The share is learned with the centroids: so much as sampled queries need to meet ``RECALL`` of their nearest in the sample; it is near a third for
vectors without any clusters and a few hundredths for clustered ones.

Cells of one first centroid lie together: a query sends itself once to each first centroid it visits, with the second centroids it wants as bits, and all
queries of a group are ranked in one matrix product.

Copies: equal vectors are one entry that lists the ``k`` + 1 smallest ids; no other copy can be among the nearest, as ties go to smaller
ids. Equal queries are searched once. So a vector that a third of all rows hold costs as much as any other. The cells of a first centroid
are dealt into chunks of about ``CHUNK`` entries and its queries into as large ones, and every query chunk meets every chunk.

Rows: a vector that is null, all zero, or holds a null or non-finite component, or has another length than most, takes no part, neither as query nor
as candidate; a null id takes no part; rows repeated with one id count once; ties go to the smaller id; fewer candidates than k are all returned; an empty table,
or one without queries, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from demur.sources.staging import stage

SAMPLE = 20_000
CANDIDATES, RECALL, SAMPLE_QUERIES = 2000, 0.97, 300
LEAST_CENTROIDS, MOST_CENTROIDS, CELL_ENTRIES = 4, 1024, 12
CHUNK = 4096
#: Cosines that one step of a group holds.
RANKED_AT_ONCE = 4_000_000
ROUNDS = 12


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct rows drawn at random; an empty cluster keeps its place."""
    draw = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[draw.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i:i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def cells_in_order(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of positions by rising sum of two distance arrays.

    The heap holds the next pair of every row met so far; a row is met when the first pair of the row before it is taken.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    rows, columns, da, db = a.tolist(), b.tolist(), first[a].tolist(), second[b].tolist()
    heap, wide = [(da[0] + db[0], 0, 0)], len(db)
    while heap:
        _, i, j = heap[0]
        yield rows[i], columns[j]
        if j + 1 < wide:
            heapq.heapreplace(heap, (da[i] + db[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (float) of the rows that take part."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & v.isNotNull())
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    usual = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.where(F.size("embedding") == (usual[0]["size"] if usual else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(float)


def _smallest(df: DataFrame, group: list[str], order: list[Column | str], n: int, name: str = "place") -> DataFrame:
    from pyspark.sql import Window
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def share_needed(x: np.ndarray, first: np.ndarray, second: np.ndarray, k: int, recall: float = RECALL) -> float:
    """Share of the entries ``x`` (of length one) that lie in cells up to the one of a nearest neighbour, for ``recall`` of the k nearest of sampled queries."""
    half = x.shape[1] // 2
    a, b = nearest(x[:, :half], first), nearest(x[:, half:], second)
    shares = [0.0]
    for i in range(0, len(x), max(1, len(x) // SAMPLE_QUERIES)):
        near = x @ x[i]
        near[i] = -2.0
        best = np.argpartition(-near, min(k, len(x) - 1))[:k]
        sums = distances(x[i:i + 1, :half], first)[0][a] + distances(x[i:i + 1, half:], second)[0][b]
        shares += np.searchsorted(np.sort(sums), sums[best[best != i]], "right").tolist()
    return float(np.quantile(shares, recall)) / max(1, len(x))


def search(vectors: DataFrame, is_query: Column, k: int, share: float | None = None, least: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: of every row of ``vectors`` (vec_id, embedding) where ``is_query``, its k nearest others; ``share`` overrides the learned one."""
    spark = vectors.sparkSession
    rows = _usable(vectors)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1)) if len(batch) else np.zeros((0, 1))
            keys = [hashlib.blake2b((r + 0.0).tobytes(), digest_size=16).digest() for r in m]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0), batch.column(1), batch.column(2)],
                                             names=["copy_of", "vec_id", "embedding", "asks"])

    named = stage(rows.select("vec_id", "embedding", is_query.alias("asks")).mapInArrow(
        name, "copy_of binary, vec_id long, embedding array<double>, asks boolean"), "vectors")
    # The smallest ids of every set of copies, in two steps so that a large set is ranked by many tasks first.
    ids = named.select("copy_of", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("deal")).distinct()
    ids = _smallest(_smallest(ids, ["copy_of", "deal"], ["vec_id"], k + 1), ["copy_of"], ["vec_id"], k + 1)
    ids = stage(ids.select("copy_of", "vec_id", "place"), "ids")
    entries = stage(named.select("copy_of", "vec_id", "embedding").join(
        ids.where("place = 1").select("copy_of", "vec_id"), ["copy_of", "vec_id"]).dropDuplicates(["copy_of"]).select("copy_of", "embedding"), "entries")
    n = entries.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    sample = entries.orderBy(F.xxhash64("copy_of"), "copy_of").limit(SAMPLE).select("embedding").toArrow()
    x = _matrix(sample.column(0).combine_chunks())
    x /= np.linalg.norm(x, axis=1)[:, None]
    half = x.shape[1] // 2
    size = int(np.clip(round(np.sqrt(n / CELL_ENTRIES)), LEAST_CENTROIDS, MOST_CENTROIDS))
    fitted = kmeans(x[:, :half], size), kmeans(x[:, half:], size)
    share = share_needed(x, *fitted, k) if share is None else share
    books = spark.sparkContext.broadcast(fitted)

    wide_x = x.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        for batch in batches:
            m = _matrix(batch.column(1)) if len(batch) else np.zeros((0, wide_x))
            m = m / np.linalg.norm(m, axis=1)[:, None]
            cell = nearest(m[:, :half], first) * len(second) + nearest(m[:, half:], second)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64())], names=["copy_of", "embedding", "cell"])

    index = stage(entries.mapInArrow(place, "copy_of binary, embedding array<double>, cell long"), "index")
    counts = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most MOST_CENTROIDS squared rows
    held = spark.sparkContext.broadcast(dict(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist())))
    wide = len(books.value[1])
    chunks: dict[int, int] = {}
    for cell, inside in held.value.items():
        chunks[cell // wide] = chunks.get(cell // wide, 0) + inside
    chunks = {first: -(-inside // CHUNK) for first, inside in chunks.items()}
    asked = named.where("asks").select("copy_of", F.col("vec_id").alias("query_id")).distinct()
    asking = entries.join(asked.select("copy_of").distinct(), "copy_of", "left_semi")
    goal = max(least, share * n)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, second), inside_of = books.value, held.value.get
        for batch in batches:
            m = _matrix(batch.column(1)) if len(batch) else np.zeros((0, wide_x))
            u = m / np.linalg.norm(m, axis=1)[:, None]
            d1, d2 = distances(u[:, :half], first), distances(u[:, half:], second)
            visits = []
            for i in range(len(batch)):
                wanted, met = np.zeros((len(first), wide), bool), 0
                for a, b in cells_in_order(d1[i], d2[i]):
                    inside = inside_of(a * wide + b, 0)
                    if inside:
                        wanted[a, b] = True
                        met += inside
                        if met >= goal:
                            break
                visits.append([{"first": int(a), "seconds": np.packbits(wanted[a]).tobytes()} for a in np.flatnonzero(wanted.any(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(visits, pa.list_(pa.struct([("first", pa.int64()), ("seconds", pa.binary())])))],
                                             names=["asker", "wanted", "visits"])

    walked = stage(asking.mapInArrow(walk, "asker binary, wanted array<double>, visits array<struct<first:bigint,seconds:binary>>"), "walked")
    visitors = {r["first"]: r["n"] for r in walked.select(F.explode("visits.first").alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = F.broadcast(spark.createDataFrame([(a, c, -(-visitors.get(a, 1) // CHUNK)) for a, c in chunks.items()], "first long, chunks int, deals int"))
    to_each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    dealt = index.withColumn("first", F.expr(f"cell div {wide}")).join(groups, "first").select(
        "first", F.pmod(F.xxhash64("copy_of"), "chunks").cast("int").alias("chunk"), to_each("deals").alias("deal"),
        (F.col("cell") % wide).cast("int").alias("second"), "copy_of", "embedding")
    probes = walked.select("asker", "wanted", F.inline("visits")).join(groups, "first").select(
        "first", to_each("chunks").alias("chunk"), F.pmod(F.xxhash64("asker"), "deals").cast("int").alias("deal"), "asker", "wanted", "seconds")

    def rank(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not len(asked) or not len(there):
            return _found([], [], [])
        v, q = (_matrix(t.column(c).combine_chunks()) for t, c in ((there, "embedding"), (asked, "wanted")))
        lengths, second = np.linalg.norm(v, axis=1), there.column("second").to_numpy()
        bits = np.frombuffer(b"".join(asked.column("seconds").to_pylist()), np.uint8).reshape(len(q), -1)
        at, scores = [], []
        step = max(1, RANKED_AT_ONCE // len(v))
        for i in range(0, len(q), step):
            some = q[i:i + step]
            cosine = some @ v.T / (np.linalg.norm(some, axis=1)[:, None] * lengths)
            cosine[np.unpackbits(bits[i:i + step], axis=1)[:, second] == 0] = -np.inf
            # All entries as near as the last wanted one stay, so that ties are settled by id later.
            last = np.partition(cosine, max(0, len(v) - k - 1), axis=1)[:, max(0, len(v) - k - 1)]
            near = np.argwhere((cosine >= last[:, None]) & (cosine > -np.inf))
            at.append(near + [i, 0])
            scores.append(cosine[near[:, 0], near[:, 1]])
        at = np.concatenate(at)
        pick = lambda column, rows: column.combine_chunks().take(pa.array(rows))
        return _found(pick(asked.column("asker"), at[:, 0]), pick(there.column("copy_of"), at[:, 1]), np.concatenate(scores))

    keys = ["first", "chunk", "deal"]
    found = probes.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(rank, "asker binary, copy_of binary, score double")
    # Every entry stands for its smallest ids; one more than wanted are kept, as one may be the asking row itself.
    spread = found.join(ids.select("copy_of", "vec_id"), "copy_of")
    best = _smallest(spread, ["asker"], [F.desc("score"), "vec_id"], k + 1, "near").select(F.col("asker").alias("copy_of"), "vec_id", "score")
    answers = asked.join(best, "copy_of").where(F.col("vec_id") != F.col("query_id"))
    return _smallest(answers, ["query_id"], [F.desc("score"), "vec_id"], k, "rank").select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _found(askers, entries, scores) -> pa.Table:
    return pa.table({"asker": pa.array(askers, pa.binary()), "copy_of": pa.array(entries, pa.binary()), "score": pa.array(scores, pa.float64())})
