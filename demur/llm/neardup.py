"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes), a digest of the set and a signature of minima.
   Texts with equal sets are one class, whatever the size of the class; only one document of a class goes on.
2. Forest: ``TREES`` orders of the classes, each by its own run of ``DEPTH`` minima. In each order, neighbours
   that share at least the first ``SHALLOW`` minima form a region. A region of at most ``REGION`` classes is compared as it is; a larger
   one is compared in steps of ``REGION`` neighbours that overlap by half, and cut one minimum deeper, until it is small enough or the run
   is used up. A comparison estimates the similarity from a byte of every minimum and keeps, of the pairs within reach of the threshold, a spanning forest: as many links as classes, never all pairs.
3. The links' connected components hold all true links inside them. The full sets of a component's classes are brought together
   and compared exactly. A component beyond ``BLOCK`` classes is dealt into blocks (see ``confirm``), and no task holds more than
   two blocks.
4. Connected components of the exact links, with the copies of every class, give each document its group.

Nothing is capped or dropped: a link is missed only if the two signatures agree on no tree's run (under 1 in 100,000 at the threshold for 0.85).

Rows: a null or empty text, and one without words, has an empty set and is a group of its own; a text with fewer words than a shingle is
one shingle; repeated ids share a group (their sets count as one document each, the group id is the id); null ids get no group
and are left out (the pipeline gives such rows keys first, see ``common.keyed``); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demur.sources.staging import stage

from .common import small_batches
from .components import components

TREES, DEPTH, SHALLOW = 16, 8, 4
REGION, BLOCK = 64, 256
#: How far below the threshold an estimate from the signature may lie: four standard deviations of 128 minima.
REACH = 0.13
CHUNK_BYTES = 2_000_000

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_FACTORS = _mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | _U(1)
_POWERS = [np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)]


def _powers(n: int) -> np.ndarray:
    if n > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    return _POWERS[0]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in concatenated texts, and the number of words before each text.

    ``data`` are the bytes, ``starts`` where each text begins, with the end last. A word ends at a separator or with its text.
    """
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = starts[:-1][starts[:-1] < np.append(starts[1:], 0)[:len(starts) - 1]]
    first[begins] = inside[begins]
    at = np.flatnonzero(first)
    before = np.searchsorted(at, starts)
    if not len(at):
        return np.zeros(0, np.uint64), before
    number = np.cumsum(first) - 1
    place = np.arange(len(data)) - at[np.maximum(number, 0)]
    place[~inside] = 0
    value = (_LOWER[data] + _U(1)) * _powers(int(place.max()) + 1)[place]
    value[~inside] = 0
    sums = np.add.reduceat(value, at)
    return _mix(sums), before


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, before = word_hashes(data, starts)
    n = len(words)
    sums = np.zeros(n, np.uint64)
    for j in range(k):
        sums[:n - j] += _mix(words[j:] + _U(j))
    grams = _mix(sums)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            whole = sum(int(_mix(words[a + j:a + j + 1] + _U(j))[0]) for j in range(b - a)) + (b - a)
            out.append(_mix(np.array([whole & (2 ** 64 - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set that is not empty, as 32-bit numbers."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i:i + 2048]
        np.minimum(low, (part[None, :] * _FACTORS[:, None]).min(1), out=low)
    return (low >> _U(32)).astype("<u4")


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column of about CHUNK_BYTES: first row, row after the last, bytes, starts."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (16 bytes), signature and a byte of each minimum, of every document with an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts in _texts(batch.column(1)):
                sizes, digests, signatures, briefs = [], [], [], []
                for s in shingle_sets(data, starts, k):
                    sizes.append(len(s))
                    digests.append(np.array([_mix(s).sum(), _mix(s ^ _U(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes())
                    low = signature(s) if len(s) else None
                    signatures.append(low if low is None else low.astype(">u4").tobytes())
                    briefs.append(low if low is None else (low & 255).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(briefs, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sig", "brief"])

    small_batches(docs.sparkSession)
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, sig binary, brief binary")


class _Sets:
    """Union-find over a few numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _spanning(ids: np.ndarray, signatures: np.ndarray, floor: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs whose signatures agree in at least the share ``floor``."""
    groups, out = _Sets(len(ids)), []
    for a in range(len(ids) - 1):
        near = (signatures[a + 1:] == signatures[a]).mean(1) >= floor
        for b in (np.flatnonzero(near) + a + 1).tolist():
            if groups.join(a, b):
                out.append((int(ids[a]), int(ids[b])))
    return out


def _region_links(ids: np.ndarray, runs: np.ndarray, briefs: np.ndarray, depth: int, floor: float) -> list[tuple[int, int]]:
    """Links within one region, sorted by its run of minima and equal in the first ``depth`` of it."""
    if len(ids) < 2:
        return []
    if len(ids) <= REGION:
        return _spanning(ids, briefs, floor)
    # Neighbours across the deeper cuts, then each part by itself.
    links = [x for i in range(0, len(ids), REGION // 2) for x in _spanning(ids[i:i + REGION], briefs[i:i + REGION], floor)]
    if depth < DEPTH:
        cuts = np.flatnonzero(runs[1:, depth] != runs[:-1, depth]) + 1
        for part in np.split(np.arange(len(ids)), cuts):
            if len(part) < len(ids):
                links += _region_links(ids[part], runs[part], briefs[part], depth + 1, floor)
    return links


def forest_links(classes: DataFrame, floor: float) -> DataFrame:
    """Candidate links (a, b) between ``classes`` (doc_id, sig, brief).

    Rows go on only where another class shares the shallow run of their tree. They are dealt by ranges of (tree, run, brief, id), so a
    region of any size spreads over tasks; where a border cuts a region, other trees join its sides.
    """
    width = 4 * DEPTH
    regions = classes.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("sig", width * t + 1, 4 * SHALLOW)).alias("region"))
        for t in range(TREES)])).alias("r")).select("doc_id", "r.*")
    crowded = regions.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("region")
    rows = stage(regions.join(crowded, "region").select("doc_id", "tree").join(classes, "doc_id").select(
        "tree", F.expr(f"substring(sig, {width} * tree + 1, {width})").alias("run"), "brief", "doc_id"), "regions")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", "run", "brief", "doc_id"]
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ids, trees = batch.column(3).to_numpy(), batch.column(0).to_numpy()
            runs = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH)
            briefs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
            if held is not None:
                ids, trees, runs, briefs = (np.concatenate(x) for x in zip(held, (ids, trees, runs, briefs)))
            new = np.flatnonzero((trees[1:] != trees[:-1]) | (runs[1:, :SHALLOW] != runs[:-1, :SHALLOW]).any(1)) + 1
            # The last region may go on in the next batch; of a very large one only the last neighbours are held.
            last = max(int(new[-1]) if len(new) else 0, len(ids) - HELD)
            for part in np.split(np.arange(len(ids)), new):
                yield _as_batch(_region_links(ids[part], runs[part], briefs[part], SHALLOW, floor))
            held = (ids[last:], trees[last:], runs[last:], briefs[last:])

    return ordered.mapInArrow(scan, "a long, b long").distinct()


#: Neighbours that meet the first of the next batch; a region above it overlaps its next part by so many.
HELD = 8192


def _as_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def exact_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, outside: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs whose sets have 100 * intersection >= percent * union.

    Only shingles of two sets or more can be in an intersection; products of their incidence matrix, a block of shingles at a time,
    count them. With ``outside``, only pairs with an outside member count.
    """
    n, sizes = len(ids), np.array([len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    column = np.cumsum(times > 1) - 1
    wanted = times[at] > 1
    owner, at = owner[wanted], column[at[wanted]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    shared = np.zeros((n, n), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, SHINGLE_BLOCK):
        a, b = np.searchsorted(at, [first, first + SHINGLE_BLOCK])
        used = np.zeros((n, int(min(SHINGLE_BLOCK, at[-1] + 1 - first))), np.float32)
        used[owner[a:b], at[a:b] - first] = 1
        shared += used @ used.T
    near = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    if outside is not None:
        near &= outside[:, None] | outside[None, :]
    groups, out = _Sets(n), []
    for a, b in np.argwhere(np.triu(near, 1)).tolist():
        if groups.join(a, b):
            out.append((int(ids[a]), int(ids[b])))
    return out


SHINGLE_BLOCK = 4096


def _compared(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Exact links within every group of ``rows`` (keys, doc_id, shingles, outside)."""
    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        if len(ids) < 2:
            return pa.Table.from_batches([_as_batch([])])
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        outside = np.array(group.column("outside").to_pylist(), object)
        mask = None if outside[0] is None else outside.astype(bool)
        return pa.Table.from_batches([_as_batch(exact_links(ids, sets, percent, mask))])

    return rows.groupBy(*keys).applyInArrow(compare, "a long, b long")


def confirm(docs: DataFrame, candidates: DataFrame, k: int, percent: int) -> DataFrame:
    """Exact links (a, b), spanning every group of linked classes, from candidate components (node, component).

    A component of up to BLOCK classes is one group. A larger one is dealt into blocks by hash; some of its classes, the anchors, join
    every block, so that what is one group in the component is mostly one after this. The classes outside the largest group so found then
    meet every block, chunk by chunk: pairs inside a group need no more comparing, and no other pair is left out.
    """
    candidates = stage(candidates, "candidates")
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    # Small components, nearly all, have one block.
    dealt = candidates.join(sizes, "component").select(
        F.col("node").alias("doc_id"), "component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"),
        F.when(F.col("size") > BLOCK, F.pmod(draw, F.ceil(F.col("size") / BLOCK)).cast("int")).otherwise(0).alias("block"),
        ((F.col("size") > BLOCK) & (F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) * F.col("size") < ANCHORS * float(1 << 30))).alias("anchor"))
    dealt = stage(dealt, "dealt")
    few = dealt.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, starts in _texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(data, starts, k)], pa.binary())],
                                                 names=["doc_id", "shingles"])

    wanted = dealt.select("doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(run, "doc_id long, shingles binary").join(F.broadcast(dealt) if few else dealt, "doc_id")
    many = dealt.where("blocks > 1").limit(1).count() > 0
    if many:
        sets = stage(sets, "sets")
    everywhere = F.when(F.col("anchor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = _compared(sets.select("component", F.explode(everywhere).alias("at"), "doc_id", "shingles", F.lit(None).cast("boolean").alias("outside")),
                      ["component", "at"], percent)
    if not many:
        return first
    first = stage(first, "links")
    large = dealt.where("blocks > 1").select("doc_id", "component", "blocks")
    found = large.join(components(first).select(F.col("node").alias("doc_id"), F.col("component").alias("found")), "doc_id", "left").select(
        "doc_id", "component", F.coalesce("found", "doc_id").alias("found"))
    main = found.groupBy("component", "found").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("found", F.struct("n", "found")).alias("main"))
    outer = found.join(main, "component").where("found <> main").select("doc_id", "component")
    chunks = outer.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    outer = outer.join(chunks, "component").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(2)), "chunks").cast("int").alias("chunk"))
    blocks = sets.where("blocks > 1").join(chunks, "component").join(outer, "doc_id", "left")
    inside = blocks.select("component", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc_id", "shingles",
                           F.lit(False).alias("outside"))
    meeting = blocks.where("chunk IS NOT NULL").select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk",
                                                       "doc_id", "shingles", F.lit(True).alias("outside"))
    return first.union(_compared(inside.union(meeting), ["component", "block", "chunk"], percent))


ANCHORS = 32
#: Class ids that may be broadcast, 24 bytes each.
BROADCAST_ROWS = 1_000_000


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: n_shingles, component_id (smallest id of its group) and whether it is the one kept."""
    docs = docs.select("doc_id", "text")
    sketched = stage(sketch(docs, k), "sketch")
    full = sketched.where(F.col("n_shingles") > 0)
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "sig", "brief")).alias("c")).select("digest", "c.*")
    classes = stage(classes, "classes")
    links = forest_links(classes.select("doc_id", "sig", "brief"), percent / 100 - REACH)
    groups = components(confirm(docs, components(links), k, percent))
    named = classes.select("digest", F.col("doc_id").alias("node")).join(groups, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    whole = full.select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component")
    empty = sketched.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return whole.union(empty).select("doc_id", "n_shingles", F.col("component").alias("component_id"),
                                     (F.col("doc_id") == F.col("component")).alias("kept"))
