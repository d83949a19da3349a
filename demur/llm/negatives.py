"""Hard-negative mining by rotated one-bit codes with intervals that are never wrong.

Vectors become integers (floor of ``scale`` times the component) and are turned by one random rotation. A code is the signs of a turned vector, and its stored
alignment is how far the vector goes along the code; what a code leaves over is coded again, with half the step, ``LAYERS`` times. With v = v' + r and q = q' + t, v' and q'
being what the codes hold, the product of v' and q' follows from popcounts of differing bits and the alignments, and by Cauchy-Schwarz
the true product lies within |r| |q| + |v'| |t| of it. Intervals alone decide who is out: a row is left if its interval misses the wanted range, or if k rows
are known to be at least as good as its upper end. All that survive are scored with integers, so results are exact for any codes.

First every anchor gets its positives, the nearest rows of its own label; then every (anchor, positive) its negatives, the nearest rows of other
labels inside the range that the positive's score allows. Anchors are a stated set of queries against all rows: both are dealt into groups of bounded size, every pair of
groups is one task that returns the first few of each anchor, and these are ranked again over all groups. Groups are dealt by hashes of ids, so labels and copies of any
frequency spread evenly; equal vectors are rows of their own.

Rows: a row with a null id, label or vector, an empty vector, a null or non-finite component (also once scaled), or another length than most vectors takes no part; rows
repeated with one id count once, as the one with the smallest label, then vector; ties go to smaller ids; scores beyond 64 bits count as the nearest
64-bit number; an anchor alone in its label has no rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from demur.sources.staging import stage

LAYERS = 5
ROW_GROUP, ANCHOR_GROUP = 8192, 4096
#: Rows scored with integers early, to learn how good the wanted ones are.
PROBES = 48
ENDS = (1 - (1 << 63), (1 << 63) - 1)


def rotation(size: int, seed: int = 11) -> np.ndarray:
    """A random rotation of the components, filled up with zeros to whole 64-bit words."""
    wide = -(-size // 64) * 64
    turned, upper = np.linalg.qr(np.random.default_rng(seed).normal(size=(wide, wide)))
    return (turned * np.sign(np.diag(upper)))[:size]


def encode(x: np.ndarray, turn: np.ndarray, layers: int = LAYERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits (rows, layers, bytes), alignments (rows, layers), and the lengths of what the codes hold and of what they leave."""
    whole = x @ turn
    rest, step, signs = whole, np.abs(whole).max(1)[:, None] / 2, []
    for _ in range(layers):
        signs.append(np.where(rest >= 0, 1.0, -1.0))
        rest, step = rest - step * signs[-1], step / 2
    codes = np.stack(signs, 1)
    # The alignments with all codes at once; whatever they are, what is left over is exact. Codes of short vectors may coincide, hence the small diagonal.
    gram = codes @ codes.transpose(0, 2, 1) + 1e-9 * whole.shape[1] * np.eye(layers)
    along = np.linalg.solve(gram, codes @ whole[:, :, None])[:, :, 0]
    held = np.einsum("ni,nid->nd", along, codes)
    return np.packbits(codes > 0, axis=2), along, np.linalg.norm(held, axis=1), np.linalg.norm(whole - held, axis=1)


class Rows:
    """Vectors of one group with their codes, ordered by label, then id."""

    def __init__(self, t: pa.Table):
        ids, labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
        order = np.lexsort((ids, labels))
        binary = lambda name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(len(ids), -1)[order]
        self.ids, self.labels = ids[order], labels[order]
        self.x, self.along, bits = binary("whole", "<f8"), binary("along", "<f8"), binary("bits", "<u8")
        layers = self.along.shape[1]
        self.words = bits.shape[1] // layers
        self.bits = [np.ascontiguousarray(bits[:, i * self.words:(i + 1) * self.words]) for i in range(layers)]
        self.held, self.rest = t.column("held").to_numpy()[order], t.column("rest").to_numpy()[order]
        self.order = order
        largest = np.abs(self.x).max(1)
        self.largest = float(largest.max())
        unit = np.maximum(largest, 1.0)
        self.length = unit * np.linalg.norm(self.x / unit[:, None], axis=1)

    def span(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def intervals(self, at: slice, of: "Rows", i: int) -> tuple[np.ndarray, np.ndarray]:
        """Middles and half widths of intervals that hold the products of the rows ``at`` with row ``i`` of ``of``."""
        wide, total = 64 * self.words, np.zeros(at.stop - at.start)
        for layer, mine in enumerate(self.bits):
            differing = np.zeros(at.stop - at.start)
            for other, b in zip(of.bits, of.along[i]):
                bits = np.bitwise_count(mine[at] ^ other[i])
                differing += b * (bits[:, 0] if self.words == 1 else bits.sum(1))
            total += self.along[at, layer] * (wide * of.along[i].sum() - 2 * differing)
        half = self.rest[at] * of.length[i] + self.held[at] * of.rest[i]
        return total, half + 1e-9 * self.length[at] * of.length[i] + 1e-6  # the end covers rounding

    def products(self, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Exact integer products: in doubles where no sum can leave their exact range, else in whole numbers."""
        if len(one) * self.largest * max(1.0, float(np.abs(one).max())) < 2.0 ** 53:
            return (self.x[at] @ one).astype(np.int64)
        whole = [int(v) for v in one]
        return np.array([min(max(sum(int(a) * b for a, b in zip(self.x[j], whole)), ENDS[0]), ENDS[1]) for j in at], np.int64)


class Candidates:
    """The rows ``at`` for the vector ``one``, ordered by the middles of their intervals."""

    def __init__(self, rows: Rows, at: np.ndarray, middle: np.ndarray, half: np.ndarray, one: np.ndarray):
        order = np.argsort(middle)
        self.rows, self.one, self.at, self.middle, self.half = rows, one, at[order], middle[order], half[order]
        self.widest = self.half.max() if len(half) else 0.0
        self.sure = bool(len(half) and np.isfinite(middle[order[-1]]) and np.isfinite(middle[order[0]]) and np.isfinite(self.widest))
        self.scores, self.scored = np.zeros(len(at), np.int64), np.zeros(len(at), bool)

    def products(self, places: np.ndarray) -> np.ndarray:
        """Exact products of the candidates at ``places``, each computed once."""
        new = places[~self.scored[places]]
        self.scores[new], self.scored[new] = self.rows.products(self.at[new], self.one), True
        return self.scores[places]

    def first(self, k: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and products of the k largest with ``least`` <= product <= ``most``, ties by smaller id."""
        places = np.arange(len(self.at))
        if self.sure:  # else intervals lie beyond the range of doubles, and all rows are scored
            low, high = -np.inf if least <= ENDS[0] else least, np.inf if most >= ENDS[1] else most
            lo, hi = np.searchsorted(self.middle, low - self.widest), np.searchsorted(self.middle, high + self.widest, "right")
            if hi - lo > PROBES:
                start = min(max(np.searchsorted(self.middle, high) - 3 * PROBES // 4, lo), hi - PROBES)
                probe = self.products(places[start:start + PROBES])
                known = probe[(probe <= most) & (probe >= least)]
                if len(known) >= k:
                    low = np.partition(known, len(known) - k)[len(known) - k]
                    lo = np.searchsorted(self.middle, low - self.widest)
            middle, half = self.middle[lo:hi], self.half[lo:hi]
            places = places[lo:hi][(middle + half >= low) & (middle - half <= high)]
        found = self.products(places)
        kept = (found >= least) & (found <= most)
        at, found = self.at[places[kept]], found[kept]
        best = np.lexsort((self.rows.ids[at], -found))[:k]
        return at[best], found[best]


def _prepared(vectors: DataFrame, asks: Column, scale: float) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("embedding"), asks.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0))
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))))
    usual = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    rows = rows.where(F.size("embedding") == (usual[0]["size"] if usual else -1))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "asks")).alias("r")).select("vec_id", "r.*")


INDEX = "vec_id long, label long, asks boolean, whole binary, bits binary, along binary, held double, rest double"


def index(vectors: DataFrame, asks: Column, scale: float, layers: int = LAYERS) -> DataFrame:
    """The stored codes of all rows that take part, beside their integers."""
    rows = _prepared(vectors, asks, scale)
    turns: dict[int, np.ndarray] = {}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.floor(scale * batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
            turn = turns.setdefault(x.shape[1], rotation(x.shape[1]))
            # Codes of scaled vectors: only ratios matter, and lengths of huge components stay finite.
            unit = 2.0 ** np.minimum(np.ceil(np.log2(np.maximum(np.abs(x).max(1), 1.0))), 1023)
            bits, along, held, rest = encode(x / unit[:, None], turn, layers)
            binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), binary(x), binary(bits), binary(along * unit[:, None]),
                 pa.array(held * unit), pa.array(rest * unit)], names=[c.strip().split(" ")[0] for c in INDEX.split(",")])

    return stage(rows.select("vec_id", "label", "embedding", "asks").mapInArrow(coded, INDEX), "codes")


def _first(df: DataFrame, group: list[str], order: list[Column | str], n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0,
         layers: int = LAYERS, row_group: int = ROW_GROUP, anchor_group: int = ANCHOR_GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor of ``vectors`` (vec_id, label, embedding).

    A negative's score is between ``least`` and ``most`` percent of the positive's.
    """
    spark = vectors.sparkSession
    coded = index(vectors, is_anchor, scale, layers)
    n, asked = coded.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    row_groups, anchor_groups = max(1, -(-n // row_group)), max(1, -(-asked // anchor_group))
    of_row, of_anchor = F.pmod(F.xxhash64("vec_id"), F.lit(row_groups)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(anchor_groups))
    groups = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    rows = coded.drop("asks").withColumn("rows", of_row).withColumn("anchors", groups(anchor_groups))
    anchors = coded.where("asks").drop("asks").withColumn("anchors", of_anchor)

    def paired(asking: DataFrame, one: Callable, names: list[str]) -> DataFrame:
        """What ``one`` finds for every anchor in every group of rows."""
        def run(asked: pa.Table, there: pa.Table) -> pa.Table:
            found = []
            if len(asked) and len(there):
                mine, theirs = Rows(there), Rows(asked)
                lines = asked.drop_columns(["whole", "bits", "along"]).take(theirs.order).to_pylist()
                for i, line in enumerate(lines):
                    found += one(mine, theirs, i, line)
            columns = list(zip(*found)) or [[] for _ in names]
            return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)

        keys = ["rows", "anchors"]
        spread = asking.withColumn("rows", groups(row_groups))
        return spread.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, ", ".join(f"{c} long" for c in names))

    def nearest(there: Rows, of: Rows, i: int, line: dict) -> list[tuple]:
        lo, hi = there.span(line["label"])
        middle, half = there.intervals(slice(lo, hi), of, i)
        other = there.ids[lo:hi] != line["vec_id"]
        at, found = Candidates(there, np.arange(lo, hi)[other], middle[other], half[other], of.x[i]).first(positives, *ENDS)
        return [(line["vec_id"], int(there.ids[a]), int(s)) for a, s in zip(at, found)]

    def hard(there: Rows, of: Rows, i: int, line: dict) -> list[tuple]:
        ranges = [(p, -(-least * p["score"] // 100), most * p["score"] // 100) for p in line["positives"]]
        middle, half = there.intervals(slice(0, len(there.ids)), of, i)
        inside = ~(middle + half < min(low for _, low, _ in ranges))
        inside[slice(*there.span(line["label"]))] = False
        at = np.flatnonzero(inside)
        near, out = Candidates(there, at, middle[at], half[at], of.x[i]), []
        for p, low, high in ranges:
            if low <= high:
                at, found = near.first(negatives, low, high)
                out += [(line["vec_id"], p["vec_id"], p["score"], int(there.ids[a]), int(s)) for a, s in zip(at, found)]
        return out

    near = paired(anchors, nearest, ["anchor_id", "vec_id", "score"])
    near = _first(near, ["anchor_id"], [F.desc("score"), "vec_id"], positives, "place")
    own = near.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives")).withColumnRenamed("anchor_id", "vec_id")
    asking = stage(anchors.join(own, "vec_id"), "positives")
    far = paired(asking, hard, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    best = _first(far, ["anchor_id", "positive_id"], [F.desc("negative_score"), "negative_id"], negatives, "rank")
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
