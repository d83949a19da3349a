"""Merkle manifest of a dataset that stores only every few levels and regenerates the rest when proofs are taken.

Every tree (here: a source) has its leaves in order; while a level has more than one node, each run of ``arity`` neighbours becomes their
digest. The trees' roots, in order of the trees, are the leaves of one more tree, whose root stands for the dataset. A digest is the
lowercase hex SHA-256 of its inputs, joined.

*Stored* are the leaves and every ``steps``-th level above them, one row per aligned subtree with the digests of its lowest level (at most ``arity`` ** ``steps``).
A proof needs the siblings at all levels: going down from the root, each stored row regenerates the levels between it and the next stored
one, adds the siblings of its nodes to what the subtree above has proved, and forgets the nodes again. All of it is column logic on bounded
arrays; a level is one grouping by (tree, position / arity ** steps), so that a tree with a third of all leaves is as spread out as the others.

Leaves get their positions from one range sort of (tree, order, digest): rows are numbered inside their range, and ranges are added up by one count
per (range, tree).

Rows: a null tree comes first, a null order value comes first in its tree; equal order values are ordered by digest, and rows alike in both are leaves each;
a tree of one leaf has that leaf as root; an empty table gives no rows; extra columns are ignored or carried as ``payload``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from demur.sources.staging import stage

ARITY, STEPS = 3, 4
#: Leaves that one task of the range sort takes at the most wanted.
PER_TASK = 2_000_000


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return sha256(F.concat(*[field(v) for v in values]))


def numbered(rows: DataFrame, tree: list[str], order: list[str], per_task: int = PER_TASK) -> DataFrame:
    """``rows`` (a written table) with ``place``, the number from 0 inside the tree by ``order``, and ``inside``, the rows of the tree."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_task))
    ordered = rows.repartitionByRange(parts, *tree, *order).sortWithinPartitions(*tree, *order)
    # The number holds the range in its upper bits and rises by one inside it, where rows of one tree lie together.
    table = stage(ordered.withColumn("row at", F.monotonically_increasing_id()), "ordered").withColumn("range", F.shiftright("row at", 33))
    runs = table.groupBy(*tree, "range").agg(F.min("row at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*tree)
    before = F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(*tree, "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("inside"))
    return table.join(starts, [*tree, "range"]).withColumn("place", F.col("row at") + F.col("shift")).drop("row at", "range", "shift")


def _height(inside: Column, arity: int) -> Column:
    """Levels above the leaves: the powers of the arity below the number of leaves."""
    powers = [arity ** i for i in range(64) if arity ** i < 1 << 63]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < inside))


def _regenerated(digests: Column, rounds: Column, arity: int, steps: int) -> Column:
    """The levels of one aligned subtree from its lowest one, ``rounds`` of them above it."""
    def up(level: Column) -> Column:
        runs = F.sequence(F.lit(0), ((F.size(level) - 1) / arity).cast("int"))
        return F.transform(runs, lambda j: sha256(F.array_join(F.slice(level, j * arity + 1, F.lit(arity)), "")))

    climbs = F.slice(F.sequence(F.lit(1), F.lit(steps)), F.lit(1), rounds)
    return F.aggregate(climbs, F.array(digests), lambda levels, _: F.concat(levels, F.array(up(F.element_at(levels, -1)))))


def _siblings(levels: Column, at: Column, rounds: Column, arity: int, steps: int) -> Column:
    """Per level the joined siblings before and after the ancestor of the node ``at``."""
    powers = F.array(*[F.lit(arity ** i) for i in range(steps)])

    def one(i: Column) -> Column:
        node = (at / F.element_at(powers, i + 1)).cast("int")
        level, first = F.element_at(levels, i + 1), node - node % arity
        return F.struct(F.array_join(F.slice(level, first + 1, node - first), "").alias("before"),
                        F.array_join(F.slice(level, node + 2, first + arity - 1 - node), "").alias("after"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(1), rounds), one)


@dataclass
class Forest:
    """Stored levels of many trees: tables of (tree, height, block, nodes), the k-th of level k * steps; and (tree, digest) of their roots."""

    levels: list[DataFrame]
    roots: DataFrame
    arity: int
    steps: int

    def rounds(self, k: int) -> Column:
        return F.least(F.lit(self.steps), F.col("height") - k * self.steps)

    def regenerated(self, k: int) -> Column:
        return _regenerated(F.col("nodes.digest"), self.rounds(k), self.arity, self.steps)


def plant(leaves: DataFrame, payload: tuple[str, ...] = (), arity: int = ARITY, steps: int = STEPS) -> Forest:
    """Build the trees of ``leaves`` (tree, place, inside, digest, payload); ``payload`` stays beside the leaves."""
    nodes = leaves.select("tree", _height(F.col("inside"), arity).alias("height"), "place", "digest", *payload)
    forest, parts = Forest([], None, arity, steps), []
    span, tallest, carried = arity ** steps, None, payload
    while True:
        k = len(forest.levels)
        block = F.expr(f"place div {span}").alias("block")
        rows = nodes.groupBy("tree", "height", block).agg(F.sort_array(F.collect_list(F.struct("place", "digest", *carried))).alias("nodes"))
        forest.levels.append(stage(rows, f"level{k * steps}"))
        if tallest is None:
            tallest = forest.levels[0].agg(F.max("height")).first()[0] or 0
        top = F.element_at(F.element_at(forest.regenerated(k), -1), 1).alias("digest")
        nodes, carried = forest.levels[k].select("tree", "height", F.col("block").alias("place"), top), ()
        done = (k + 1) * steps
        parts.append(nodes.where(F.col("height") <= done).select("tree", "digest"))
        nodes = nodes.where(F.col("height") > done)
        if tallest <= done:
            break
    roots = parts[0]
    for part in parts[1:]:
        roots = roots.unionByName(part)
    forest.roots = stage(roots, "roots")
    return forest


def proofs(forest: Forest, above: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """Of every leaf: tree, ``payload``, digest, proof and the other columns of ``above``.

    ``above`` has a row per tree with what proves its root: tree, proof and any other columns. A proof is an array of (before, after), lowest level first.
    """
    more = [c for c in above.columns if c not in ("tree", "proof")]
    out, steps = None, forest.steps
    for k in reversed(range(len(forest.levels))):
        rows = forest.levels[k]
        # Trees that end inside these levels take what is above them; the others what their parents have proved.
        tops = rows.where((F.col("height") <= (k + 1) * steps) & (F.col("block") == 0)).select("tree").join(above, "tree").select(
            "tree", F.lit(0).cast("long").alias("block"), F.col("proof").alias("upper"), *more)
        upper = tops if out is None else tops.unionByName(out.select("tree", F.col("place").alias("block"), F.col("proof").alias("upper"), *more))
        carried = payload if k == 0 else ()
        grown = rows.join(upper, ["tree", "block"]).select("tree", "nodes", "upper", *more, forest.rounds(k).alias("rounds"), forest.regenerated(k).alias("grown"))
        proved = F.transform("nodes", lambda x, i: F.struct(x.alias("node"), F.concat(
            _siblings(F.col("grown"), i, F.col("rounds"), forest.arity, steps), F.col("upper")).alias("proof")))
        out = grown.select("tree", *more, F.explode(proved).alias("p")).select(
            "tree", *more, "p.proof", "p.node.place", "p.node.digest", *[F.col(f"p.node.{c}") for c in carried])
    return out


@dataclass
class Manifest:
    """The forest of all trees and the tree of their roots."""

    trees: Forest
    top: Forest
    payload: tuple[str, ...]

    def root(self) -> DataFrame:
        """One row: the digest of the dataset."""
        return self.top.roots.select("digest")

    def proofs(self) -> DataFrame:
        """tree, payload, digest, subroot, root and proof (array of before, after) of every leaf."""
        empty = F.array().cast("array<struct<before:string,after:string>>")
        whole = self.top.roots.select("tree", empty.alias("proof"), F.col("digest").alias("root"))
        above = proofs(self.top, whole, ("of",)).select(F.col("of").alias("tree"), "proof", "root", F.col("digest").alias("subroot"))
        return proofs(self.trees, above, self.payload).drop("place")


def manifest(leaves: DataFrame, order: list[str], payload: tuple[str, ...] = (), arity: int = ARITY, steps: int = STEPS, per_task: int = PER_TASK) -> Manifest:
    """Store the manifest of ``leaves``: columns tree (text or null), those of ``order``, digest and ``payload``."""
    # Null sorts before every text, so that plain keys serve for joins and order.
    tree = F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("-")).alias("tree")
    rest = dict.fromkeys([*order, "digest", *payload])
    rows = stage(leaves.select(tree, *rest), "leaves")
    trees = plant(numbered(rows, ["tree"], [*order, "digest"], per_task), payload, arity, steps)
    above = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    top = plant(numbered(above, ["tree"], ["of"], per_task), ("of",), arity, steps)
    return Manifest(trees, top, payload)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, s: sha256(F.concat(s["before"], digest, s["after"])))


def proof_digest(proof: Column) -> Column:
    return sha256(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))
