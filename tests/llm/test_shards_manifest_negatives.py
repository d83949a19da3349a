"""Shards, manifests and hard negatives against brute force, with the odd rows that each operator defines."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from demur.llm import merkle, negatives, sharding

DOCS = "doc_id long, source string, text string, shard string, slot string"


# Shards

def shard_rows():
    rows = [(i, "hot", f"t{i}", "own", None) for i in range(400)] + [(i, f"s{i % 7}", "same text", None, "own") for i in range(400, 600)]
    return rows + [(600 + i, f"lone{i}", None, None, None) for i in range(30)] + [(None, None, "", None, None)] * 5 + [(7, None, "x", None, None)] * 40


def test_shards_follow_the_mixture(spark):
    rows = spark.createDataFrame(shard_rows(), DOCS).repartition(5)
    placed = sharding.interleave(rows, 8, identity=("doc_id", "text"))
    assert placed.columns == [*rows.columns, "shard", "slot"]
    got = placed.toDF("doc_id", "source", "text", "own_shard", "own_slot", "at", "place").collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(shard_rows())
    slots, inside = defaultdict(list), defaultdict(Counter)
    for r in got:
        slots[r["at"]].append(r["place"])
        inside[r["at"]][r["source"]] += 1
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter(r["source"] for r in got)
    for source, n in sizes.items():
        assert all(abs(c[source] - n / 8) <= 2 + len(sizes) ** 0.5 for c in inside.values())


def test_shards_do_not_depend_on_buckets_or_partitions(spark):
    rows = [r[:3] for r in shard_rows()]
    places = lambda parts, per: sorted(map(repr, sharding.interleave(
        spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts), 8, identity=("doc_id", "text"), per_bucket=per).collect()))
    assert places(1, 1 << 20) == places(7, 1)


def test_few_rows_and_no_rows(spark, tmp_path):
    schema = "doc_id long, source string, text string"
    assert sharding.interleave(spark.createDataFrame([], schema), 4).collect() == []
    few = sharding.interleave(spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, None)], schema), 40)
    assert len({r["shard"] for r in few.collect()}) == 3 and {r["slot"] for r in few.collect()} == {0}
    sharding.write_shards(few, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r["doc_id"], r["shard"]) for r in back.collect()) == sorted((r["doc_id"], r["shard"]) for r in few.collect())


# Manifests

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha("".join(level[i:i + arity])) for i in range(0, len(level), arity)])
    return levels


def siblings_of(levels, at, arity):
    out = []
    for level in levels[:-1]:
        first = at - at % arity
        out += [n for i, n in enumerate(level[first:first + arity], first) if i != at]
        at //= arity
    return out


def brute_manifest(rows, arity):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r)))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: levels_of([leaf for *_, leaf in sorted(trees[s])], arity) for s in order}
    top = levels_of([grown[s][-1][0] for s in order], arity)
    out = []
    for i, s in enumerate(order):
        for at, (known, doc_id, leaf) in enumerate(sorted(trees[s])):
            proof = siblings_of(grown[s], at, arity) + siblings_of(top, i, arity)
            out.append((doc_id if known else None, leaf, grown[s][-1][0], top[-1][0], sha("".join(proof))))
    return sorted(out, key=repr)


def proved(spark, rows, arity, steps, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)
    leaves = docs.select(F.col("source").alias("tree"), "doc_id", merkle.leaf_digest(*[F.col(c) for c in docs.columns]).alias("digest"))
    return merkle.manifest(leaves, ["doc_id"], ("doc_id",), arity, steps, per_task=7).proofs()


@pytest.mark.parametrize("arity,steps", [(3, 4), (3, 1), (2, 2)])
def test_manifest_equals_brute_force(spark, arity, steps):
    rows = [(i, "hot", f"Ä {i}\n") for i in range(100)] + [(500, "lone", None), (501, None, ""), (None, None, "x"), (None, None, "x"), (502, "é", "-")]
    rows += [(600 + i, f"z{i:02}", "same") for i in range(11)] + [(9, "pair", "x"), (9, "pair", "x"), (9, "pair", "y"), (1, "", None)]
    got = proved(spark, rows, arity, steps).select(
        "doc_id", "digest", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.folded(F.col("digest"), F.col("proof")).alias("end")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_manifest(rows, arity)
    assert all(r["end"] == r["root"] for r in got)


def test_changed_leaves_do_not_fold_to_the_root(spark):
    got = proved(spark, [(i, f"s{i % 3}", "t") for i in range(20)], 3, 2)
    other = merkle.folded(merkle.sha256(F.concat("digest", F.lit("!"))), F.col("proof"))
    assert got.where(other == F.col("root")).count() == 0


def test_manifest_of_one_row_and_of_nothing(spark):
    (row,) = proved(spark, [(1, "a", "x")], 3, 4).collect()
    assert row["digest"] == row["subroot"] == row["root"] and row["proof"] == []
    assert proved(spark, [], 3, 4).collect() == []


# Hard negatives

VECTORS = "vec_id long, label long, embedding array<double>, note string"


def brute_negatives(rows, positives=5, negatives_=3, every=5):
    known = {}
    for vec_id, label, v, _ in sorted(rows, key=repr):
        if None in (vec_id, label, v) or not v or any(x is None or not math.isfinite(x) for x in v) or len(v) != 6:
            continue
        known[vec_id] = min(known.get(vec_id, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in known.items()}
    out = []
    for a in whole:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(whole[a][1], w)), i, label == whole[a][0]) for i, (label, w) in whole.items() if i != a]
        for p, i, _ in sorted(s for s in scored if s[2])[:positives]:
            hard = sorted(s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives_]
            out += [(a, i, r, j, -p, -s) for r, (s, j, _) in enumerate(hard, 1)]
    return sorted(out)


def vector_rows(n=400, scale=1.0):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(4, 6))
    rows = [(i, int(draw.integers(3)), (scale * (centres[i % 4] + 0.5 * draw.normal(size=6))).tolist(), None) for i in range(n)]
    rows += [(n + i, i % 3, rows[0][2], None) for i in range(30)] + rows[5:9] + [(n + 100, 1, [0.0] * 6, None), (n + 105, 0, rows[1][2], "own label")]
    return rows + [(n + 110, None, rows[1][2], None), (None, 1, rows[1][2], None), (n + 111, 1, None, None), (n + 112, 1, [], None), (n + 115, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0], None),
                   (n + 120, 1, [math.nan] * 6, None), (n + 125, 1, [math.inf] + [0.0] * 5, None), (n + 130, 1, [1.0] * 5, None), (n + 135, 77, [1.0] * 6, None), (10, 0, rows[0][2], "second")]


@pytest.mark.parametrize("options", [{}, {"row_group": 60, "anchor_group": 20, "layers": 2}])
def test_hard_negatives_equal_brute_force(spark, options):
    rows = vector_rows()
    got = negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(4), F.col("vec_id") % 5 == 0, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_products_beyond_doubles_are_exact(spark):
    rows = [(i, i % 2, [float(2 ** 20 + i), float(i), 1.0, 0.0, 3.0, -float(i)], None) for i in range(40)]
    got = negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, most=100)
    assert got.count() > 0
    at = {i: [256 * int(x) for x in v] for i, _, v, _ in rows}
    for r in got.collect():
        assert r["positive_score"] == sum(x * y for x, y in zip(at[r["anchor_id"]], at[r["positive_id"]])) > 1 << 53
        assert r["negative_score"] == sum(x * y for x, y in zip(at[r["anchor_id"]], at[r["negative_id"]]))
    wild = [(i, i % 2, [1e300, -1e300, 1e154, 0.0, 1.0, float(i)], None) for i in range(12)]
    assert negatives.mine(spark.createDataFrame(wild, VECTORS), F.col("vec_id") % 5 == 0).count() == 0


def test_no_vectors_and_no_anchors(spark):
    assert negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0).collect() == []
    assert negatives.mine(spark.createDataFrame(vector_rows(20), VECTORS), F.col("vec_id") < 0).collect() == []


def test_intervals_hold_and_exclude(spark):
    draw = np.random.default_rng(1)
    x = np.floor(256 * draw.normal(size=(500, 70)) / 8)
    bits, along, held, rest = negatives.encode(x, negatives.rotation(70))
    import pyarrow as pa
    raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
    t = pa.table({"vec_id": np.arange(500), "label": np.zeros(500, int), "whole": raw(x), "bits": raw(bits), "along": raw(along), "held": held, "rest": rest})
    rows = negatives.Rows(t)
    out = 0
    for i in range(20):
        middle, half = rows.intervals(slice(0, 500), rows, i)
        true = x @ x[i]
        assert (np.abs(true - middle) <= half).all()
        out += (middle + half < np.sort(true)[-10]).sum()
    assert out > 0.3 * 20 * 490
