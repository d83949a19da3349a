"""Queries: carves, folds, draws and permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.operators.splits import (carve, carve_rows, cluster_sizes, deal_by_size, deal_round_robin,
                                    mixture_pick, permute)

from .registry import cte, query, u, with_ctes
from .views import items, test_rows, fact

# Shares of the conditions in a deployment mixture.
MIXTURE = {"clean": 0.7, "no_returns": 0.2, "closed_only": 0.1}

cte("pool", "SELECT id, cluster, truth, mass FROM items WHERE role <> 'test'", "items")
cte("pool_sizes", "SELECT cluster, count(*) AS size FROM pool GROUP BY cluster", "pool")


def pool(spark, sf):
    return items(spark, sf).filter("role <> 'test'")


@query("cluster_carve", with_ctes(f"""SELECT cluster, size,
    sum(size) OVER (ORDER BY {u("'carve'", '760', 'cluster')}, cluster ROWS UNBOUNDED PRECEDING) - size
      < 0.3 * sum(size) OVER () AS calib FROM pool_sizes""", "pool_sizes"))
def cluster_carve(spark, sf):
    return carve(cluster_sizes(pool(spark, sf))).select("cluster", "size", "calib")


@query("row_carve", with_ctes(f"""SELECT id, row_number() OVER (ORDER BY {u("'row-carve'", '760', 'id')}, id)
    <= round_even(0.3::DOUBLE * count(*) OVER (), 0) AS calib FROM pool""", "pool"))
def row_carve(spark, sf):
    return carve_rows(pool(spark, sf).select("id"))


@query("cluster_folds", with_ctes(f"""WITH r AS (SELECT cluster, size,
    (row_number() OVER (ORDER BY size DESC, {u("'fold'", '760', 'cluster')}, cluster) - 1) % 10 AS p FROM pool_sizes)
  SELECT cluster, size, CASE WHEN p < 5 THEN p ELSE 9 - p END AS fold FROM r""", "pool_sizes"))
def cluster_folds(spark, sf):
    return deal_by_size(cluster_sizes(pool(spark, sf)), 5)


@query("round_robin_folds", with_ctes(f"""SELECT cluster, size,
    (row_number() OVER (ORDER BY {u("'robin'", '760', 'cluster')}, cluster) - 1) % 5 AS fold FROM pool_sizes""",
    "pool_sizes"))
def round_robin_folds(spark, sf):
    return deal_round_robin(cluster_sizes(pool(spark, sf)), 5)


_DRAW = u("'mixture'", "761", "id")


@query("mixture_draw", with_ctes(f"""SELECT id, CASE WHEN {_DRAW} < 0.7::DOUBLE THEN 'clean'
    WHEN {_DRAW} < 0.7::DOUBLE + 0.2::DOUBLE THEN 'no_returns' ELSE 'closed_only' END AS condition FROM items""", "items"))
def mixture_draw(spark, sf):
    return items(spark, sf).select("id", mixture_pick(F.col("id"), MIXTURE).alias("condition"))


cte("mixed", f"""SELECT f.* FROM fact f WHERE condition = CASE WHEN {_DRAW} < 0.7::DOUBLE THEN 'clean'
    WHEN {_DRAW} < 0.7::DOUBLE + 0.2::DOUBLE THEN 'no_returns' ELSE 'closed_only' END""", "fact")


def mixed(spark, sf):
    """One condition per id. The pick is an expression of the id, so the join is a filter on the fact."""
    return fact(spark, sf).filter(F.col("condition") == mixture_pick(F.col("id"), MIXTURE))


@query("mixture_assemble", with_ctes("""SELECT condition, role, count(*) AS n, round(avg(err), 4) AS mean_err FROM mixed
  GROUP BY condition, role""", "mixed"))
def mixture_assemble(spark, sf):
    return mixed(spark, sf).groupBy("condition", "role").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("err"), 4).alias("mean_err"))


_P = u("'permute'", "760", "id")


@query("permute_global", with_ctes(f"""SELECT a.id, b.err AS shuffled FROM
    (SELECT id, row_number() OVER (ORDER BY id) AS r FROM test_rows) a JOIN
    (SELECT err, row_number() OVER (ORDER BY {_P}, id) AS r FROM test_rows) b USING (r)""", "test_rows"))
def permute_global(spark, sf):
    return permute(test_rows(spark, sf).select("id", "err"), "err").select("id", "shuffled")


@query("permute_band", with_ctes(f"""WITH t AS (SELECT id, err, n_lines, {_P} AS u FROM test_rows)
  SELECT n_lines, a.id, b.err AS shuffled FROM
    (SELECT id, n_lines, row_number() OVER (PARTITION BY n_lines ORDER BY id) AS r FROM t) a JOIN
    (SELECT err, n_lines, row_number() OVER (PARTITION BY n_lines ORDER BY u, id) AS r FROM t) b USING (n_lines, r)""",
    "test_rows"))
def permute_band(spark, sf):
    return permute(test_rows(spark, sf).select("id", "n_lines", "err"), "err", within=["n_lines"]).select(
        "n_lines", "id", "shuffled")
