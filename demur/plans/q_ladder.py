"""Queries: the lookup ladder."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.operators.lookup import RUNGS, global_priors, ladder, perturbed_errors, rung_errors
from demur.operators.ranking import running

from .registry import cte, query, u, with_ctes
from .views import TEST_BELOW, entities, items, lines, table, vocab

SCENARIOS = [(0.0, 0.0), (0.1, 0.0), (0.0, 0.2), (0.1, 0.2), (0.2, 0.2), (0.2, 0.3)]
DRAWS = 20


@query("ingredient_priors", with_ctes("SELECT name, round(density, 4) AS density, typical FROM vocab", "vocab"))
def ingredient_priors(spark, sf):
    return vocab(spark, sf).select("name", F.round("density", 4).alias("density"), "typical")


cte("globals", "SELECT median(truth/mass) AS gd, avg(truth) AS gm FROM items WHERE role = 'fit'", "items")
cte("known", """SELECT id, sum(coalesce(typical, 0)) AS t, sum(coalesce(typical, 0)*coalesce(density, 0)) AS td,
  sum(grams*coalesce(density, 0)) AS gd FROM lines LEFT JOIN vocab USING (name) GROUP BY id""", "lines", "vocab")
cte("ladder", """SELECT i.id, i.truth, i.mass, i.role, gm AS "O0", mass*globals.gd AS "O1", k.td AS "O2",
  CASE WHEN t > 0 THEN td/t*mass ELSE gm END AS "O3", k.gd AS "O4" FROM items i JOIN known k USING (id), globals
  WHERE role = 'test'""", "items", "known", "globals")


def test_ladder(spark, sf):
    ln, it = lines(spark, sf), items(spark, sf)
    density, mean = global_priors(it.filter("role = 'fit'"))
    return ladder(ln.filter("role = 'test'"), it.filter("role = 'test'"), vocab(spark, sf), density, mean)


@query("oracle_ladder", with_ctes("SELECT id, " + ", ".join(f'round("{r}", 3) AS "{r}"' for r in RUNGS).replace(
    'round("O2", 3)', 'round("O2", 5)').replace('round("O4", 3)', 'round("O4", 4)') + " FROM ladder", "ladder"))
def oracle_ladder(spark, sf):
    digits = {"O2": 5, "O4": 4}
    return test_ladder(spark, sf).select("id", *[F.round(r, digits.get(r, 3)).alias(r) for r in RUNGS])


@query("oracle_ladder_pop", with_ctes(" UNION ALL ".join(f"""SELECT '{r}' AS rung, population, count(*) AS n,
    round(avg(abs("{r}" - truth)), 3) AS mae, round(100*avg(abs("{r}" - truth)/truth) FILTER (WHERE truth > 1), 5) AS mape FROM
    (SELECT *, 'all' AS population FROM ladder UNION ALL SELECT l.*, 'usable' FROM ladder l JOIN orders ON o_orderkey = id
      WHERE o_orderstatus <> 'P') GROUP BY population""" for r in RUNGS), "ladder"))
def oracle_ladder_pop(spark, sf):
    """Errors per rung on all test items and on the available ones; one pass, the population is a key."""
    there = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("ok"))
    rows = test_ladder(spark, sf).join(there, "id").withColumn("population", F.explode(
        F.when(F.col("ok"), F.array(F.lit("all"), F.lit("usable"))).otherwise(F.array(F.lit("all")))))
    got = rung_errors(rows, ["population"])
    return got.select("rung", "population", "n", F.round("mae", 3).alias("mae"), F.round("mape", 5).alias("mape"))


cte("mc_lines", """SELECT id, name, coalesce(density, 0) AS d, coalesce(typical, 0) AS t, row_number() OVER
    (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos
  FROM (SELECT l_orderkey AS id, l_partkey AS name, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem
        JOIN ents e ON e.id = l_orderkey WHERE role = 'test') LEFT JOIN vocab USING (name)""", "ents", "vocab")
cte("mc_pool", "SELECT row_number() OVER (ORDER BY name) AS ord, density, typical FROM vocab", "vocab")
cte("mc_draws", f"""SELECT id, rep, d, t, coalesce(p.density, 0) AS pd, p.typical AS pt, {u("'swap'", '760', 'rep', 'id', 'pos')} AS swap
  FROM (SELECT *, floor({u("'pick'", '760', 'rep', 'id', 'pos')} * (SELECT count(*) FROM vocab))::BIGINT + 1 AS pick
        FROM mc_lines, range(1, {DRAWS + 1}) r(rep)) JOIN mc_pool p ON p.ord = pick""", "mc_lines", "mc_pool", "vocab")


@query("mc_lookup_error", with_ctes(f"""WITH s AS (SELECT unnest([{','.join(f'{{m: {m}::DOUBLE, p: {p}::DOUBLE}}' for m, p in SCENARIOS)}], recursive := true)),
    g AS (SELECT id, rep, m, p, sum(CASE WHEN swap < p THEN pt ELSE t END) AS t,
      sum(CASE WHEN swap < p THEN pt*pd ELSE t*d END) AS td FROM mc_draws, s GROUP BY id, rep, m, p),
    e AS (SELECT m, p, rep, avg(abs(CASE WHEN t > 0 THEN td/t*mass*(1 + (4*{u("'mass'", '760', 'rep', 'g.id')} - 2)*m) ELSE gm END - truth)) AS mae
      FROM g JOIN items i ON i.id = g.id, globals GROUP BY m, p, rep)
  SELECT m AS mass_err, p AS name_err, round(avg(mae), 3) AS mae FROM e GROUP BY m, p""", "mc_draws", "items", "globals"))
def mc_lookup_error(spark, sf):
    it = items(spark, sf)
    mean = it.filter("role = 'fit'").agg(F.avg("truth")).first()[0]
    asked = entities(spark, sf).filter("role = 'test'").select("id")
    raw = table(spark, sf, "lineitem")
    parts = raw.select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("name"), "l_linenumber", "l_quantity", "l_extendedprice")
    parts = running(parts.join(asked, "id", "left_semi"),
                    ["l_linenumber", "name", "l_quantity", "l_extendedprice"], ["id"], rank="pos")
    got = perturbed_errors(parts, it.filter("role = 'test'"), vocab(spark, sf), mean, SCENARIOS, DRAWS, "pos", count=int(raw.count() * TEST_BELOW))
    return got.withColumn("mae", F.round("mae", 3))
