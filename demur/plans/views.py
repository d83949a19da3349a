"""The evaluation facts over the test tables, as DataFrames and as SQL.

An order is an entity: its truth is the sum of its lines, a frozen lookup predictor estimates it from part
quantities, and customers are the clusters. A condition hides some lines from the predictor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from demur.functions.draws import uniform
from demur.operators.lines import fit_line
from demur.operators.lookup import priors
from demur.sources.staging import deal, stage_once

from .registry import cte, u

# Shares of the clusters by role.
TEST_BELOW, CALIB_BELOW = 0.25, 0.475
CONDITIONS = ["clean", "no_returns", "closed_only"]
GATES = ["pred_magnitude", "mass", "learned_error", "model_spread", "n_lines", "spread"]
MODEL_GATES = ["pred_magnitude", "mass", "learned_error", "model_spread"]
INPUT_GATES = ["n_lines", "spread"]
FACT_FOLDERS, FACT_ORDER = ("condition", "role"), ("id",)
RISK_SIGN = {"n_lines": -1.0, "spread": -1.0}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def role_of(cluster: Column) -> Column:
    draw = uniform("role", cluster)
    return F.when(draw < TEST_BELOW, "test").when(draw < CALIB_BELOW, "calib").otherwise("fit")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """id, cluster, ts, role of every order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"),
        F.col("o_orderdate").alias("ts"), role_of(F.col("o_custkey")).alias("role"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with the cluster and role of their order."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("name"), F.col("l_quantity").alias("grams"),
        F.col("l_extendedprice").alias("amount"), "l_returnflag", "l_linestatus")
    return li.join(entities(spark, sf), "id")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with lines: truth, mass and line count."""
    raw = table(spark, sf, "lineitem")
    sums = deal(raw.select(F.col("l_orderkey").alias("id"), "l_extendedprice", "l_quantity"), raw.count(), "id").groupBy("id").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("truth"), F.sum("l_quantity").alias("mass"), F.count(F.lit(1)).alias("n_lines"))
    return sums.join(entities(spark, sf), "id")


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Median amount per unit and median quantity of every name, from fit lines only; learned once."""
    return stage_once(spark, f"{sf}:vocab", lambda: priors(
        lines(spark, sf).filter("role = 'fit'"), "name", "grams", "amount", decimals=4, rows=table(spark, sf, "lineitem").count()), sf)


cte("ents", f"""SELECT o_orderkey AS id, o_custkey AS cluster, o_orderdate AS ts,
  CASE WHEN {u("'role'", 'o_custkey')} < {TEST_BELOW} THEN 'test'
       WHEN {u("'role'", 'o_custkey')} < {CALIB_BELOW} THEN 'calib' ELSE 'fit' END AS role FROM orders""")
cte("lines", """SELECT e.*, l_partkey AS name, l_quantity AS grams, l_extendedprice AS amount, l_returnflag,
  l_linestatus FROM lineitem JOIN ents e ON l_orderkey = e.id""", "ents")
cte("items", """SELECT id, any_value(cluster) AS cluster, any_value(ts) AS ts, any_value(role) AS role,
  round(sum(amount), 2) AS truth, sum(grams) AS mass, count(*) AS n_lines FROM lines GROUP BY id""", "lines")
cte("vocab", """SELECT name, floor(median(amount/grams) FILTER (WHERE grams > 0)*10000 + 0.5)/10000 AS density, median(grams) AS typical
  FROM lines WHERE role = 'fit' GROUP BY name""", "lines")

# Lines the predictor sees under each condition.
_VISIBLE = {"clean": "true", "no_returns": "l_returnflag <> 'R'", "closed_only": "l_linestatus = 'F'"}


def _conditional_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over the lines: per order and condition, what the predictor sees and says.

    Names come first and orders last: lines travel by order once, and are joined with it and summed where they then lie.
    """
    raw = table(spark, sf, "lineitem")
    count = raw.count()
    priced = raw.select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("name"), F.col("l_quantity").alias("grams"), F.col("l_extendedprice").alias("amount"),
        *[F.expr(seen).alias(f"in_{c}") for c, seen in _VISIBLE.items()]).join(vocab(spark, sf), "name", "left").select(
        "id", "grams", "amount", *[f"in_{c}" for c in _VISIBLE], (F.col("grams") * F.coalesce("density", F.lit(0.0))).alias("p"),
        F.coalesce("typical", F.lit(0.0)).alias("g"))
    aggs = [F.round(F.sum("amount"), 2).alias("truth"), F.sum("grams").alias("mass_true")]
    for c in _VISIBLE:
        only = lambda col, c=c: F.when(F.col(f"in_{c}"), F.col(col))
        aggs.append(F.struct(
            F.lit(c).alias("condition"),
            F.round(F.coalesce(F.sum(only("p")), F.lit(0.0)), 4).alias("pred"),
            F.round(F.coalesce(F.sum(only("g")), F.lit(0.0)), 4).alias("mass_pred"),
            F.coalesce(F.sum(only("grams")), F.lit(0.0)).alias("mass"),
            F.count(only("grams")).alias("n_lines"),
            F.round(F.coalesce(F.max(only("amount")) - F.min(only("amount")), F.lit(0.0)), 2).alias("spread"),
        ).alias(c))
    wide = deal(priced, count, "id").join(entities(spark, sf), "id").groupBy("id", "cluster", "ts", "role").agg(*aggs)
    return wide.select("id", "cluster", "ts", "role", "truth", "mass_true",
                       F.inline(F.array(*CONDITIONS)))


def unit_price() -> Column:
    return F.col("pred") / F.greatest(F.col("n_lines"), F.lit(1))


def _fact(spark: SparkSession, sf: str) -> DataFrame:
    base = _conditional_predictions(spark, sf).withColumn(
        "err", F.round(F.abs(F.col("pred") - F.col("truth")), 4))
    base = stage_once(spark, f"{sf}:base", lambda: base.withColumn("x_unit", unit_price()), sf)
    clean = base.filter("condition = 'clean'")
    second = fit_line(clean.filter("role = 'fit'"), "mass", "truth", 1.0)
    head = fit_line(clean.filter("role = 'calib'"), "x_unit", "err", 1.0)
    # What is computed from a row alone does not travel.
    dealt = deal(base, base.count(), *FACT_FOLDERS, *FACT_ORDER, ordered=True).sortWithinPartitions(*FACT_FOLDERS, *FACT_ORDER)
    out = dealt.withColumn("pred2", F.round(second.predict(F.col("mass")), 4))
    return out.select(
        "id", "cluster", "ts", "role", "condition", "truth", "pred", "err", "mass_true", "mass_pred",
        F.round(F.abs(F.col("mass_pred") - F.col("mass_true")), 4).alias("mass_err"), "mass", "n_lines", "spread",
        "pred2", F.round(F.abs(F.col("pred2") - F.col("truth")), 4).alias("err2"),
        F.round(head.predict(F.col("x_unit")), 4).alias("learned_error"),
        F.round(F.abs(F.col("pred") - F.col("pred2")) / 2, 5).alias("model_spread"),
        F.col("pred").alias("pred_magnitude"))


def fact(spark: SparkSession, sf: str) -> DataFrame:
    """The prediction fact, built once per application and read by every evaluation."""
    return stage_once(spark, f"{sf}:fact", lambda: _fact(spark, sf), sf, FACT_FOLDERS, FACT_ORDER, dealt=True)


_SEEN_SQL = {"clean": "TRUE", "no_returns": "l_returnflag <> 'R'", "closed_only": "l_linestatus = 'F'"}
cte("base", " UNION ALL ".join(f"""SELECT id, any_value(cluster) AS cluster, any_value(ts) AS ts,
  any_value(role) AS role, round(sum(amount), 2) AS truth, sum(grams) AS mass_true, '{c}' AS condition,
  round(coalesce(sum(grams*coalesce(density,0)) FILTER (WHERE {seen}), 0), 4) AS pred,
  round(coalesce(sum(coalesce(typical,0)) FILTER (WHERE {seen}), 0), 4) AS mass_pred,
  coalesce(sum(grams) FILTER (WHERE {seen}), 0) AS mass, count(*) FILTER (WHERE {seen}) AS n_lines,
  round(coalesce(max(amount) FILTER (WHERE {seen}) - min(amount) FILTER (WHERE {seen}), 0), 2) AS spread
  FROM lines LEFT JOIN vocab USING (name) GROUP BY id""" for c, seen in _SEEN_SQL.items()), "lines", "vocab")
cte("base_err", """SELECT *, round(abs(pred - truth), 4) AS err, pred / greatest(n_lines, 1) AS x_unit FROM base""",
    "base")
cte("line2", """SELECT avg(mass) AS mx, avg(truth) AS my,
  covar_pop(mass, truth)*count(*) / (var_pop(mass)*count(*) + 1.0) AS w
  FROM base_err WHERE condition = 'clean' AND role = 'fit'""", "base_err")
cte("head", """SELECT avg(x_unit) AS mx, avg(err) AS my,
  covar_pop(x_unit, err)*count(*) / (var_pop(x_unit)*count(*) + 1.0) AS w
  FROM base_err WHERE condition = 'clean' AND role = 'calib'""", "base_err")
cte("fact", """SELECT b.id, b.cluster, b.ts, b.role, b.condition, b.truth, b.pred, b.err, b.mass_true, b.mass_pred,
  round(abs(b.mass_pred - b.mass_true), 4) AS mass_err, b.mass, b.n_lines, b.spread,
  round((b.mass - line2.mx)*line2.w + line2.my, 4) AS pred2,
  round(abs(round((b.mass - line2.mx)*line2.w + line2.my, 4) - b.truth), 4) AS err2,
  round((b.x_unit - head.mx)*head.w + head.my, 4) AS learned_error,
  round(abs(b.pred - round((b.mass - line2.mx)*line2.w + line2.my, 4)) / 2, 5) AS model_spread,
  b.pred AS pred_magnitude FROM base_err b, line2, head""", "base_err", "line2", "head")


def long_gates(rows: DataFrame, keep: list[str], gates: list[str] = GATES) -> DataFrame:
    """Wide to long: one row per gate, signed so that a high score means risky."""
    pairs = [F.struct(F.lit(g).alias("gate"),
                      (F.col(g).cast("double") * F.lit(RISK_SIGN.get(g, 1.0))).alias("score")) for g in gates]
    return rows.select(*keep, F.inline(F.array(*pairs)))


_LONG = " UNION ALL ".join(
    f"SELECT id, cluster, role, condition, truth, pred, err, '{g}' AS gate, "
    f"{RISK_SIGN.get(g, 1.0)} * {g}::DOUBLE AS score FROM fact" for g in GATES)
cte("long_all", _LONG, "fact")
cte("test_long", "SELECT * FROM long_all WHERE role = 'test' AND condition = 'clean'", "long_all")
cte("test_rows", "SELECT * FROM fact WHERE role = 'test' AND condition = 'clean'", "fact")
cte("calib_rows", "SELECT * FROM fact WHERE role = 'calib' AND condition = 'clean'", "fact")


def test_rows(spark: SparkSession, sf: str) -> DataFrame:
    return fact(spark, sf).filter("role = 'test' AND condition = 'clean'")


def calib_rows(spark: SparkSession, sf: str) -> DataFrame:
    return fact(spark, sf).filter("role = 'calib' AND condition = 'clean'")


def test_long(spark: SparkSession, sf: str) -> DataFrame:
    return long_gates(test_rows(spark, sf), ["id", "cluster", "truth", "pred", "err"])
