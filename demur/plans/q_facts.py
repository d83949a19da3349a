"""Queries: the fact, its summaries and its variance."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.functions.expr import percent_true, relative_error, significant
from demur.operators.ranking import coverage_targets, find_splits, take_at
from demur.operators.sessions import gap_histogram, seconds, sessionize, with_gap
from demur.operators.variance import intraclass, variance_split

from .registry import cte, query, u, with_ctes
from .views import entities, fact, items, lines, long_gates, table, test_rows, GATES, RISK_SIGN

REL_FLOOR = 50_000.0


@query("pred_fact", with_ctes("""SELECT id, condition, role, truth, pred, err, mass_true, mass_pred, mass_err, n_lines,
  spread, pred2, err2, learned_error, model_spread FROM fact""", "fact"))
def pred_fact(spark, sf):
    return fact(spark, sf).select("id", "condition", "role", "truth", "pred", "err", "mass_true", "mass_pred", "mass_err",
                                  "n_lines", "spread", "pred2", "err2", "learned_error", "model_spread")


@query("plausible", with_ctes("SELECT id, truth, mass FROM items WHERE mass > 0 AND mass < 200 AND truth >= 0 AND truth < 400000",
                              "items"))
def plausible_items(spark, sf):
    from demur.sources.records import plausible
    return items(spark, sf).filter(plausible(F.col("mass"), F.col("truth"), 200, 400000)).select("id", "truth", "mass")


@query("rel_error", with_ctes(f"""SELECT condition, count(*) AS n, count(*) FILTER (WHERE truth < {REL_FLOOR}) AS n_under_floor,
  round(avg(err/greatest(truth, {REL_FLOOR})), 6) AS mean_rel FROM fact WHERE role = 'test' GROUP BY condition""", "fact"))
def rel_error(spark, sf):
    return fact(spark, sf).filter("role = 'test'").groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("truth") < REL_FLOOR, 1)).alias("n_under_floor"),
        F.round(F.avg(relative_error(F.col("err"), F.col("truth"), REL_FLOOR)), 6).alias("mean_rel"))


@query("mae_mape", with_ctes("""SELECT condition, role, round(avg(err), 4) AS mae,
  round(100*avg(err/truth) FILTER (WHERE truth > 1), 6) AS mape FROM fact GROUP BY condition, role""", "fact"))
def mae_mape(spark, sf):
    return fact(spark, sf).groupBy("condition", "role").agg(
        F.round(F.avg("err"), 4).alias("mae"),
        F.round(100 * F.avg(F.when(F.col("truth") > 1, F.col("err") / F.col("truth"))), 6).alias("mape"))


_SIGNED = " UNION ALL ".join(f"SELECT id, '{g}' AS gate, round({RISK_SIGN.get(g, 1.0)} * {g}::DOUBLE, 5) AS score FROM test_rows"
                             for g in GATES)


@query("long_gates", with_ctes(_SIGNED, "test_rows"))
def long_gate_table(spark, sf):
    return long_gates(test_rows(spark, sf), ["id"]).withColumn("score", F.round("score", 5))


@query("finite_gates", with_ctes(f"""WITH g AS (SELECT * FROM ({_SIGNED}) UNION ALL
    SELECT id, 'per_extra_line', CASE WHEN n_lines = 1 THEN 'nan'::DOUBLE ELSE spread/(n_lines - 1) END FROM test_rows)
  SELECT gate, count(*) AS n, round(avg(score), 4) AS mean_score FROM g GROUP BY gate HAVING bool_and(isfinite(score))""",
    "test_rows"))
def finite_gates(spark, sf):
    """A gate with one value that is not finite is dropped whole."""
    rows = test_rows(spark, sf).withColumn("per_extra_line", F.when(F.col("n_lines") == 1, F.lit(float("nan"))).otherwise(
        F.col("spread") / F.nullif(F.col("n_lines") - 1, F.lit(0))))
    long = long_gates(rows, ["id"], GATES + ["per_extra_line"]).withColumn("score", F.round("score", 5))
    finite = ~F.isnan("score") & (F.abs("score") < float("inf"))
    return long.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"),
                                    F.bool_and(finite).alias("ok")).filter("ok").drop("ok")


@query("metric_attach", with_ctes("""SELECT role, count(*) AS n, count(d.doc_id) AS n_metric,
    round(avg(CASE WHEN d.doc_id IS NULL THEN 'nan'::DOUBLE ELSE n_chars END) FILTER (WHERE d.doc_id IS NOT NULL), 4) AS mean_metric
  FROM items LEFT JOIN documents d ON d.doc_id = items.id GROUP BY role""", "items"))
def metric_attach(spark, sf):
    """Left join of a metric; a missing metric becomes NaN, which stays apart from NULL."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("metric"))
    rows = items(spark, sf).join(docs, "id", "left").withColumn("metric", F.coalesce("metric", F.lit(float("nan"))))
    there = ~F.isnan("metric")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(there, 1)).alias("n_metric"),
                                    F.round(F.avg(F.when(there, F.col("metric"))), 4).alias("mean_metric"))


@query("align_models", with_ctes("""SELECT id, truth, pred AS pred_lookup, pred2 AS pred_line FROM fact
  WHERE condition = 'clean' AND pred > 0 AND n_lines >= 2""", "fact"))
def align_models(spark, sf):
    """Ids that every model has a prediction for, with the truth; a count per id instead of a join per model."""
    clean = fact(spark, sf).filter("condition = 'clean'")
    lookup = clean.filter("pred > 0").select("id", F.lit("lookup").alias("model"), F.col("pred").alias("p"))
    line = clean.filter("n_lines >= 2").select("id", F.lit("line").alias("model"), F.col("pred2").alias("p"))
    both = lookup.unionByName(line).groupBy("id").agg(
        F.count_distinct("model").alias("m"), F.max(F.when(F.col("model") == "lookup", F.col("p"))).alias("pred_lookup"),
        F.max(F.when(F.col("model") == "line", F.col("p"))).alias("pred_line")).filter("m = 2")
    return both.join(clean.select("id", "truth"), "id").select("id", "truth", "pred_lookup", "pred_line")


@query("model_spread", with_ctes("""SELECT id, round(stddev_pop(p), 4) AS spread FROM
  (SELECT id, pred AS p FROM test_rows UNION ALL SELECT id, pred2 FROM test_rows UNION ALL
   SELECT id, mass_pred FROM test_rows) GROUP BY id""", "test_rows"))
def model_spread(spark, sf):
    """Population sd of several models' predictions for one id, from long predictions."""
    rows = test_rows(spark, sf).select("id", F.explode(F.array("pred", "pred2", "mass_pred")).alias("p"))
    return rows.groupBy("id").agg(F.round(F.stddev_pop("p"), 4).alias("spread"))


@query("per_condition", with_ctes("""SELECT condition, count(*) AS n, round(avg(err), 4) AS mae, round(avg(mass_err), 4) AS mass_mae,
  round(avg(spread), 4) AS mean_spread FROM fact WHERE role = 'test' GROUP BY condition""", "fact"))
def per_condition(spark, sf):
    return fact(spark, sf).filter("role = 'test'").groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("err"), 4).alias("mae"),
        F.round(F.avg("mass_err"), 4).alias("mass_mae"), F.round(F.avg("spread"), 4).alias("mean_spread"))


@query("per_condition_ratio", with_ctes("""WITH m AS (SELECT condition, avg(err) AS e, avg(spread) AS s FROM fact
    WHERE role = 'test' GROUP BY condition)
  SELECT m.condition, round(m.e/c.e, 6) AS err_ratio, round(m.s/c.s, 6) AS spread_ratio
  FROM m JOIN m c ON c.condition = 'clean'""", "fact"))
def per_condition_ratio(spark, sf):
    from pyspark.sql import Window
    m = fact(spark, sf).filter("role = 'test'").groupBy("condition").agg(F.avg("err").alias("e"), F.avg("spread").alias("s"))
    clean = lambda c: F.max(F.when(F.col("condition") == "clean", F.col(c))).over(Window.partitionBy(F.lit(1)))
    return m.select("condition", F.round(F.col("e") / clean("e"), 6).alias("err_ratio"),
                    F.round(F.col("s") / clean("s"), 6).alias("spread_ratio"))


@query("condition_grid", with_ctes("""SELECT condition, count(*) AS n, count(DISTINCT id) AS ids FROM
  (SELECT id, unnest(['clean', 'no_returns', 'closed_only']) AS condition FROM items) GROUP BY condition""", "items"))
def condition_grid(spark, sf):
    """Every id under every condition: the conditions are a short array, so the grid is an explode."""
    from .views import CONDITIONS
    grid = items(spark, sf).select("id", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("condition"))
    return grid.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("normalised_mae", with_ctes("""SELECT round(avg(err), 4) AS mae, round(avg(mass_err), 4) AS mass_mae,
  round(avg(mass_err)/avg(mass_true), 6) AS mass_rel FROM test_rows""", "test_rows"))
def normalised_mae(spark, sf):
    return test_rows(spark, sf).agg(
        F.round(F.avg("err"), 4).alias("mae"), F.round(F.avg("mass_err"), 4).alias("mass_mae"),
        F.round(F.avg("mass_err") / F.avg("mass_true"), 6).alias("mass_rel"))


@query("worst_tenth", with_ctes("""WITH r AS (SELECT *, row_number() OVER (ORDER BY err DESC, id) AS rk, count(*) OVER () AS n FROM test_rows)
  SELECT count(*) FILTER (WHERE rk <= round_even(0.1::DOUBLE*n, 0)) AS k,
    round(avg(err) FILTER (WHERE rk <= round_even(0.1::DOUBLE*n, 0)), 4) AS worst_mean,
    round(sum(err) FILTER (WHERE rk <= round_even(0.1::DOUBLE*n, 0))/sum(err), 6) AS worst_share,
    round(avg((err > 100000)::INT), 6) AS share_over, round(avg(truth), 4) AS mean_truth FROM r""", "test_rows"))
def worst_tenth(spark, sf):
    rows = test_rows(spark, sf).withColumn("_desc", -F.col("err"))
    order = ["_desc", "id"]
    worst = take_at(rows, [], order, coverage_targets([0.1]), {"worst": "err"}, splits=find_splits(rows, [], order))
    whole = rows.agg(F.sum("err").alias("s"), percent_true(F.col("err") > 100000).alias("over"), F.avg("truth").alias("t"))
    return worst.join(whole).select(
        "k", F.round(F.col("worst") / F.col("k"), 4).alias("worst_mean"), F.round(F.col("worst") / F.col("s"), 6).alias("worst_share"),
        F.round("over", 6).alias("share_over"), F.round("t", 4).alias("mean_truth"))


@query("pearson", with_ctes("SELECT round(corr(mass, truth), 8) AS r FROM items", "items"))
def pearson(spark, sf):
    return items(spark, sf).agg(F.round(F.corr("mass", "truth"), 8).alias("r"))


@query("slice_span", with_ctes("""SELECT count(*) FILTER (WHERE mass >= 150 AND mass < 250) AS n,
  min(truth) FILTER (WHERE mass >= 150 AND mass < 250) AS lo, max(truth) FILTER (WHERE mass >= 150 AND mass < 250) AS hi,
  count(*) FILTER (WHERE mass > 150 AND mass < 500 AND n_lines >= 3) AS picks FROM items""", "items"))
def slice_span(spark, sf):
    inside = (F.col("mass") >= 150) & (F.col("mass") < 250)
    pick = (F.col("mass") > 150) & (F.col("mass") < 500) & (F.col("n_lines") >= 3)
    t = F.when(inside, F.col("truth"))
    return items(spark, sf).agg(F.count(t).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"),
                                F.count(F.when(pick, 1)).alias("picks"))


@query("point_lookup", with_ctes("SELECT condition, truth, pred, err, spread FROM fact WHERE id = 1000", "fact"))
def point_lookup(spark, sf):
    """One id under all conditions; the filter is pushed to the scan of the fact."""
    return fact(spark, sf).filter("id = 1000").select("condition", "truth", "pred", "err", "spread")


@query("first_n", with_ctes("SELECT id, cluster, truth FROM items ORDER BY id LIMIT 100", "items"))
def first_n(spark, sf):
    return items(spark, sf).select("id", "cluster", "truth").orderBy("id").limit(100)


cte("cells", "SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY user_id, event_type")


@query("variance_split", with_ctes("""WITH g AS (SELECT avg(v) AS g FROM cells),
    e AS (SELECT user_id, avg(v) - any_value(g) AS e FROM cells, g GROUP BY user_id),
    c AS (SELECT event_type, avg(v) - any_value(g) AS c FROM cells, g GROUP BY event_type),
    a AS (SELECT var_pop(e) AS ve, var_pop(c) AS vc, var_pop(v - g - e - c) AS vr FROM cells JOIN e USING (user_id)
          JOIN c USING (event_type), g)
  SELECT round(100*ve/(ve + vc + vr), 6) AS entity, round(100*vc/(ve + vc + vr), 6) AS condition,
    round(100*vr/(ve + vc + vr), 6) AS rest FROM a""", "cells"))
def variance_shares(spark, sf):
    cells = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    got = variance_split(cells, "user_id", "event_type", "v")
    return got.select(*[F.round(c, 6).alias(c) for c in ("entity", "condition", "rest")])


@query("icc", with_ctes("""WITH g AS (SELECT cluster, count(*) AS n, avg(err) AS m, var_pop(err)*count(*) AS ss FROM fact
      WHERE condition = 'clean' GROUP BY cluster),
    s AS (SELECT count(*) AS k, sum(n) AS nn, sum(n*n) AS n2, sum(ss) AS w, sum(n*m) AS sm, sum(n*m*m) AS q FROM g),
    t AS (SELECT k, nn, (q - sm*sm/nn)/(k - 1) AS b, w/(nn - k) AS w, (nn - n2/nn)/(k - 1) AS n0 FROM s)
  SELECT k AS clusters, nn::BIGINT AS n, round((b - w)/(b + (n0 - 1)*w), 6) AS icc FROM t""", "fact"))
def icc(spark, sf):
    got = intraclass(fact(spark, sf).filter("condition = 'clean'"), "cluster", "err")
    return got.withColumn("icc", F.round("icc", 6))


GAP = 12 * 3600.0


def timeline(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", seconds(F.col("ts")).alias("t"))


cte("timeline", "SELECT user_id, event_id, epoch_us(ts)/1e6 AS t FROM events")
cte("gaps", "SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM timeline", "timeline")


@query("sessionize", with_ctes(f"""SELECT user_id, event_id, sum(coalesce((gap > {GAP})::INT, 0))
    OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM gaps""", "gaps"))
def sessions(spark, sf):
    return sessionize(timeline(spark, sf), "t", "event_id", ["user_id"], GAP).select("user_id", "event_id", "session")


@query("gap_hist", with_ctes("""SELECT least(floor(log10(gap)/(6.5/39))::INT, 38) AS bin, count(*) AS n FROM gaps
  WHERE gap >= 1 AND gap <= pow(10, 6.5) GROUP BY 1""", "gaps"))
def gap_hist(spark, sf):
    return gap_histogram(with_gap(timeline(spark, sf), "t", "event_id", ["user_id"]))


@query("cluster_overlap", f"""WITH r AS (SELECT o_orderkey AS id, o_custkey AS cluster,
    {u("'row-role'", 'o_orderkey')} < 0.25 AS test FROM orders)
  SELECT count(*) AS n_test, count(*) FILTER (WHERE cluster IN (SELECT cluster FROM r WHERE NOT test)) AS n_sharing
  FROM r WHERE test""")
def cluster_overlap(spark, sf):
    """Rows of a row-level test split that share a cluster with the rest: one aggregate per cluster, no join."""
    from demur.functions.draws import uniform
    rows = entities(spark, sf).withColumn("test", uniform("row-role", F.col("id")) < 0.25)
    per = rows.groupBy("cluster").agg(F.count(F.when(F.col("test"), 1)).alias("t"), F.count(F.when(~F.col("test"), 1)).alias("o"))
    return per.agg(F.sum("t").alias("n_test"), F.coalesce(F.sum(F.when(F.col("o") > 0, F.col("t"))), F.lit(0)).alias("n_sharing"))


@query("profile", with_ctes("""WITH v AS (SELECT name, count(DISTINCT id) AS n FROM lines GROUP BY name)
  SELECT role, count(*) AS n, round(avg((mass < 200 AND truth < 400000)::INT), 6) AS usable_share,
    median(n_lines)::DOUBLE AS median_parts, max(n_lines) AS max_parts, count(DISTINCT cluster) AS clusters,
    (SELECT count(*) FROM v) AS vocabulary, (SELECT count(*) FROM v WHERE n >= 20) AS common_names
  FROM items GROUP BY role""", "items", "lines"))
def profile(spark, sf):
    """Counts by split, usable share, parts per item and vocabulary."""
    from demur.operators.ranking import medians
    it = items(spark, sf)
    names = lines(spark, sf).groupBy("name", "id").agg(F.lit(1).alias("one")).groupBy("name").agg(F.count("one").alias("n"))
    v = names.agg(F.count(F.lit(1)).alias("vocabulary"), F.count(F.when(F.col("n") >= 20, 1)).alias("common_names")).first()
    usable = (F.col("mass") < 200) & (F.col("truth") < 400000)
    got = it.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(percent_true(usable), 6).alias("usable_share"),
                                 F.max("n_lines").alias("max_parts"), F.count_distinct("cluster").alias("clusters"))
    med = medians(it.select("role", F.col("n_lines").cast("double").alias("n_lines")), ["role"], "n_lines", "median_parts")
    return got.join(med, "role").withColumns({"vocabulary": F.lit(v["vocabulary"]), "common_names": F.lit(v["common_names"])})


@query("sig6", with_ctes(" UNION ALL ".join(f"""SELECT id, condition, '{c}' AS field, CASE WHEN {c} = 0 THEN 0.0 ELSE
    round_even({c}*pow(10, 5 - floor(log10(abs({c})))), 0)/pow(10, 5 - floor(log10(abs({c})))) END AS v FROM fact"""
    for c in ("truth", "pred", "learned_error")), "fact"))
def sig6(spark, sf):
    """Values at the precision of the text export."""
    cells = [F.struct(F.lit(c).alias("field"), significant(F.col(c)).alias("v")) for c in ("truth", "pred", "learned_error")]
    return fact(spark, sf).select("id", "condition", F.inline(F.array(*cells)))
