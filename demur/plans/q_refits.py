"""Queries: placebo heads, quantile regression and ranges over refits."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.functions.expr import interval_score
from demur.operators import quantreg
from demur.operators.assess import band, edges
from demur.operators.crossfit import fit_heads, out_of_fold, seeded_roles
from demur.operators.evaluate import placebo_summary
from demur.operators.lines import fit_line
from demur.operators.placebo import kept_by_head, placebo_heads
from demur.operators.ranges import ALPHA, calibrate, covered, score_by_bin, score_ranges
from demur.operators.ranking import order_statistic
from demur.operators.splits import cluster_sizes, deal_round_robin
from demur.sources.staging import stage

from .q_crossfit import SEEDS, x_rows
from .q_ranges import USABLE
from .registry import cte, query, u, with_ctes
from .views import calib_rows, test_rows

#: Shuffled heads of each kind, as published.
PLACEBOS = 200

cte("pl_calib", "SELECT id, c.err, spread, n_lines::DOUBLE AS n_lines, len(list_filter(e, lambda x: x <= pred)) AS band FROM calib_rows c, edges10",
    "calib_rows", "edges10")
_PERM = u("'permute'", "placebo", "id")
cte("pl_shuffled", f"""SELECT 'global' AS kind, placebo, a.id, a.spread, a.n_lines, b.err FROM
    (SELECT *, row_number() OVER (PARTITION BY placebo ORDER BY id) AS r FROM pl_calib, range(1, {PLACEBOS + 1}) t(placebo)) a JOIN
    (SELECT placebo, err, row_number() OVER (PARTITION BY placebo ORDER BY {_PERM}, id) AS r FROM pl_calib, range(1, {PLACEBOS + 1}) t(placebo)) b
    USING (placebo, r)
  UNION ALL SELECT 'band', placebo, a.id, a.spread, a.n_lines, b.err FROM
    (SELECT *, row_number() OVER (PARTITION BY placebo, band ORDER BY id) AS r FROM pl_calib, range(1, {PLACEBOS + 1}) t(placebo)) a JOIN
    (SELECT placebo, band, err, row_number() OVER (PARTITION BY placebo, band ORDER BY {_PERM}, id) AS r FROM pl_calib, range(1, {PLACEBOS + 1}) t(placebo)) b
    USING (placebo, band, r)
  UNION ALL SELECT k, 0, id, spread, n_lines, err FROM pl_calib, (SELECT unnest(['global', 'band']) AS k)""", "pl_calib")
cte("pl_heads", """SELECT kind, placebo, ma, mb, my, (ay*bb - sy*ab)/(aa*bb - ab*ab) AS wa, (sy*aa - ay*ab)/(aa*bb - ab*ab) AS wb FROM
  (SELECT kind, placebo, avg(spread) AS ma, avg(n_lines) AS mb, avg(err) AS my, var_pop(spread)*count(*) + 1 AS aa, var_pop(n_lines)*count(*) + 1 AS bb,
    covar_pop(spread, n_lines)*count(*) AS ab, covar_pop(spread, err)*count(*) AS ay, covar_pop(n_lines, err)*count(*) AS sy
   FROM pl_shuffled GROUP BY kind, placebo)""", "pl_shuffled")
cte("pl_effects", """WITH r AS (SELECT kind, placebo, band, err, row_number() OVER w AS rk, count(*) OVER (PARTITION BY kind, placebo, band) AS n,
      sum(err) OVER (w ROWS UNBOUNDED PRECEDING) AS cs FROM (SELECT kind, placebo, id, err, len(list_filter(e, lambda x: x <= pred)) AS band,
        round((spread - ma)*wa + (n_lines - mb)*wb + my, 5) AS score FROM test_rows, edges10, pl_heads)
      WINDOW w AS (PARTITION BY kind, placebo, band ORDER BY score, id))
  SELECT kind, placebo, sum(cs)/sum(rk) - (SELECT avg(err) FROM test_rows) AS effect FROM r
  WHERE rk = greatest(1, round_even(0.9::DOUBLE*n, 0))::BIGINT GROUP BY kind, placebo""", "test_rows", "edges10", "pl_heads")


@query("placebo_test", with_ctes("""SELECT kind, round(any_value(ref), 3) AS real, round(avg(effect), 3) AS mean, round(stddev_samp(effect), 3) AS sd,
    round(quantile_cont(effect, 0.025), 3) AS lo, round(quantile_cont(effect, 0.5), 3) AS median, round(quantile_cont(effect, 0.975), 3) AS hi,
    round((any_value(ref) - avg(effect))/stddev_samp(effect), 4) AS z, round((count(*) FILTER (WHERE effect <= ref) + 1)/(count(*) + 1), 6) AS p
  FROM pl_effects JOIN (SELECT kind, effect AS ref FROM pl_effects WHERE placebo = 0) USING (kind) WHERE placebo > 0 GROUP BY kind""", "pl_effects"))
def placebo_test(spark, sf):
    """The real error head against heads trained on shuffled errors, inside size bands at 90% answered."""
    calib, test = calib_rows(spark, sf), test_rows(spark, sf)
    at = edges(calib, "pred", 10)
    lines = lambda df: df.withColumn("n_lines", F.col("n_lines").cast("double")).withColumn("band", band(F.col("pred"), at))
    base = lines(calib).select("id", "band", "err", "spread", "n_lines")
    heads = stage(placebo_heads(base, PLACEBOS, "spread", "n_lines", "err", 1.0), "heads")
    # Whole numbers of the last digit: heads that keep the same rows have the same effect, whatever the order of the sums.
    rows = lines(test).select("id", "band", "spread", "n_lines", F.rint(F.col("err") * 10_000).cast("bigint").alias("units"))
    kept = kept_by_head(rows, [r.asDict() for r in heads.collect()], "spread", "n_lines", "units", 0.9)
    mean = test.agg(F.avg("err")).first()[0]
    risk = kept.select("kind", "placebo", (F.col("kept") / F.col("k")).alias("risk"))
    got = placebo_summary(risk.select("kind", "placebo", (F.col("risk") / 10_000 - mean).alias("effect")), ["kind"])
    return got.select("kind", *[F.round(c, 3).alias(c) for c in ("real", "mean", "sd", "lo", "median", "hi")],
                      F.round("z", 4).alias("z"), F.round("p", 6).alias("p"))


def quantile_lines(rows, alpha=ALPHA):
    """Lines for the two tails of truth given the out-of-fold prediction."""
    oof = stage(out_of_fold(rows, deal_round_robin(cluster_sizes(rows), 5), "mass", "truth"), "oof")
    return quantreg.fit(oof, "oof", "truth", alpha / 2), quantreg.fit(oof, "oof", "truth", 1 - alpha / 2), oof


# The loss is convex in the slope once the best intercept, an order statistic of the residuals, is put in: a ternary search finds the slope,
# and the two points nearest to the line found give it exactly.
cte("qr_search", """WITH RECURSIVE step(n, tau, lo, hi) AS (
    SELECT 0, tau, -20.0::DOUBLE, 20.0::DOUBLE FROM (VALUES (0.05::DOUBLE), (0.95::DOUBLE)) t(tau) UNION ALL
    SELECT n + 1, tau, CASE WHEN l1 <= l2 THEN lo ELSE m1 END, CASE WHEN l1 <= l2 THEN m2 ELSE hi END FROM (
      SELECT n, tau, lo, hi, m1, m2, max(l) FILTER (side = 1) AS l1, max(l) FILTER (side = 2) AS l2 FROM (
        SELECT n, tau, lo, hi, m1, m2, side, list_sum(list_transform(r, lambda v: greatest(tau*(v - r[c]), (tau - 1)*(v - r[c])))) AS l FROM (
          SELECT n, tau, lo, hi, m1, m2, side, list(truth - b*oof ORDER BY truth - b*oof) AS r, ceil(tau*count(*))::INT AS c FROM (
            SELECT s.*, side, CASE side WHEN 1 THEN m1 ELSE m2 END AS b FROM (SELECT *, lo + (hi - lo)/3 AS m1, hi - (hi - lo)/3 AS m2 FROM step WHERE n < 110) s,
              (VALUES (1), (2)) w(side)), oof_fit GROUP BY n, tau, lo, hi, m1, m2, side)) GROUP BY n, tau, lo, hi, m1, m2))
  SELECT tau, (lo + hi)/2 AS b FROM step WHERE n = 110""", "oof_fit")
cte("qr", """WITH r AS (SELECT tau, oof AS x, truth AS y, truth - b*oof AS r FROM qr_search, oof_fit),
    a AS (SELECT tau, list(r ORDER BY r)[ceil(tau*count(*))::INT] AS a FROM r GROUP BY tau),
    near AS (SELECT tau, x, y, row_number() OVER (PARTITION BY tau ORDER BY d, y) AS place FROM (
      SELECT tau, x, min_by(y, abs(r - a)) AS y, min(abs(r - a)) AS d FROM r JOIN a USING (tau) GROUP BY tau, x))
  SELECT p.tau, (q.y - p.y)/(q.x - p.x) AS b, p.y - (q.y - p.y)/(q.x - p.x)*p.x AS a FROM near p JOIN near q ON q.tau = p.tau AND p.place = 1 AND q.place = 2""",
    "qr_search", "oof_fit")
cte("qr_hat", """SELECT s.*, (mass - mx)*w + my AS yhat, l.a + l.b*((mass - mx)*w + my) AS qlo, h.a + h.b*((mass - mx)*w + my) AS qhi FROM x_all s,
    (SELECT avg(mass) AS mx, avg(truth) AS my, covar_pop(mass, truth)*count(*)/(var_pop(mass)*count(*) + 1) AS w FROM x_all WHERE role = 'fit'),
    (SELECT a, b FROM qr WHERE tau < 0.5) l, (SELECT a, b FROM qr WHERE tau > 0.5) h""", "x_all", "qr")
cte("qr_q", """SELECT model, s AS q FROM (SELECT model, s, row_number() OVER (PARTITION BY model ORDER BY s) AS r,
      least(ceil((count(*) OVER (PARTITION BY model) + 1)*(1 - 0.1::DOUBLE)), count(*) OVER (PARTITION BY model)) AS k FROM
      (SELECT 'cqr' AS model, greatest(qlo - truth, truth - qhi) AS s FROM qr_hat WHERE role = 'calib' UNION ALL
       SELECT 'constant', abs(truth - yhat) FROM qr_hat WHERE role = 'calib')) WHERE r = k""", "qr_hat")
cte("qr_ranges", """SELECT id, truth, model, greatest(0, CASE model WHEN 'cqr' THEN qlo ELSE yhat END - q) AS lo,
    CASE model WHEN 'cqr' THEN qhi ELSE yhat END + q AS hi FROM qr_hat, qr_q WHERE role = 'test'""", "qr_hat", "qr_q")


@query("quantile_reg", with_ctes("""SELECT tau, round(a, 3) AS intercept, round(b, 8) AS slope, round(avg((truth - a - b*oof < -1e-5)::INT), 6) AS share_below,
    round(avg(greatest(tau*(truth - a - b*oof), (tau - 1)*(truth - a - b*oof))), 4) AS loss FROM qr, oof_fit GROUP BY tau, a, b""", "qr", "oof_fit"))
def quantile_reg(spark, sf):
    """The two lines, the share of rows below each and the pinball loss."""
    rows = x_rows(spark, sf).filter("role = 'fit'")
    low, high, oof = quantile_lines(rows)
    out = None
    for tau, (a, b) in ((0.05, low), (0.95, high)):
        r = F.col("truth") - quantreg.line(F.col("oof"), (a, b))
        one = oof.agg(F.avg((r < -1e-5).cast("double")).alias("share_below"), F.avg(F.greatest(tau * r, (tau - 1) * r)).alias("loss")).select(
            F.lit(tau).alias("tau"), F.round(F.lit(a), 3).alias("intercept"), F.round(F.lit(b), 8).alias("slope"),
            F.round("share_below", 6).alias("share_below"), F.round("loss", 4).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


def cqr_ranges(calib, test, low, high, alpha=ALPHA):
    """Quantile lines widened by the conformal quantile of how far calibration truth falls outside them."""
    lo = lambda: quantreg.line(F.col("yhat"), low)
    hi = lambda: quantreg.line(F.col("yhat"), high)
    q = calibrate(calib, F.greatest(lo() - F.col("truth"), F.col("truth") - hi()), alpha).first()["q"]
    return test.withColumns({"lo": F.greatest(F.lit(0.0), lo() - q), "hi": hi() + q})


@query("cqr", with_ctes("SELECT id, truth, round(lo, 3) AS lo, round(hi, 3) AS hi FROM qr_ranges WHERE model = 'cqr'", "qr_ranges"))
def cqr(spark, sf):
    rows = x_rows(spark, sf)
    fit = rows.filter("role = 'fit'")
    low, high, _ = quantile_lines(fit)
    head = fit_line(fit, "mass", "truth", 1.0)
    hat = rows.withColumn("yhat", head.predict(F.col("mass")))
    got = cqr_ranges(hat.filter("role = 'calib'"), hat.filter("role = 'test'"), low, high)
    return got.select("id", "truth", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


@query("cqr_score", with_ctes(f"""WITH e AS (SELECT quantile_cont(truth, [0.25, 0.5, 0.75]) AS e FROM qr_ranges WHERE model = 'cqr'),
    r AS (SELECT *, (truth >= lo AND truth <= hi)::INT AS c, hi - lo AS w, len(list_filter(e, lambda v: v <= truth)) AS bin FROM qr_ranges, e)
  SELECT model, count(*) AS n, round(avg(c), 6) AS coverage, round(avg(w), 3) AS width_mean, round(avg((w <= {USABLE})::INT), 6) AS usable_share,
    round(avg(w + 20*(greatest(lo - truth, 0) + greatest(truth - hi, 0))), 3) AS interval_score, round(median(w), 3) AS width_median, """
    + ", ".join(f"round(avg(c) FILTER (bin = {i}), 6) AS coverage_q{i + 1}" for i in range(4)) + " FROM r GROUP BY model", "qr_ranges"))
def cqr_score(spark, sf):
    """Symmetric and quantile-regression ranges side by side, with coverage by truth quartile."""
    rows = x_rows(spark, sf)
    fit = rows.filter("role = 'fit'")
    low, high, _ = quantile_lines(fit)
    head = fit_line(fit, "mass", "truth", 1.0)
    hat = stage(rows.filter("role <> 'fit'").withColumn("yhat", head.predict(F.col("mass"))), "hat")
    calib, test = hat.filter("role = 'calib'"), hat.filter("role = 'test'")
    q = calibrate(calib, F.abs(F.col("truth") - F.col("yhat"))).first()["q"]
    const = test.withColumns({"lo": F.greatest(F.lit(0.0), F.col("yhat") - q), "hi": F.col("yhat") + q, "model": F.lit("constant")})
    both = const.unionByName(cqr_ranges(calib, test, low, high).withColumn("model", F.lit("cqr")))
    quarter = score_by_bin(both, "truth", edges(test, "truth", 4)).groupBy("model").pivot("bin", [0, 1, 2, 3]).agg(F.first("coverage"))
    quarter = quarter.withColumnsRenamed({str(i): f"coverage_q{i + 1}" for i in range(4)})
    got = score_ranges(both, usable=USABLE).join(quarter, "model")
    return got.select("model", "n", *[F.round(c, 3).alias(c) for c in ("width_mean", "interval_score", "width_median")],
                      *[F.round(c, 6).alias(c) for c in ("coverage", "usable_share", *(f"coverage_q{i}" for i in range(1, 5)))])


def spread_of_measures(ranges, at, digits):
    """Mean, extremes and sd over carves of coverage, width, score and coverage of the outer truth quartiles."""
    c = covered().cast("double")
    per = ranges.groupBy("rep").agg(
        F.avg(c).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"),
        F.avg(interval_score(F.col("truth"), F.col("lo"), F.col("hi"), ALPHA)).alias("interval_score"),
        F.avg(F.when(F.col("truth") >= at[2], c)).alias("largest"), F.avg(F.when(F.col("truth") < at[0], c)).alias("smallest"))
    long = per.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v"))
                                         for m in ("coverage", "width", "interval_score", "largest", "smallest")])))
    return long.groupBy("measure").agg(F.round(F.avg("v"), digits).alias("mean"), F.round(F.min("v"), digits).alias("lowest"),
                                       F.round(F.max("v"), digits).alias("highest"), F.round(F.stddev_samp("v"), digits).alias("sd"))


cte("rr_ranges", """SELECT t.rep, t.truth, greatest(0, t.pred - q) AS lo, t.pred + q AS hi FROM rf_test t JOIN
  (SELECT rep, err AS q FROM (SELECT rep, err, row_number() OVER (PARTITION BY rep ORDER BY err) AS r,
     least(ceil((count(*) OVER (PARTITION BY rep) + 1)*(1 - 0.1::DOUBLE)), count(*) OVER (PARTITION BY rep)) AS k FROM rf_calib) WHERE r = k) USING (rep)""",
    "rf_test", "rf_calib")
_C = "(truth >= lo AND truth <= hi)::INT"


@query("range_refits", with_ctes(f"""WITH e AS (SELECT quantile_cont(truth, [0.25, 0.5, 0.75]) AS e FROM x_test),
    s AS (SELECT rep, avg({_C}) AS coverage, avg(hi - lo) AS width, avg(hi - lo + 20*(greatest(lo - truth, 0) + greatest(truth - hi, 0))) AS interval_score,
      avg({_C}) FILTER (WHERE truth >= e[3]) AS largest, avg({_C}) FILTER (WHERE truth < e[1]) AS smallest FROM rr_ranges, e GROUP BY rep),
    l AS ({" UNION ALL ".join(f"SELECT '{c}' AS measure, {c} AS v FROM s" for c in ("coverage", "width", "interval_score", "largest", "smallest"))})
  SELECT measure, round(avg(v), 4) AS mean, round(min(v), 4) AS lowest, round(max(v), 4) AS highest, round(stddev_samp(v), 4) AS sd FROM l GROUP BY measure""",
    "rr_ranges", "x_test"))
def range_refits(spark, sf):
    """Same-width ranges refit over calibration carves: mean, extremes and sd of every measure."""
    rows = x_rows(spark, sf)
    pool, test = rows.filter("role <> 'test'"), rows.filter("role = 'test'")
    roles = stage(seeded_roles(cluster_sizes(pool), SEEDS), "roles")
    heads = stage(fit_heads(pool, roles, ["rep"], "mass", "truth", "spread", bands=[]), "heads")
    hat = lambda df: df.withColumn("pred", (F.col("mass") - F.col("mx")) * F.col("w") + F.col("my"))
    calib = hat(pool.join(roles.filter("calib"), "cluster").join(F.broadcast(heads), "rep")).select(
        "rep", F.abs(F.col("pred") - F.col("truth")).alias("err"))
    q = order_statistic(calib, ["rep"], "err", ALPHA).select("rep", "q")
    at = edges(test, "truth", 4)
    params = F.broadcast(heads.join(q, "rep"))
    each = test.withColumn("rep", F.explode(F.array(*[F.lit(i) for i in range(len(SEEDS))]))).join(params, "rep")
    ranges = hat(each).withColumn("lo", F.greatest(F.lit(0.0), F.col("pred") - F.col("q"))).withColumn("hi", F.col("pred") + F.col("q"))
    return spread_of_measures(ranges, at, 4)


# Quantile lines of every carve: out-of-fold inside the fit clusters, then the same search as for one fit, with the carve as a key.
cte("rq_folds", f"""SELECT rep, cluster, (row_number() OVER (PARTITION BY rep ORDER BY {u("'robin'", '760', 'cluster')}, cluster) - 1) % 5 AS fold
  FROM rf_roles WHERE NOT calib""", "rf_roles")
cte("rq_oof", """WITH r AS (SELECT rep, fold, mass, truth FROM x_pool JOIN rq_folds USING (cluster)),
    h AS (SELECT o.rep, o.fold, avg(mass) AS mx, avg(truth) AS my, covar_pop(mass, truth)*count(*)/(var_pop(mass)*count(*) + 1) AS w
      FROM (SELECT DISTINCT rep, fold FROM rq_folds) o JOIN r ON r.rep = o.rep AND r.fold <> o.fold GROUP BY o.rep, o.fold)
  SELECT rep, truth, (mass - mx)*w + my AS oof FROM r JOIN h USING (rep, fold)""", "x_pool", "rq_folds")
cte("rq_search", """WITH RECURSIVE step(n, rep, tau, lo, hi) AS (
    SELECT 0, rep, tau, -20.0::DOUBLE, 20.0::DOUBLE FROM (VALUES (0.05::DOUBLE), (0.95::DOUBLE)) t(tau), (SELECT DISTINCT rep FROM rq_oof) UNION ALL
    SELECT n + 1, rep, tau, CASE WHEN l1 <= l2 THEN lo ELSE m1 END, CASE WHEN l1 <= l2 THEN m2 ELSE hi END FROM (
      SELECT n, rep, tau, lo, hi, m1, m2, max(l) FILTER (side = 1) AS l1, max(l) FILTER (side = 2) AS l2 FROM (
        SELECT n, rep, tau, lo, hi, m1, m2, side, list_sum(list_transform(r, lambda v: greatest(tau*(v - r[c]), (tau - 1)*(v - r[c])))) AS l FROM (
          SELECT n, s.rep, tau, lo, hi, m1, m2, side, list(truth - b*oof ORDER BY truth - b*oof) AS r, ceil(tau*count(*))::INT AS c FROM (
            SELECT s.*, side, CASE side WHEN 1 THEN m1 ELSE m2 END AS b FROM (SELECT *, lo + (hi - lo)/3 AS m1, hi - (hi - lo)/3 AS m2 FROM step WHERE n < 90) s,
              (VALUES (1), (2)) w(side)) s JOIN rq_oof o ON o.rep = s.rep GROUP BY n, s.rep, tau, lo, hi, m1, m2, side)) GROUP BY n, rep, tau, lo, hi, m1, m2))
  SELECT rep, tau, (lo + hi)/2 AS b FROM step WHERE n = 90""", "rq_oof")
cte("rq", """WITH r AS (SELECT rep, tau, oof AS x, truth AS y, truth - b*oof AS r FROM rq_search JOIN rq_oof USING (rep)),
    a AS (SELECT rep, tau, list(r ORDER BY r)[ceil(tau*count(*))::INT] AS a FROM r GROUP BY rep, tau),
    near AS (SELECT rep, tau, x, y, row_number() OVER (PARTITION BY rep, tau ORDER BY d, y) AS place FROM (
      SELECT rep, tau, x, min_by(y, abs(r - a)) AS y, min(abs(r - a)) AS d FROM r JOIN a USING (rep, tau) GROUP BY rep, tau, x))
  SELECT p.rep, p.tau, (q.y - p.y)/(q.x - p.x) AS b, p.y - (q.y - p.y)/(q.x - p.x)*p.x AS a FROM near p JOIN near q
    ON q.rep = p.rep AND q.tau = p.tau AND p.place = 1 AND q.place = 2""", "rq_search", "rq_oof")
cte("rq_hat", """SELECT s.*, l.a + l.b*s.pred AS qlo, h.a + h.b*s.pred AS qhi FROM (
    SELECT rep, 'calib' AS role, truth, (mass - mx)*w + my AS pred FROM x_pool JOIN rf_roles USING (cluster) JOIN rf_main USING (rep) WHERE calib
    UNION ALL SELECT rep, 'test', truth, (mass - mx)*w + my FROM x_test, rf_main) s
  JOIN rq l ON l.rep = s.rep AND l.tau < 0.5 JOIN rq h ON h.rep = s.rep AND h.tau > 0.5""", "x_pool", "x_test", "rf_roles", "rf_main", "rq")
cte("rq_ranges", """SELECT t.rep, truth, greatest(0, qlo - q) AS lo, qhi + q AS hi FROM rq_hat t JOIN
  (SELECT rep, s AS q FROM (SELECT rep, s, row_number() OVER (PARTITION BY rep ORDER BY s) AS r,
     least(ceil((count(*) OVER (PARTITION BY rep) + 1)*(1 - 0.1::DOUBLE)), count(*) OVER (PARTITION BY rep)) AS k
     FROM (SELECT rep, greatest(qlo - truth, truth - qhi) AS s FROM rq_hat WHERE role = 'calib')) WHERE r = k) USING (rep) WHERE role = 'test'""", "rq_hat")


def carve_lines(rows, roles, alpha=ALPHA):
    """Quantile lines of both tails for every carve, fitted together: columns rep, la, lb, ha, hb."""
    fit = roles.filter(~F.col("calib")).select("rep", "cluster")
    robin = stage(deal_round_robin(fit.withColumn("size", F.lit(1)), 5, by=["rep"]), "robin")
    oof = out_of_fold(rows.select("cluster", "mass", "truth"), robin, "mass", "truth", keys=["rep"])
    got = quantreg.fit_groups(oof, ["rep"], "oof", "truth", [alpha / 2, 1 - alpha / 2])
    low = got.filter("tau < 0.5").select("rep", F.col("a").alias("la"), F.col("b").alias("lb"))
    return low.join(got.filter("tau > 0.5").select("rep", F.col("a").alias("ha"), F.col("b").alias("hb")), "rep")


@query("cqr_refits", with_ctes(f"""WITH e AS (SELECT quantile_cont(truth, [0.25, 0.5, 0.75]) AS e FROM x_test),
    s AS (SELECT rep, avg({_C}) AS coverage, avg(hi - lo) AS width, avg(hi - lo + 20*(greatest(lo - truth, 0) + greatest(truth - hi, 0))) AS interval_score,
      avg({_C}) FILTER (WHERE truth >= e[3]) AS largest, avg({_C}) FILTER (WHERE truth < e[1]) AS smallest FROM rq_ranges, e GROUP BY rep),
    l AS ({" UNION ALL ".join(f"SELECT '{c}' AS measure, {c} AS v FROM s" for c in ("coverage", "width", "interval_score", "largest", "smallest"))})
  SELECT measure, round(avg(v), 3) AS mean, round(min(v), 3) AS lowest, round(max(v), 3) AS highest, round(stddev_samp(v), 3) AS sd FROM l GROUP BY measure""",
    "rq_ranges", "x_test"))
def cqr_refits(spark, sf):
    """Quantile-regression ranges refit over calibration carves: the lines of all carves are fitted together."""
    rows = x_rows(spark, sf)
    pool, test = rows.filter("role <> 'test'"), rows.filter("role = 'test'")
    roles = stage(seeded_roles(cluster_sizes(pool), SEEDS), "roles")
    heads = fit_heads(pool, roles, ["rep"], "mass", "truth", "spread", bands=[]).select("rep", "mx", "my", "w")
    params = stage(heads.join(carve_lines(pool, roles), "rep"), "heads")
    pred = (F.col("mass") - F.col("mx")) * F.col("w") + F.col("my")
    lines = lambda df: df.withColumn("pred", pred).withColumns({"qlo": F.col("la") + F.col("lb") * F.col("pred"), "qhi": F.col("ha") + F.col("hb") * F.col("pred")})
    calib = lines(pool.join(roles.filter("calib"), "cluster").join(F.broadcast(params), "rep"))
    q = calibrate(calib, F.greatest(F.col("qlo") - F.col("truth"), F.col("truth") - F.col("qhi")), by=["rep"])
    at = edges(test, "truth", 4)
    each = lines(test.withColumn("rep", F.explode(F.array(*[F.lit(i) for i in range(len(SEEDS))]))).join(F.broadcast(params.join(q, "rep")), "rep"))
    ranges = each.withColumn("lo", F.greatest(F.lit(0.0), F.col("qlo") - F.col("q"))).withColumn("hi", F.col("qhi") + F.col("q"))
    return spread_of_measures(ranges, at, 3)
