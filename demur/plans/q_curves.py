"""Queries: risk-coverage curves and what is read off them."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.operators.assess import auc, band, edges, selectivity, spearman
from demur.operators.curves import (COVERAGES, DENSE, aurc, curve, gap_share, pivot_reference, random_curve,
                                    with_perfect)
from demur.operators.ranking import running

from .registry import cte, query, with_ctes
from .views import GATES, calib_rows, fact, long_gates, test_long, test_rows

BIG, SMALL = 300_000.0, 50_000.0


def cov_list(values) -> str:
    return "(SELECT unnest([" + ",".join(f"{c}::DOUBLE" for c in values) + "]) AS coverage)"


cte("gate_rows", """SELECT gate, id, cluster, truth, pred, err, score FROM test_long
  UNION ALL SELECT 'perfect', id, cluster, truth, pred, err, err FROM test_rows""", "test_long", "test_rows")
cte("gate_ranked", """SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY gate) AS n,
  sum(err) OVER (w ROWS UNBOUNDED PRECEDING) AS cs FROM gate_rows WINDOW w AS (PARTITION BY gate ORDER BY score, id)""",
    "gate_rows")


def curve_sql(coverages) -> str:
    return f"""SELECT gate, coverage, rk AS k, cs/rk AS risk FROM gate_ranked JOIN {cov_list(coverages)}
      ON rk = greatest(1, round_even(coverage*n, 0))::BIGINT
    UNION ALL SELECT 'random', coverage, greatest(1, round_even(coverage*n, 0))::BIGINT, m
      FROM (SELECT avg(err) AS m, count(*) AS n FROM test_rows), {cov_list(coverages)}"""


cte("curve", curve_sql(COVERAGES), "gate_ranked", "test_rows")
cte("curve_dense", curve_sql(DENSE), "gate_ranked", "test_rows")


def all_curves(spark, sf, coverages=COVERAGES):
    rows = test_long(spark, sf)
    return curve(with_perfect(rows, GATES[0]), coverages=coverages).unionByName(
        random_curve(test_rows(spark, sf), coverages=coverages))


def rounded(df, col="risk", digits=4):
    return df.withColumn(col, F.round(col, digits))


@query("risk_coverage", with_ctes(
    "SELECT gate, coverage, k, round(risk, 4) AS risk FROM curve", "curve"))
def risk_coverage(spark, sf):
    return rounded(all_curves(spark, sf))


@query("risk_coverage_dense", with_ctes(
    "SELECT gate, coverage, k, round(risk, 4) AS risk FROM curve_dense", "curve_dense"))
def risk_coverage_dense(spark, sf):
    return rounded(all_curves(spark, sf, DENSE))


cte("edges10", "SELECT quantile_cont(pred, [i/10.0 for i in range(1, 10)]) AS e FROM calib_rows".replace(
    "[i/10.0 for i in range(1, 10)]", "[" + ",".join(str(i / 10) for i in range(1, 10)) + "]"), "calib_rows")
cte("banded_rows", """SELECT g.*, len(list_filter(e, lambda x: x <= pred)) AS band FROM gate_rows g, edges10""",
    "gate_rows", "edges10")
cte("banded_curve", f"""WITH r AS (SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY gate, band) AS n,
    sum(err) OVER (w ROWS UNBOUNDED PRECEDING) AS cs FROM banded_rows
    WINDOW w AS (PARTITION BY gate, band ORDER BY score, id))
  SELECT gate, coverage, sum(rk) AS k, sum(cs)/sum(rk) AS risk FROM r JOIN {cov_list(COVERAGES)}
    ON rk = greatest(1, round_even(coverage*n, 0))::BIGINT GROUP BY gate, coverage""", "banded_rows")


def banded_rows(spark, sf, bands=10):
    at = edges(calib_rows(spark, sf), "pred", bands)
    return with_perfect(test_long(spark, sf), GATES[0]).withColumn("band", band(F.col("pred"), at))


@query("banded_curve", with_ctes(
    "SELECT gate, coverage, k::BIGINT AS k, round(risk, 4) AS risk FROM banded_curve", "banded_curve"))
def banded_curve(spark, sf):
    return rounded(curve(banded_rows(spark, sf), strata=["band"]))


@query("size_bands", with_ctes(
    """SELECT len(list_filter(e, lambda x: x <= pred)) AS band, count(*) AS n, round(min(pred), 4) AS lo,
       round(max(pred), 4) AS hi FROM test_rows, edges10 GROUP BY 1""", "test_rows", "edges10"))
def size_bands(spark, sf):
    at = edges(calib_rows(spark, sf), "pred", 10)
    return test_rows(spark, sf).groupBy(band(F.col("pred"), at).cast("bigint").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("pred"), 4).alias("lo"), F.round(F.max("pred"), 4).alias("hi"))


cte("aurc", """SELECT gate, sum((coverage - pc)*(risk + pr)/2) / (max(coverage) - min(coverage)) AS aurc
  FROM (SELECT *, lag(coverage) OVER w AS pc, lag(risk) OVER w AS pr FROM curve
        WINDOW w AS (PARTITION BY gate ORDER BY coverage)) GROUP BY gate""", "curve")


@query("aurc", with_ctes("SELECT gate, round(aurc, 4) AS aurc FROM aurc ORDER BY aurc, gate", "aurc"))
def aurc_table(spark, sf):
    return aurc(all_curves(spark, sf)).select("gate", F.round("aurc", 4).alias("aurc")).orderBy("aurc", "gate")


@query("gap_share", with_ctes("""SELECT a.gate, round((r.aurc - a.aurc)/(r.aurc - p.aurc), 6) AS gap_share,
    round((rr.risk - c.risk)/(rr.risk - pp.risk), 6) AS saving_share_90
  FROM aurc a JOIN aurc r ON r.gate = 'random' JOIN aurc p ON p.gate = 'perfect'
  JOIN curve c ON c.gate = a.gate AND c.coverage = 0.9
  JOIN curve rr ON rr.gate = 'random' AND rr.coverage = 0.9
  JOIN curve pp ON pp.gate = 'perfect' AND pp.coverage = 0.9""", "aurc", "curve"))
def gap_share_table(spark, sf):
    curves = all_curves(spark, sf)
    area = pivot_reference(aurc(curves), "aurc", []).select("gate", F.round(gap_share("aurc"), 6).alias("gap_share"))
    at90 = pivot_reference(curves.filter("coverage = 0.9"), "risk", ["coverage"]).select(
        "gate", F.round(gap_share("risk"), 6).alias("saving_share_90"))
    return area.join(at90, "gate")


@query("gap_share_point", with_ctes("""SELECT c.gate, round(max((r.risk - c.risk)/(r.risk - p.risk)), 6) AS best_share
  FROM curve c JOIN curve r ON r.gate = 'random' AND r.coverage = c.coverage
  JOIN curve p ON p.gate = 'perfect' AND p.coverage = c.coverage
  WHERE c.coverage < 1.0 AND c.gate NOT IN ('random', 'perfect') GROUP BY c.gate""", "curve"))
def gap_share_point(spark, sf):
    """Largest share of the gap a gate closes at any single coverage below 1."""
    at = pivot_reference(all_curves(spark, sf).filter("coverage < 1.0"), "risk", ["coverage"])
    return at.filter(~F.col("gate").isin("random", "perfect")).groupBy("gate").agg(
        F.round(F.max(gap_share("risk")), 6).alias("best_share"))


SELECTIVITY_SQL = f"""WITH k AS (SELECT *, greatest(1, round_even(coverage*n, 0))::BIGINT AS k
    FROM gate_ranked, {cov_list([0.9, 0.5])})
  SELECT gate, coverage, round(avg(truth) FILTER (WHERE rk <= k), 4) AS kept_mean,
    round(count(*) FILTER (WHERE rk > k AND truth > {BIG}) / greatest(count(*) FILTER (WHERE truth > {BIG}), 1), 6) AS big_refused,
    round(count(*) FILTER (WHERE rk > k AND truth < {SMALL}) / greatest(count(*) FILTER (WHERE truth < {SMALL}), 1), 6) AS small_refused
  FROM k GROUP BY gate, coverage
  UNION ALL SELECT 'random', coverage, (SELECT round(avg(truth), 4) FROM test_rows), round(1 - coverage, 6), round(1 - coverage, 6)
  FROM {cov_list([0.9, 0.5])}"""


@query("selectivity", with_ctes(SELECTIVITY_SQL, "gate_ranked", "test_rows"))
def selectivity_table(spark, sf):
    sel = selectivity(with_perfect(test_long(spark, sf), GATES[0]), ["gate"], big=BIG, small=SMALL)
    flat = test_rows(spark, sf).agg(F.avg("truth").alias("kept_mean")).select(
        F.lit("random").alias("gate"), F.explode(F.array(F.lit(0.9), F.lit(0.5))).alias("coverage"), "kept_mean")
    flat = flat.withColumn("big_refused", 1 - F.col("coverage")).withColumn("small_refused", 1 - F.col("coverage"))
    both = sel.unionByName(flat)
    return both.select("gate", "coverage", F.round("kept_mean", 4).alias("kept_mean"),
                       F.round("big_refused", 6).alias("big_refused"), F.round("small_refused", 6).alias("small_refused"))


@query("global_prefix", with_ctes("""SELECT id, row_number() OVER w AS rank,
    round(sum(err) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running_err FROM fact WHERE condition = 'clean'
    WINDOW w AS (ORDER BY pred, id)""", "fact"))
def global_prefix(spark, sf):
    # Errors have four digits, so whole numbers of the last one add up exactly; sums of doubles go wrong there after some 100,000 rows.
    rows = fact(spark, sf).filter("condition = 'clean'").select("id", "pred", F.rint(F.col("err") * 10_000).cast("bigint").alias("units"))
    out = running(rows, ["pred", "id"], sums={"running_units": "units"})
    return out.select("id", "rank", F.round(F.col("running_units") / 10_000, 4).alias("running_err"))


SPEARMAN_SQL = """WITH r AS (SELECT gate, row_number() OVER (PARTITION BY gate ORDER BY score, id) AS a,
    row_number() OVER (PARTITION BY gate ORDER BY err, id) AS b FROM gate_rows)
  SELECT gate, round(corr(a, b), 6) AS rho FROM r GROUP BY gate"""


@query("spearman", with_ctes(SPEARMAN_SQL, "gate_rows"))
def spearman_table(spark, sf):
    return rounded(spearman(with_perfect(test_long(spark, sf), GATES[0]), ["gate"], "score", "err"), "rho", 6)


WITHIN_SQL = """WITH q AS (SELECT quantile_cont(pred, [0.25, 0.5, 0.75]) AS e FROM test_rows),
  b AS (SELECT g.*, len(list_filter(e, lambda x: x <= pred)) AS quarter FROM gate_rows g, q),
  w AS (SELECT gate, quarter, row_number() OVER (PARTITION BY gate, quarter ORDER BY score, id) AS a,
     row_number() OVER (PARTITION BY gate, quarter ORDER BY err, id) AS c FROM b),
  s AS (SELECT gate, row_number() OVER (PARTITION BY gate ORDER BY score, id) AS a,
     row_number() OVER (PARTITION BY gate ORDER BY pred, id) AS c FROM b)
  SELECT gate, round(avg(r), 6) AS rho_within_size, any_value(round(z, 6)) AS rho_size FROM
    (SELECT gate, corr(a, c) AS r FROM w GROUP BY gate, quarter)
    JOIN (SELECT gate, corr(a, c) AS z FROM s GROUP BY gate) USING (gate) GROUP BY gate"""


@query("spearman_within", with_ctes(WITHIN_SQL,
    "gate_rows", "test_rows"))
def spearman_within(spark, sf):
    at = edges(test_rows(spark, sf), "pred", 4)
    rows = with_perfect(test_long(spark, sf), GATES[0]).withColumn("quarter", band(F.col("pred"), at))
    within = spearman(rows, ["gate", "quarter"], "score", "err").groupBy("gate").agg(
        F.round(F.avg("rho"), 6).alias("rho_within_size"))
    size = spearman(rows, ["gate"], "score", "pred").select("gate", F.round("rho", 6).alias("rho_size"))
    return within.join(size, "gate")


_SIGNALS = ["pred", "n_lines", "spread", "mass"]


@query("auc_vs_clean", with_ctes(" UNION ALL ".join(f"""SELECT condition, '{m}' AS signal,
    round(greatest(a, 1 - a), 6) AS auc FROM (SELECT condition,
      (sum(mid) FILTER (WHERE pos) - np*(np + 1)/2) / (np*nn) AS a FROM
      (SELECT condition, pos, rank() OVER w + (count(*) OVER (PARTITION BY condition, v) - 1)/2.0 AS mid,
         count(*) FILTER (WHERE pos) OVER (PARTITION BY condition) AS np,
         count(*) FILTER (WHERE NOT pos) OVER (PARTITION BY condition) AS nn FROM
         (SELECT d.condition, true AS pos, d.{m}::DOUBLE AS v FROM fact d JOIN fact c ON c.id = d.id
            WHERE d.condition <> 'clean' AND c.condition = 'clean'
          UNION ALL SELECT d.condition, false, c.{m}::DOUBLE FROM fact d JOIN fact c ON c.id = d.id
            WHERE d.condition <> 'clean' AND c.condition = 'clean')
         WINDOW w AS (PARTITION BY condition ORDER BY v)) GROUP BY condition, np, nn)""" for m in _SIGNALS), "fact"))
def auc_vs_clean(spark, sf):
    """Can a signal tell a degraded row from the clean row of the same id?"""
    rows = fact(spark, sf)
    clean = rows.filter("condition = 'clean'").select("id", *[F.col(s).alias(f"c_{s}") for s in _SIGNALS])
    paired = rows.filter("condition <> 'clean'").join(clean, "id")
    cells = [F.struct(F.lit(s).alias("signal"), F.lit(p).alias("pos"), F.col(c).cast("double").alias("v"))
             for s in _SIGNALS for p, c in ((True, s), (False, f"c_{s}"))]
    long = paired.select("condition", F.inline(F.array(*cells)))
    got = auc(long, ["condition", "signal"], "v", "pos")
    return got.select("condition", "signal", F.round(F.greatest("auc", 1 - F.col("auc")), 6).alias("auc"))


@query("error_sources", with_ctes(f"""WITH g AS (SELECT id, condition, err, 'spread' AS gate, -spread AS score FROM fact
      UNION ALL SELECT id, condition, err, 'pred_magnitude', pred FROM fact
      UNION ALL SELECT id, condition, err, 'perfect', err FROM fact),
    v AS (SELECT 'pooled' AS view, * FROM g UNION ALL SELECT 'within ' || condition, * FROM g),
    r AS (SELECT view, gate, row_number() OVER w AS rk, sum(err) OVER (w ROWS UNBOUNDED PRECEDING) AS cs,
      count(*) OVER (PARTITION BY view, gate) AS n FROM v
      WINDOW w AS (PARTITION BY view, gate ORDER BY score, id, condition))
  SELECT view, gate, coverage, round(cs/rk, 4) AS risk FROM r JOIN {cov_list([1.0, 0.5, 0.25])}
    ON rk = greatest(1, round_even(coverage*n, 0))::BIGINT
  UNION ALL SELECT view, 'random', coverage, round(avg(err), 4) FROM v, {cov_list([1.0, 0.5, 0.25])}
    WHERE gate = 'perfect' GROUP BY view, coverage""", "fact"))
def error_sources(spark, sf):
    """Curves over all conditions pooled and inside each condition; the clean view is one of those."""
    cov = [1.0, 0.5, 0.25]
    rows = fact(spark, sf).withColumn("key", F.struct("id", "condition")).withColumn(
        "view", F.explode(F.array(F.lit("pooled"), F.concat(F.lit("within "), F.col("condition")))))
    long = with_perfect(long_gates(rows, ["view", "key", "err"], ["spread", "pred_magnitude"]), "spread")
    curves = curve(long, by=["view", "gate"], ident="key", coverages=cov)
    flat = random_curve(rows, by=["view"], coverages=cov)
    return rounded(curves.unionByName(flat)).drop("k")
