"""Queries: cluster bootstrap, intervals, paired tests and evaluation blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.functions.expr import stars
from demur.operators.assess import band, edges
from demur.operators.curves import COVERAGES, gap_share, pivot_reference, with_perfect
from demur.operators.draws import draws
from demur.operators.evaluate import against, drawn_curves, holm, pair_differences, replicated_aurc, summarise_difference
from demur.operators.resample import (interval, mean_interval, multiplicities, replicate_spearman)
from demur.sources.staging import stage_once

from .q_curves import SELECTIVITY_SQL, SPEARMAN_SQL, WITHIN_SQL, cov_list, selectivity_table, spearman_table, spearman_within
from .registry import cte, query, u, with_ctes
from .views import GATES, MODEL_GATES, calib_rows, fact, long_gates, test_rows

#: Resamples, as published.
B = 2000
OPS = [0.9, 0.5]
#: Differences within this share of the reference are ties, so that the sums of two engines agree on the sign.
NOISE = 1e-9

cte("test_clusters", """SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS ord, count(*) OVER () AS c
  FROM (SELECT DISTINCT cluster FROM test_rows)""", "test_rows")
cte("mult", f"""SELECT b::INT AS b, cluster, count(*) AS m FROM
  (SELECT b, floor({u("'boot'", '760', 'b', 'j')} * c)::BIGINT AS ord FROM range(1, {B + 1}) t(b),
     (SELECT c, unnest(range(c)) AS j FROM (SELECT any_value(c) AS c FROM test_clusters))) d
  JOIN test_clusters USING (ord) GROUP BY b, cluster""", "test_clusters")
cte("mult0", "SELECT * FROM mult UNION ALL SELECT 0, cluster, 1 FROM test_clusters", "mult", "test_clusters")


def mult(spark, sf):
    return multiplicities(test_rows(spark, sf).select("cluster"), B)


def drawn(spark, sf, with_point=False, replicates=B):
    return draws(test_rows(spark, sf), replicates, with_point=with_point)


def gate_rows(spark, sf, numbers):
    """Gates and the perfect refuser, with the number of each row's cluster."""
    return with_perfect(long_gates(numbers.number(test_rows(spark, sf)), ["id", "ord", "err"]), GATES[0])


@query("cluster_bootstrap", with_ctes("SELECT b, cluster, m FROM mult", "mult"))
def cluster_bootstrap(spark, sf):
    return mult(spark, sf)


@query("cluster_ci", with_ctes("""WITH r AS (SELECT b, sum(m*err)/sum(m) AS v FROM test_rows JOIN mult USING (cluster) GROUP BY b)
  SELECT (SELECT round(avg(err), 4) FROM test_rows) AS mean, round(quantile_cont(v, 0.025), 4) AS lo,
    round(quantile_cont(v, 0.975), 4) AS hi FROM r""", "mult", "test_rows"))
def cluster_ci(spark, sf):
    rows = test_rows(spark, sf)
    ci = mean_interval(rows, drawn(spark, sf), F.col("err"))
    mean = rows.agg(F.avg("err").alias("mean"))
    return mean.join(ci).select(F.round("mean", 4).alias("mean"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("subgroup_ci", with_ctes("""WITH e AS (SELECT quantile_cont(truth, 0.75) AS e FROM test_rows),
    r AS (SELECT b, sum(m*(err <= 50000)::INT)/sum(m) AS v FROM test_rows JOIN mult USING (cluster), e WHERE truth >= e GROUP BY b)
  SELECT round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM r""", "mult", "test_rows"))
def subgroup_ci(spark, sf):
    """Interval of a share inside the largest quarter by truth."""
    rows = test_rows(spark, sf)
    top = edges(rows, "truth", 4)[-1]
    ci = mean_interval(rows, drawn(spark, sf), (F.col("err") <= 50000).cast("double"), member=F.col("truth") >= top)
    return ci.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


# Copies are weights: the running weight stands for the rank, and the last row before a wanted rank counts in part.
cte("boot_ranked", """SELECT b, gate, err, sum(m) OVER w AS rk, sum(m*err) OVER w AS cs FROM gate_rows JOIN mult0 USING (cluster)
  WINDOW w AS (PARTITION BY b, gate ORDER BY score, id ROWS UNBOUNDED PRECEDING)""", "gate_rows", "mult0")
cte("boot_wanted", f"""SELECT b, gate, coverage, greatest(1, round_even(coverage*n, 0))::BIGINT AS k FROM
  (SELECT b, gate, max(rk) AS n FROM boot_ranked GROUP BY b, gate), {cov_list(COVERAGES)}""", "boot_ranked")
cte("boot_random", """SELECT b, sum(m*err)/sum(m) AS risk FROM test_rows JOIN mult0 USING (cluster) GROUP BY b""",
    "test_rows", "mult0")
cte("boot_curve", f"""SELECT w.b, w.gate, coverage, (cs - (rk - k)*err)/k AS risk FROM boot_wanted w ASOF JOIN boot_ranked r
    ON r.b = w.b AND r.gate = w.gate AND w.k <= r.rk
  UNION ALL SELECT b, 'random', coverage, risk FROM boot_random, {cov_list(COVERAGES)}""", "boot_ranked", "boot_wanted", "boot_random")
cte("boot_aurc", """SELECT b, gate, sum((coverage - pc)*(risk + pr)/2)/(max(coverage) - min(coverage)) AS aurc
  FROM (SELECT *, lag(coverage) OVER w AS pc, lag(risk) OVER w AS pr FROM boot_curve
        WINDOW w AS (PARTITION BY b, gate ORDER BY coverage)) GROUP BY b, gate""", "boot_curve")


def boot_curves(spark, sf, replicates=B):
    """The curves of all replicates, once per application: seven queries read them."""
    def build():
        numbers = drawn(spark, sf, with_point=True, replicates=replicates)
        return drawn_curves(gate_rows(spark, sf, numbers), numbers, like=GATES[0])
    return stage_once(spark, f"{sf}:boot{replicates}", build, sf)


@query("curve_bootstrap", with_ctes("""SELECT gate, coverage, round(max(risk) FILTER (WHERE b = 0), 4) AS risk,
    round(quantile_cont(risk, 0.025) FILTER (WHERE b > 0), 4) AS lo,
    round(quantile_cont(risk, 0.975) FILTER (WHERE b > 0), 4) AS hi FROM boot_curve GROUP BY gate, coverage""", "boot_curve"))
def curve_bootstrap(spark, sf):
    c = boot_curves(spark, sf).withColumn("_r", F.when(F.col("b") > 0, F.col("risk")))
    got = c.groupBy("gate", "coverage").agg(
        F.max(F.when(F.col("b") == 0, F.col("risk"))).alias("risk"), *interval("_r"))
    return got.select("gate", "coverage", *[F.round(x, 4).alias(x) for x in ("risk", "lo", "hi")])


_RHO_CI = """WITH r AS (SELECT b, gate, m, sum(m) OVER (PARTITION BY b, gate) AS n,
      sum(m) OVER (PARTITION BY b, gate ORDER BY score, id) - (m - 1)/2.0 AS x,
      sum(m) OVER (PARTITION BY b, gate ORDER BY err, id) - (m - 1)/2.0 AS y FROM gate_rows JOIN mult USING (cluster)),
    rho AS (SELECT b, gate, sum(m*x*y)/sqrt(sum(m*x*x)*sum(m*y*y)) AS rho
      FROM (SELECT b, gate, m, x - (n + 1)/2.0 AS x, y - (n + 1)/2.0 AS y FROM r) GROUP BY b, gate)
  SELECT gate, round(quantile_cont(rho, 0.025), 6) AS lo, round(quantile_cont(rho, 0.975), 6) AS hi FROM rho
  GROUP BY gate"""


@query("spearman_bootstrap", with_ctes(_RHO_CI, "gate_rows", "mult"))
def spearman_bootstrap(spark, sf, replicates=B):
    numbers = drawn(spark, sf, replicates=replicates)
    reps = replicate_spearman(gate_rows(spark, sf, numbers), numbers, ["gate"], "score", "err")
    ci = reps.groupBy("gate").agg(*interval("rho"))
    return ci.select("gate", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_SHARE_CI = """WITH s AS (SELECT a.b, a.gate, a.aurc, (r.aurc - a.aurc)/(r.aurc - p.aurc) AS share
    FROM boot_aurc a JOIN boot_aurc r ON r.b = a.b AND r.gate = 'random' JOIN boot_aurc p ON p.b = a.b AND p.gate = 'perfect')
  SELECT gate, round(max(aurc) FILTER (WHERE b = 0), 4) AS aurc,
    round(quantile_cont(aurc, 0.025) FILTER (WHERE b > 0), 4) AS aurc_lo,
    round(quantile_cont(aurc, 0.975) FILTER (WHERE b > 0), 4) AS aurc_hi,
    round(max(share) FILTER (WHERE b = 0), 6) AS gap_share,
    round(quantile_cont(share, 0.025) FILTER (WHERE b > 0), 6) AS share_lo,
    round(quantile_cont(share, 0.975) FILTER (WHERE b > 0), 6) AS share_hi FROM s GROUP BY gate"""


@query("gap_share_ci", with_ctes(_SHARE_CI, "boot_aurc"))
def gap_share_ci(spark, sf, replicates=B):
    areas = pivot_reference(replicated_aurc(boot_curves(spark, sf, replicates)), "aurc", ["b"]).withColumn("share", gap_share("aurc"))
    rep = lambda c: F.when(F.col("b") > 0, F.col(c))
    pick = lambda c: F.max(F.when(F.col("b") == 0, F.col(c)))
    return areas.withColumn("_a", rep("aurc")).withColumn("_s", rep("share")).groupBy("gate").agg(
        F.round(pick("aurc"), 4).alias("aurc"),
        F.round(F.percentile("_a", F.lit(0.025)), 4).alias("aurc_lo"),
        F.round(F.percentile("_a", F.lit(0.975)), 4).alias("aurc_hi"),
        F.round(pick("share"), 6).alias("gap_share"),
        F.round(F.percentile("_s", F.lit(0.025)), 6).alias("share_lo"),
        F.round(F.percentile("_s", F.lit(0.975)), 6).alias("share_hi"))


def p_sql(d: str = "d") -> str:
    return (f"least(1.0, greatest(2*least(avg(({d} <= 0)::INT) FILTER (WHERE b > 0), "
            f"avg(({d} >= 0)::INT) FILTER (WHERE b > 0)), 1.0/count(*) FILTER (WHERE b > 0)))")


def gap_sql(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} - {b}) <= 1e-9*abs({b}) THEN 0.0 ELSE {a} - {b} END"


def diff_sql(d: str = "d") -> str:
    return (f"max({d}) FILTER (WHERE b = 0) AS diff, quantile_cont({d}, 0.025) FILTER (WHERE b > 0) AS lo, "
            f"quantile_cont({d}, 0.975) FILTER (WHERE b > 0) AS hi, {p_sql(d)} AS p")


cte("vs_random", f"""SELECT gate, coverage, {diff_sql()} FROM (SELECT c.b, c.gate, c.coverage, {gap_sql('c.risk', 'r.risk')} AS d
    FROM boot_curve c JOIN boot_curve r ON r.gate = 'random' AND r.b = c.b AND r.coverage = c.coverage
    WHERE c.gate NOT IN ('random', 'perfect')) GROUP BY gate, coverage""", "boot_curve")
cte("holm", """SELECT *, least(1.0, max(s) OVER (PARTITION BY coverage ORDER BY p, gate ROWS UNBOUNDED PRECEDING)) AS p_holm
  FROM (SELECT *, (count(*) OVER (PARTITION BY coverage) - row_number() OVER (PARTITION BY coverage ORDER BY p, gate) + 1)*p AS s
        FROM vs_random)""", "vs_random")


def vs_random(curves, by=(), candidates_only=True):
    diffs = against(curves, "random", by, noise=NOISE)
    if candidates_only:
        diffs = diffs.filter(~F.col("gate").isin("random", "perfect"))
    return summarise_difference(diffs, list(by) + ["gate", "coverage"])


def round_diff(df, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in ("diff", "lo", "hi")} | {
        c: F.round(c, 6) for c in ("p", "p_holm") if c in df.columns})


_R = "round(diff, 4) AS diff, round(lo, 4) AS lo, round(hi, 4) AS hi, round(p, 6) AS p"


@query("paired_vs_random", with_ctes(f"SELECT gate, coverage, {_R} FROM vs_random", "vs_random"))
def paired_vs_random(spark, sf):
    return round_diff(vs_random(boot_curves(spark, sf)))


@query("holm_table", with_ctes(f"""SELECT gate, coverage, {_R}, round(p_holm, 6) AS p_holm,
    CASE WHEN p_holm < 0.001 THEN '***' WHEN p_holm < 0.01 THEN '**' WHEN p_holm < 0.05 THEN '*' ELSE '' END AS stars,
    bool_or(p_holm < 0.05 AND diff < 0) OVER (PARTITION BY gate) AS better_anywhere FROM holm""", "holm"))
def holm_table(spark, sf):
    from pyspark.sql import Window
    t = holm(vs_random(boot_curves(spark, sf)), ["coverage"])
    t = t.withColumn("stars", stars(F.col("p_holm"))).withColumn(
        "better_anywhere", F.bool_or((F.col("p_holm") < 0.05) & (F.col("diff") < 0)).over(Window.partitionBy("gate")))
    return round_diff(t)


_PAIRS = [(a, b) for i, a in enumerate(MODEL_GATES) for b in MODEL_GATES[i + 1:]]


_PAIR_SQL = " UNION ALL ".join(f"""SELECT '{a} - {b}' AS pair, coverage, round(diff, 4) AS diff,
    round(lo, 4) AS lo, round(hi, 4) AS hi, round(p, 6) AS p FROM (SELECT coverage, {diff_sql()} FROM
      (SELECT x.b, x.coverage, {gap_sql('x.risk', 'y.risk')} AS d FROM boot_curve x JOIN boot_curve y USING (b, coverage)
       WHERE x.gate = '{a}' AND y.gate = '{b}' AND coverage IN (0.9, 0.5)) GROUP BY coverage)""" for a, b in _PAIRS)


@query("pairwise_gates", with_ctes(_PAIR_SQL, "boot_curve"))
def pairwise_gates(spark, sf, replicates=B):
    curves = boot_curves(spark, sf, replicates).filter(F.col("coverage").isin(*OPS))
    return round_diff(summarise_difference(pair_differences(curves, _PAIRS, noise=NOISE), ["pair", "coverage"]))


cte("block_share", _SHARE_CI, "boot_aurc")
cte("block_rho", SPEARMAN_SQL, "gate_rows")
cte("block_rho_ci", f"SELECT gate, lo AS rho_lo, hi AS rho_hi FROM ({_RHO_CI})", "gate_rows", "mult")
cte("block_within", WITHIN_SQL, "gate_rows", "test_rows")
cte("block_kept", SELECTIVITY_SQL, "gate_ranked", "test_rows")
cte("block_pairs", _PAIR_SQL, "boot_curve")


@query("eval_block", with_ctes("""WITH ci AS (SELECT gate, coverage, max(risk) FILTER (WHERE b = 0) AS risk,
      quantile_cont(risk, 0.025) FILTER (WHERE b > 0) AS risk_lo, quantile_cont(risk, 0.975) FILTER (WHERE b > 0) AS risk_hi
      FROM boot_curve GROUP BY gate, coverage),
    rho AS (SELECT * FROM block_rho JOIN block_rho_ci USING (gate) UNION ALL SELECT 'random', 0.0, 0.0, 0.0)
  SELECT gate, coverage, round(risk, 4) AS risk, round(risk_lo, 4) AS risk_lo, round(risk_hi, 4) AS risk_hi,
    round(diff, 4) AS diff, round(lo, 4) AS lo, round(hi, 4) AS hi, round(p, 6) AS p, round(p_holm, 6) AS p_holm,
    aurc, aurc_lo, aurc_hi, gap_share, share_lo, share_hi, rho, rho_lo, rho_hi, rho_size, rho_within_size, kept_mean, big_refused, small_refused
  FROM ci LEFT JOIN holm USING (gate, coverage) JOIN block_share USING (gate) JOIN rho USING (gate) LEFT JOIN block_within USING (gate)
    LEFT JOIN block_kept USING (gate, coverage)
  UNION ALL BY NAME SELECT pair AS gate, coverage, diff, lo, hi, p FROM block_pairs""",
    "boot_curve", "holm", "block_share", "block_rho", "block_rho_ci", "block_within", "block_kept", "block_pairs"))
def eval_block(spark, sf, replicates=B):
    """The whole block: curves, areas, shares of the gap and rank correlations with intervals, paired tests, what is kept, and pairs of gates as rows of their own.

    The random gate's risk at any coverage is the mean error of all answers.
    """
    curves = boot_curves(spark, sf, replicates)
    rep = F.when(F.col("b") > 0, F.col("risk"))
    ci = curves.withColumn("_r", rep).groupBy("gate", "coverage").agg(
        F.max(F.when(F.col("b") == 0, F.col("risk"))).alias("risk"),
        F.percentile("_r", F.lit(0.025)).alias("risk_lo"), F.percentile("_r", F.lit(0.975)).alias("risk_hi"))
    tests = holm(vs_random(curves), ["coverage"])
    rho = spearman_table(spark, sf).join(spearman_bootstrap(spark, sf, replicates).withColumnsRenamed({"lo": "rho_lo", "hi": "rho_hi"}), "gate")
    rho = rho.unionByName(spark.createDataFrame([("random", 0.0, 0.0, 0.0)], "gate string, rho double, rho_lo double, rho_hi double"))
    out = round_diff(ci.join(tests, ["gate", "coverage"], "left")).withColumns({c: F.round(c, 4) for c in ("risk", "risk_lo", "risk_hi")})
    out = out.join(gap_share_ci(spark, sf, replicates), "gate").join(rho, "gate").join(spearman_within(spark, sf), "gate", "left")
    out = out.join(selectivity_table(spark, sf), ["gate", "coverage"], "left")
    return out.unionByName(pairwise_gates(spark, sf, replicates).withColumnRenamed("pair", "gate"), allowMissingColumns=True)


def _view_rows():
    cols = "id, cluster, condition, truth, pred, err, gate, score"
    return f"""SELECT 'clean' AS view, 0 AS stratum, {cols} FROM v_all WHERE condition = 'clean'
      UNION ALL SELECT 'pooled', 0, {cols} FROM v_all
      UNION ALL SELECT 'sized', len(list_filter(e, lambda x: x <= pred)), {cols} FROM v_all, edges10 WHERE condition = 'clean'
      UNION ALL SELECT 'relative', 0, id, cluster, condition, truth, pred, err/greatest(truth, 50000.0), gate,
        CASE WHEN gate = 'perfect' THEN err/greatest(truth, 50000.0) ELSE score END FROM v_all WHERE condition = 'clean'"""


cte("v_all", """SELECT id, cluster, condition, truth, pred, err, gate, score FROM long_all WHERE role = 'test'
  UNION ALL SELECT id, cluster, condition, truth, pred, err, 'perfect', err FROM fact WHERE role = 'test'""", "long_all", "fact")
cte("view_rows", _view_rows(), "v_all", "edges10")


@query("eval_views", with_ctes(f"""WITH r AS (SELECT view, gate, stratum, row_number() OVER w AS rk,
      count(*) OVER (PARTITION BY view, gate, stratum) AS n, sum(err) OVER (w ROWS UNBOUNDED PRECEDING) AS cs FROM view_rows
      WINDOW w AS (PARTITION BY view, gate, stratum ORDER BY score, id, condition))
  SELECT view, gate, coverage, sum(rk)::BIGINT AS k, round(sum(cs)/sum(rk), 5) AS risk FROM r JOIN {cov_list([0.9, 0.75, 0.5, 0.25])}
    ON rk = greatest(1, round_even(coverage*n, 0))::BIGINT GROUP BY view, gate, coverage""", "view_rows"))
def eval_views(spark, sf):
    """Four views of the same rows in one plan: the view is a dimension with its filter, stratum and loss."""
    from demur.functions.expr import relative_error
    from demur.operators.curves import curve
    at = edges(calib_rows(spark, sf), "pred", 10)
    rows = fact(spark, sf).filter("role = 'test'")
    err, zero = F.col("err"), F.lit(0)
    rel = relative_error(err, F.col("truth"), 50000.0)
    view = lambda name, stratum, loss: F.struct(F.lit(name).alias("view"), stratum.alias("stratum"), loss.alias("loss"))
    clean = F.array(view("pooled", zero, err), view("clean", zero, err), view("sized", band(F.col("pred"), at), err),
                    view("relative", zero, rel))
    other = F.array(view("pooled", zero, err))
    rows = rows.select("*", F.inline(F.when(F.col("condition") == "clean", clean).otherwise(other)))
    rows = rows.withColumn("key", F.struct("id", "condition"))
    long = with_perfect(long_gates(rows, ["view", "stratum", "key", "loss"]), GATES[0], loss="loss")
    got = curve(long, by=["view", "gate"], strata=["stratum"], ident="key", loss="loss", coverages=[0.9, 0.75, 0.5, 0.25])
    return got.withColumn("risk", F.round("risk", 5))
