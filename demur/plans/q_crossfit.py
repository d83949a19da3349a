"""Queries: cross-fitting, refits, verdicts, pooled evaluation and placebo."""

from __future__ import annotations

from pyspark.sql import functions as F

from demur.operators.crossfit import (bagged_head, fit_heads, line, out_of_fold, pool_roles, repeated_folds, score_held,
                                      seeded_roles)
from demur.operators.curves import COVERAGES, SENSITIVITY, aurc
from demur.operators.draws import draws
from demur.operators.evaluate import against, drawn_curves, holm, pair_differences, summarise_difference
from demur.operators.lines import fit_line
from demur.operators.splits import cluster_sizes, deal_round_robin
from demur.sources.staging import shuffles_removed, stage, stage_once

from .q_boot import _R, NOISE, diff_sql, gap_sql, round_diff
from .q_curves import cov_list
from .registry import cte, query, u, with_ctes
from .views import INPUT_GATES, fact

#: Repeats and folds as published; resamples of the cross-fitted views, below the published 2,000, as the SQL side orders every row once per resample.
R, K, B = 5, 5, 200
XGATES = ["pred_magnitude", "learned_error", "model_spread", "n_lines", "spread"]
_XSCORE = {"pred_magnitude": "pred", "learned_error": "learned_error", "model_spread": "abs(pred - lookup)/2",
           "n_lines": "-n_lines::DOUBLE", "spread": "-spread"}

_XCOLS = "id, cluster, mass, truth, spread, n_lines, pred AS lookup"
cte("x_all", f"SELECT role, {_XCOLS} FROM fact WHERE condition = 'clean'", "fact")
cte("x_pool", "SELECT * FROM x_all WHERE role <> 'test'", "x_all")
cte("x_test", "SELECT * FROM x_all WHERE role = 'test'", "x_all")


def x_rows(spark, sf):
    return fact(spark, sf).filter("condition = 'clean'").select(
        "role", "id", "cluster", "mass", "truth", "spread", "n_lines", F.col("pred").alias("lookup"))


def crossfit_ctes(name: str, src: str, bands: list[int]) -> None:
    edge_cols = ", ".join(f"quantile_cont(pred, [{', '.join(str(i / nb) for i in range(1, nb))}]) AS e{nb}" for nb in bands)
    band_cols = ", ".join(f"len(list_filter(e{nb}, lambda v: v <= pred)) AS band_{nb}" for nb in bands)
    cte(f"{name}_folds", f"""SELECT rep, cluster, size, CASE WHEN p < {K} THEN p ELSE {2 * K - 1} - p END AS fold FROM
      (SELECT *, (row_number() OVER (PARTITION BY rep ORDER BY size DESC, {u("'fold'", 'rep + 760', 'cluster')}, cluster) - 1) % {2 * K} AS p
       FROM (SELECT cluster, count(*) AS size FROM {src} GROUP BY cluster), range({R}) r(rep))""", src)
    cte(f"{name}_roles", f"""SELECT rep, k, cluster, sum(size) OVER (PARTITION BY rep, k ORDER BY
        {u("'carve'", 'rep*100 + k + 760', 'cluster')}, cluster ROWS UNBOUNDED PRECEDING) - size
        < 0.3*sum(size) OVER (PARTITION BY rep, k) AS calib FROM {name}_folds, range({K}) t(k) WHERE k <> fold""", f"{name}_folds")
    cte(f"{name}_main", f"""SELECT rep, k, avg(mass) AS mx, avg(truth) AS my, covar_pop(mass, truth)*count(*)/(var_pop(mass)*count(*) + 1) AS w
      FROM {src} JOIN {name}_roles USING (cluster) WHERE NOT calib GROUP BY rep, k""", f"{name}_roles", src)
    cte(f"{name}_calib", f"""SELECT rep, k, spread, (mass - mx)*w + my AS pred, abs((mass - mx)*w + my - truth) AS err
      FROM {src} JOIN {name}_roles USING (cluster) JOIN {name}_main USING (rep, k) WHERE calib""", f"{name}_main", f"{name}_roles", src)
    cte(f"{name}_head", f"""SELECT rep, k, avg(spread) AS hx, avg(err) AS hy, covar_pop(spread, err)*count(*)/(var_pop(spread)*count(*) + 1) AS hw,
      {edge_cols} FROM {name}_calib GROUP BY rep, k""", f"{name}_calib")
    cte(name, f"""SELECT *, {band_cols} FROM (SELECT s.*, f.rep, f.fold, (mass - mx)*w + my AS pred,
        round(abs((mass - mx)*w + my - truth), 4) AS err, (spread - hx)*hw + hy AS learned_error, h.*
      FROM {src} s JOIN {name}_folds f USING (cluster) JOIN {name}_main m ON m.rep = f.rep AND m.k = f.fold
      JOIN (SELECT rep AS hrep, k AS hk, * EXCLUDE (rep, k) FROM {name}_head) h ON hrep = f.rep AND hk = f.fold)""",
        src, f"{name}_folds", f"{name}_main", f"{name}_head")


crossfit_ctes("xf", "x_pool", [10])
crossfit_ctes("xa", "x_all", [5, 10, 20])


def crossfit_rows(rows, bands):
    sizes = cluster_sizes(rows)
    folds = stage(repeated_folds(sizes, R, K), "folds")
    roles = stage(pool_roles(folds, K), "roles")
    heads = fit_heads(rows, roles, ["rep", "held"], "mass", "truth", "spread", bands=bands)
    held = rows.join(folds.select("rep", "cluster", "fold"), "cluster").withColumn("held", F.col("fold"))
    got = score_held(held, heads, ["rep", "held"], "mass", "truth", "spread", bands)
    return got.withColumn("err", F.round("err", 4)).drop("held")


def crossfit_pool(spark, sf):
    return stage_once(spark, f"{sf}:xf", lambda: crossfit_rows(x_rows(spark, sf).filter("role <> 'test'"), [10]), sf)


@query("crossfit", with_ctes("""SELECT id, rep, fold, round(pred, 3) AS pred, err, round(learned_error, 3) AS learned_error,
  band_10 AS band FROM xf""", "xf"))
def crossfit(spark, sf):
    return crossfit_pool(spark, sf).select("id", "rep", "fold", F.round("pred", 3).alias("pred"), "err",
                                           F.round("learned_error", 3).alias("learned_error"), F.col("band_10").alias("band"))


def x_long(rows, keep):
    """One row per gate, and one of the perfect refuser."""
    score = {"pred_magnitude": F.col("pred"), "learned_error": F.col("learned_error"),
             "model_spread": F.abs(F.col("pred") - F.col("lookup")) / 2, "n_lines": -F.col("n_lines").cast("double"),
             "spread": -F.col("spread"), "perfect": F.col("err")}
    cells = [F.struct(F.lit(g).alias("gate"), s.alias("score")) for g, s in score.items()]
    return rows.select(*keep, F.inline(F.array(*cells)))


def x_long_sql(src, keep, where="TRUE"):
    return " UNION ALL ".join([f"SELECT {keep}, '{g}' AS gate, {s} AS score FROM {src} WHERE {where}" for g, s in _XSCORE.items()]
                              + [f"SELECT {keep}, 'perfect' AS gate, err AS score FROM {src} WHERE {where}"])


def boot_ctes(name, rows_cte, src, keys, b, covs, extra=""):
    """SQL of replicated curves: rows_cte has keys, stratum, gate, id, cluster, err, score."""
    ks = ", ".join(keys)
    cte(f"{name}_cl", f"""SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS ord, count(*) OVER () AS c
      FROM (SELECT DISTINCT cluster FROM {src})""", src)
    cte(f"{name}_mult", f"""SELECT b, cluster, count(*) AS m FROM (SELECT b, floor({u("'boot'", '760', 'b', 'j')}*c)::BIGINT AS ord
      FROM range(1, {b + 1}) t(b), (SELECT c, unnest(range(c)) AS j FROM (SELECT any_value(c) AS c FROM {name}_cl))) d
      JOIN {name}_cl USING (ord) GROUP BY b, cluster UNION ALL SELECT 0, cluster, 1 FROM {name}_cl""", f"{name}_cl")
    part = f"{ks}, b, gate, stratum"
    # Copies are weights, as in the plain block.
    cte(f"{name}_ranked", f"""SELECT {part}, m, err, sum(m) OVER w AS rk, sum(m*err) OVER w AS cs FROM {rows_cte} JOIN {name}_mult USING (cluster) {extra}
        WINDOW w AS (PARTITION BY {part} ORDER BY score, id ROWS UNBOUNDED PRECEDING)""", rows_cte, f"{name}_mult")
    cte(f"{name}_wanted", f"""SELECT {part}, coverage, greatest(1, round_even(coverage*n, 0))::BIGINT AS k FROM
      (SELECT {part}, max(rk) AS n FROM {name}_ranked GROUP BY {part}), {cov_list(covs)}""", f"{name}_ranked")
    same = " AND ".join(f"r.{c} = w.{c}" for c in [*keys, "b", "gate", "stratum"])
    cte(f"{name}_curve", f"""SELECT {ks}, b, gate, coverage, sum(kept)/sum(k) AS risk FROM (SELECT {', '.join(f'w.{c}' for c in [*keys, 'b', 'gate'])}, coverage, k,
          cs - (rk - k)*err AS kept FROM {name}_wanted w ASOF JOIN {name}_ranked r ON {same} AND w.k <= r.rk) GROUP BY {ks}, b, gate, coverage
      UNION ALL SELECT {ks}, b, 'random', coverage, risk FROM (SELECT {ks}, b, sum(m*err)/sum(m) AS risk FROM {name}_ranked
        WHERE gate = 'perfect' GROUP BY {ks}, b), {cov_list(covs)}""", f"{name}_ranked", f"{name}_wanted")


# ---- cross-fitted evaluation and verdicts
cte("xf_rows", "SELECT 'plain' AS view, fold AS stratum, * EXCLUDE (fold) FROM (" + x_long_sql("xf", "id, cluster, err, fold", "rep = 0") + """)
  UNION ALL SELECT 'sized', stratum, * EXCLUDE (stratum) FROM (""" + x_long_sql("xf", "id, cluster, err, fold*10 + band_10 AS stratum", "rep = 0") + ")", "xf")
boot_ctes("xfb", "xf_rows", "x_pool", ["view"], B, [0.9, 0.5])
cte("xf_vs", f"""SELECT view, gate, coverage, {diff_sql()} FROM (SELECT c.view, c.b, c.gate, c.coverage, {gap_sql('c.risk', 'r.risk')} AS d
    FROM xfb_curve c JOIN xfb_curve r ON r.gate = 'random' AND r.view = c.view AND r.b = c.b AND r.coverage = c.coverage
    WHERE c.gate <> 'random') GROUP BY view, gate, coverage""", "xfb_curve")
cte("xf_holm", """SELECT *, least(1.0, max(s) OVER (PARTITION BY view, coverage ORDER BY p, gate ROWS UNBOUNDED PRECEDING)) AS p_holm
  FROM (SELECT *, (count(*) OVER (PARTITION BY view, coverage) - row_number() OVER (PARTITION BY view, coverage ORDER BY p, gate) + 1)*p AS s
        FROM xf_vs WHERE gate <> 'perfect')""", "xf_vs")


def crossfit_curves(spark, sf):
    def build():
        rows = crossfit_pool(spark, sf).filter("rep = 0")
        drawn = draws(rows, B, with_point=True)
        long = x_long(drawn.number(rows).withColumn("code", F.col("fold") * 10 + F.col("band_10")), ["id", "ord", "err", "code"])
        views = {"plain": [c // 10 for c in range(K * 10)], "sized": list(range(K * 10))}
        return drawn_curves(long, drawn, coverages=[0.9, 0.5], views=views, code="code", like=XGATES[0])
    return stage_once(spark, f"{sf}:xfb", build)


def crossfit_tests(curves):
    tests = summarise_difference(against(curves, "random", ["view"], noise=NOISE).filter("gate NOT IN ('random', 'perfect')"),
                                 ["view", "gate", "coverage"])
    return holm(tests, ["view", "coverage"])


@query("crossfit_eval", with_ctes(f"SELECT view, gate, coverage, {_R}, round(p_holm, 6) AS p_holm FROM xf_holm", "xf_holm"))
def crossfit_eval(spark, sf):
    return round_diff(crossfit_tests(crossfit_curves(spark, sf)))


cte("xf_gap", """SELECT max(risk) FILTER (WHERE gate = 'random') - max(risk) FILTER (WHERE gate = 'perfect') AS gap
  FROM xfb_curve WHERE view = 'sized' AND b = 0 AND coverage = 0.9""", "xfb_curve")
cte("xf_pair", f"""SELECT {diff_sql()} FROM (SELECT x.b, {gap_sql('x.risk', 'y.risk')} AS d FROM xfb_curve x JOIN xfb_curve y
  USING (view, b, coverage) WHERE view = 'sized' AND coverage = 0.9 AND x.gate = 'learned_error' AND y.gate = 'pred_magnitude')""", "xfb_curve")


@query("verdicts", with_ctes("""WITH s AS (SELECT * FROM xf_holm WHERE coverage = 0.9)
  SELECT 'H1' AS hypothesis, round(diff, 3) AS diff, round(hi, 3) AS edge, diff < 0 AND hi < 0 AS holds FROM s WHERE view = 'sized' AND gate = 'learned_error'
  UNION ALL SELECT 'H2', round(diff, 3), round(hi, 3), hi < 0 FROM xf_pair
  UNION ALL SELECT 'H3', round(a.diff, 3), round(a.hi, 3), a.hi < 0 AND b.lo <= 0 AND b.hi >= 0 FROM s a JOIN s b ON a.gate = b.gate
    WHERE a.view = 'plain' AND b.view = 'sized' AND a.gate = 'pred_magnitude'
  UNION ALL SELECT 'H4', round(min(diff), 3), round(min(lo), 3), bool_and(lo > -0.25*gap) FROM s, xf_gap WHERE view = 'sized' AND gate IN ('n_lines', 'spread')
  UNION ALL SELECT 'H5', round(diff, 3), round(hi, 3), hi < 0 FROM s WHERE view = 'sized' AND gate = 'model_spread'""", "xf_holm", "xf_pair", "xf_gap"))
def verdicts(spark, sf):
    """Five fixed hypotheses read off the tests; one pass over a handful of rows."""
    curves = crossfit_curves(spark, sf)
    t = crossfit_tests(curves).filter("coverage = 0.9")
    pair = summarise_difference(pair_differences(curves.filter("view = 'sized' AND coverage = 0.9"),
                                                 [("learned_error", "pred_magnitude")], ["view"], noise=NOISE), ["pair"])
    point = curves.filter("view = 'sized' AND b = 0 AND coverage = 0.9")
    at = lambda g: F.max(F.when(F.col("gate") == g, F.col("risk")))
    gap = point.agg((at("random") - at("perfect")).alias("gap")).first()["gap"]
    sized = lambda g: F.when((F.col("view") == "sized") & (F.col("gate") == g), F.struct("diff", "lo", "hi"))
    plain = F.when((F.col("view") == "plain") & (F.col("gate") == "pred_magnitude"), F.struct("diff", "lo", "hi"))
    inputs = (F.col("view") == "sized") & F.col("gate").isin(*INPUT_GATES)
    w = t.agg(F.max(sized("learned_error")).alias("h1"), F.max(plain).alias("h3"), F.max(sized("pred_magnitude")).alias("h3s"),
              F.max(sized("model_spread")).alias("h5"), F.min(F.when(inputs, F.col("diff"))).alias("d4"),
              F.min(F.when(inputs, F.col("lo"))).alias("l4")).join(pair.select(F.struct("diff", "lo", "hi").alias("h2")))
    row = lambda name, diff, edge, holds: F.struct(F.lit(name).alias("hypothesis"), F.round(diff, 3).alias("diff"),
                                                   F.round(edge, 3).alias("edge"), holds.alias("holds"))
    c = F.col
    return w.select(F.inline(F.array(
        row("H1", c("h1.diff"), c("h1.hi"), (c("h1.diff") < 0) & (c("h1.hi") < 0)),
        row("H2", c("h2.diff"), c("h2.hi"), c("h2.hi") < 0),
        row("H3", c("h3.diff"), c("h3.hi"), (c("h3.hi") < 0) & (c("h3s.lo") <= 0) & (c("h3s.hi") >= 0)),
        row("H4", c("d4"), c("l4"), c("l4") > -0.25 * gap),
        row("H5", c("h5.diff"), c("h5.hi"), c("h5.hi") < 0))))


@query("equivalence_bound", with_ctes("""WITH p AS (SELECT -diff AS saving FROM xf_vs WHERE view = 'sized' AND coverage = 0.9 AND gate = 'perfect')
  SELECT gate, round(-lo/saving, 6) AS best_case_share, round(max(-lo/saving) OVER (), 6) AS bound FROM xf_vs, p
  WHERE view = 'sized' AND coverage = 0.9 AND gate IN ('n_lines', 'spread')""", "xf_vs"))
def equivalence_bound(spark, sf):
    """The most an input gate could save, as a share of what the perfect refuser saves."""
    from pyspark.sql import Window
    curves = crossfit_curves(spark, sf).filter("view = 'sized' AND coverage = 0.9")
    t = summarise_difference(against(curves, "random", ["view"], noise=NOISE), ["gate"])
    saving = F.max(F.when(F.col("gate") == "perfect", -F.col("diff"))).over(Window.partitionBy(F.lit(1)))
    share = t.select("gate", (-F.col("lo") / saving).alias("s")).filter(F.col("gate").isin(*INPUT_GATES))
    return share.select("gate", F.round("s", 6).alias("best_case_share"),
                        F.round(F.max("s").over(Window.partitionBy(F.lit(1))), 6).alias("bound"))


# ---- pooled evaluation over repeats and band counts
BANDS = [0, 5, 10, 20]
cte("xa_rows", " UNION ALL ".join(
    f"SELECT {nb} AS bands, rep, stratum, * EXCLUDE (rep, stratum) FROM ("
    + x_long_sql("xa", f"rep, {'fold' if nb == 0 else f'fold*{nb} + band_{nb}'} AS stratum, id, cluster, err") + ")" for nb in BANDS), "xa")
#: Resamples of no bands and ten, as published; five and twenty have half of them.
BP = 2000
FULL = (0, 10)
IN_BLOCK, IN_BUCKET = 20, 8  # resamples of a pass; rows side by side


def pooled_ctes(name, rows_cte, src, b, covs):
    """SQL of ``boot_ctes`` by bands and rep, a block of resamples at a time: no more than a block is held.

    Ordered rows lie in buckets side by side, so that running sums are made over buckets, with a column per resample, and only a bucket that holds a wanted rank is looked into.
    """
    block, rows = range(IN_BLOCK), range(IN_BUCKET)
    cte(f"{name}_cl", f"""SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS ord, count(*) OVER () AS c
      FROM (SELECT DISTINCT cluster FROM {src})""", src)
    cte(f"{name}_mult", f"""SELECT b, cluster, count(*) AS m FROM (SELECT b, floor({u("'boot'", '760', 'b', 'j')}*c)::BIGINT AS ord
      FROM range(1, {b + 1}) t(b), (SELECT c, unnest(range(c)) AS j FROM (SELECT any_value(c) AS c FROM {name}_cl))) d
      JOIN {name}_cl USING (ord) GROUP BY b, cluster UNION ALL SELECT 0, cluster, 1 FROM {name}_cl""", f"{name}_cl")
    cte(f"{name}_wide", f"SELECT b // {IN_BLOCK} AS block, cluster, " + ", ".join(f"coalesce(sum(m) FILTER (b % {IN_BLOCK} = {j}), 0)::BIGINT AS m{j}" for j in block)
        + f" FROM {name}_mult GROUP BY block, cluster", f"{name}_mult")
    cte(f"{name}_order", f"SELECT bands, rep, gate, stratum, place // {IN_BUCKET} AS bucket, "
        + ", ".join(f"max(cluster) FILTER (place % {IN_BUCKET} = {i}) AS c{i}, coalesce(max(err) FILTER (place % {IN_BUCKET} = {i}), 0) AS e{i}" for i in rows)
        + f" FROM (SELECT *, row_number() OVER (PARTITION BY bands, rep, gate, stratum ORDER BY score, id) - 1 AS place FROM {rows_cte}) GROUP BY bands, rep, gate, stratum, bucket", rows_cte)
    full = f"bands IN ({', '.join(map(str, FULL))})"
    losses = ", ".join(f"e{i}" for i in rows)
    drawn = ", ".join(f"coalesce(x{i}.m{j}, 0) AS m{i}_{j}" for i in rows for j in block)
    joined = " ".join(f"LEFT JOIN drawn x{i} ON x{i}.cluster = c{i}" for i in rows)
    weight = lambda j: "(" + " + ".join(f"m{i}_{j}" for i in rows) + ")"
    loss = lambda j: "(" + " + ".join(f"m{i}_{j}*e{i}" for i in rows) + ")"
    run = ", ".join(f"{weight(j)} AS m_{j}, (sum({weight(j)}) OVER r)::BIGINT AS rk{j}, (sum({weight(j)}) OVER p)::BIGINT AS n{j}, sum({loss(j)}) OVER r - {loss(j)} AS cs{j}" for j in block)
    # Coverages are twentieths: a bucket without a twentieth of the copies between its first and its last copy, by half a rank at most, holds no wanted rank.
    cells = " UNION ALL ".join(f"""SELECT block, bands, rep, gate, {losses}, {j} AS j, {', '.join(f'm{i}_{j} AS m{i}' for i in rows)}, m_{j} AS m, rk{j} AS rk, n{j} AS n, cs{j} AS cs FROM runs
        WHERE m_{j} > 0 AND (rk{j} = m_{j} OR floor(20*(rk{j} + 0.500001)/n{j}) > floor(20*(rk{j} - m_{j} + 0.499999)/n{j}))""" for j in block)
    taken = " + ".join(f"e{i}*greatest(0, least(m{i}, k - rk + m{''.join(f' - m{h}' for h in range(i))}))" for i in rows)
    cte(f"{name}_curve", f"""WITH RECURSIVE step(block, bands, rep, gate, b, coverage, risk) AS (
        SELECT -1::BIGINT, any_value(bands), any_value(rep), any_value(gate), -1::BIGINT, 0::DOUBLE, 0::DOUBLE FROM {name}_order
      UNION ALL SELECT * FROM (WITH drawn AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT block + 1 AS block FROM step WHERE block < {b // IN_BLOCK}) JOIN {name}_wide USING (block)),
        runs AS MATERIALIZED (SELECT block, bands, rep, gate, {losses}, {", ".join(f"m{i}_{j}" for i in rows for j in block)}, {run} FROM (
            SELECT s.block, o.*, {drawn} FROM (SELECT any_value(block) AS block FROM drawn) s JOIN {name}_order o ON {full} OR s.block*{IN_BLOCK} <= {b // 2} {joined})
          WINDOW r AS (PARTITION BY bands, rep, gate, stratum ORDER BY bucket ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY bands, rep, gate, stratum))
        SELECT block, bands, rep, gate, block*{IN_BLOCK} + j, coverage, sum(cs + {taken})/sum(k) FROM (
          SELECT *, greatest(1, round_even(coverage*n, 0))::BIGINT AS k FROM ({cells}), {cov_list(covs)})
        WHERE k > rk - m AND k <= rk GROUP BY block, bands, rep, gate, j, coverage)),
      flat AS (SELECT rep, b, sum(m*e)/sum(m*n) AS risk FROM (SELECT rep, cluster, sum(err) AS e, count(*) AS n FROM {rows_cte} WHERE gate = 'perfect' AND bands = 0
        GROUP BY rep, cluster) JOIN {name}_mult USING (cluster) GROUP BY rep, b)
    SELECT bands, rep, b, gate, coverage, risk FROM step WHERE b BETWEEN 0 AND {b} AND ({full} OR b <= {b // 2})
      UNION ALL SELECT bands, rep, b, 'random', coverage, risk FROM flat, (SELECT DISTINCT bands FROM {name}_order), {cov_list(covs)} WHERE {full} OR b <= {b // 2}""",
        rows_cte, f"{name}_wide", f"{name}_mult", f"{name}_order")


pooled_ctes("xab", "xa_rows", "x_all", BP, COVERAGES)
cte("xa_diff", f"""SELECT c.bands, c.rep, c.b, c.gate, c.coverage, {gap_sql('c.risk', 'r.risk')} AS d FROM xab_curve c JOIN xab_curve r
  ON r.gate = 'random' AND r.bands = c.bands AND r.rep = c.rep AND r.b = c.b AND r.coverage = c.coverage WHERE c.gate <> 'random'""", "xab_curve")
cte("xa_mean", "SELECT bands, b, gate, coverage, avg(d) AS d FROM xa_diff GROUP BY bands, b, gate, coverage", "xa_diff")
cte("xa_stat", f"""SELECT bands, gate, coverage, {diff_sql()} FROM xa_mean GROUP BY bands, gate, coverage""", "xa_mean")
cte("xa_area", f"""SELECT bands, gate, {diff_sql()} FROM (SELECT bands, b, gate, sum((coverage - pc)*(d + pd)/2)/(max(coverage) - min(coverage)) AS d
    FROM (SELECT *, lag(coverage) OVER w AS pc, lag(d) OVER w AS pd FROM xa_mean WINDOW w AS (PARTITION BY bands, b, gate ORDER BY coverage))
    GROUP BY bands, b, gate) GROUP BY bands, gate""", "xa_mean")


def pooled_curves(rows, drawn):
    """Curves of all repeats and band counts. One repeat is fitted, scored and ordered after the other, from one narrow table of the rows with their folds."""
    folds = stage(repeated_folds(cluster_sizes(rows), R, K), "folds")
    wide = folds.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("rep", "fold"))).alias("folds"))
    inputs = [c for c in rows.columns if c not in ("role", "cluster")]
    held = stage(drawn.number(rows.join(wide, "cluster")).select(*inputs, "ord", *[F.col("folds")[r].cast("byte").alias(f"fold_{r}") for r in range(R)]), "held")
    most, heads = max(BANDS), []
    for r in range(R):
        roles = stage(pool_roles(folds.filter(F.col("rep") == r), K), "roles")
        heads.append(stage(fit_heads(rows, roles, ["rep", "held"], "mass", "truth", "spread", bands=[most]), "heads"))

    def repeat(r):
        mine = held.withColumns({"rep": F.lit(r), "held": F.col(f"fold_{r}").cast("int")})
        got = score_held(mine, heads[r], ["rep", "held"], "mass", "truth", "spread", [most]).withColumn("err", F.round("err", 4))
        return got.withColumn("code", F.col("held") * most + F.col(f"band_{most}"))

    long = (x_long(repeat(r), ["rep", "id", "ord", "err", "code"]) for r in range(R))
    # Edges of fewer bands are edges of the most bands too, so all band counts share one order of the rows.
    views = {nb: [c // most * nb + c % most * nb // most for c in range(K * most)] if nb else [c // most for c in range(K * most)] for nb in BANDS}
    return drawn_curves(long, drawn, ["rep"], views=views, code="code", view="bands", like=XGATES[0],
                        upto={nb: drawn.replicates // (1 if nb in FULL else 2) for nb in BANDS})


@query("pooled_eval", with_ctes(f"""WITH h AS (SELECT bands, gate, coverage, least(1.0, max(s) OVER (PARTITION BY bands, coverage ORDER BY p, gate
      ROWS UNBOUNDED PRECEDING)) AS p_holm FROM (SELECT *, (count(*) OVER (PARTITION BY bands, coverage)
        - row_number() OVER (PARTITION BY bands, coverage ORDER BY p, gate) + 1)*p AS s FROM xa_stat WHERE gate <> 'perfect')),
    sd AS (SELECT bands, gate, stddev_samp(d) AS sd FROM xa_diff WHERE b = 0 AND coverage = 0.9 GROUP BY bands, gate)
  SELECT s.bands, s.gate, s.coverage, round(s.diff, 3) AS diff, round(s.lo, 3) AS lo, round(s.hi, 3) AS hi, round(s.p, 6) AS p,
    round(p_holm, 6) AS p_holm, round(a.diff, 3) AS aurc_diff, round(a.lo, 3) AS aurc_lo, round(a.hi, 3) AS aurc_hi, round(sd, 3) AS repeat_sd_90
  FROM xa_stat s LEFT JOIN h USING (bands, gate, coverage) JOIN xa_area a ON a.bands = s.bands AND a.gate = s.gate
  JOIN sd ON sd.bands = s.bands AND sd.gate = s.gate WHERE s.coverage IN (0.95, 0.9, 0.8, 0.7, 0.5)""", "xa_stat", "xa_area", "xa_diff"))
def pooled_eval(spark, sf):
    """Effects averaged over repeats inside every replicate, for four band counts."""
    rows = x_rows(spark, sf)
    # Nothing that is shuffled for one step is left on disk in the next.
    with shuffles_removed(spark):
        curves = pooled_curves(rows, draws(rows, BP, with_point=True))
        diffs = stage(against(curves, "random", ["bands", "rep"], noise=NOISE).filter("gate <> 'random'"), "diffs")
    mean = diffs.groupBy("bands", "b", "gate", "coverage").agg(F.avg("diff").alias("diff"))
    stat = summarise_difference(mean, ["bands", "gate", "coverage"])
    area = aurc(mean.withColumnRenamed("diff", "risk"), ["bands", "b", "gate"]).withColumnRenamed("aurc", "diff")
    area = summarise_difference(area, ["bands", "gate"]).select(
        "bands", "gate", *[F.round(c, 3).alias(f"aurc_{c}") for c in ("diff", "lo", "hi")])
    adjusted = holm(stat.filter("gate <> 'perfect'"), ["bands", "coverage"]).select("bands", "gate", "coverage", "p_holm")
    sd = diffs.filter("b = 0 AND coverage = 0.9").groupBy("bands", "gate").agg(F.round(F.stddev_samp("diff"), 3).alias("repeat_sd_90"))
    keep = stat.filter(F.col("coverage").isin(*SENSITIVITY))
    return round_diff(keep.join(adjusted, ["bands", "gate", "coverage"], "left"), 3).join(area, ["bands", "gate"]).join(sd, ["bands", "gate"])


# ---- refits over carves
SEEDS = [760, *range(1, 20)]  # the published number of carves
_seed_sql = "[" + ", ".join(f"{{rep: {i}, seed: {s}}}" for i, s in enumerate(SEEDS)) + "]"
cte("rf_roles", f"""SELECT rep, cluster, sum(size) OVER (PARTITION BY rep ORDER BY {u("'carve'", 'seed', 'cluster')}, cluster ROWS UNBOUNDED PRECEDING) - size
    < 0.3*sum(size) OVER (PARTITION BY rep) AS calib FROM (SELECT cluster, count(*) AS size FROM x_pool GROUP BY cluster),
    (SELECT unnest({_seed_sql}, recursive := true))""", "x_pool")
cte("rf_main", """SELECT rep, avg(mass) AS mx, avg(truth) AS my, covar_pop(mass, truth)*count(*)/(var_pop(mass)*count(*) + 1) AS w
  FROM x_pool JOIN rf_roles USING (cluster) WHERE NOT calib GROUP BY rep""", "rf_roles", "x_pool")
cte("rf_calib", """SELECT rep, spread, (mass - mx)*w + my AS pred, abs((mass - mx)*w + my - truth) AS err
  FROM x_pool JOIN rf_roles USING (cluster) JOIN rf_main USING (rep) WHERE calib""", "rf_main", "rf_roles", "x_pool")
cte("rf_head", """SELECT rep, avg(spread) AS hx, avg(err) AS hy, covar_pop(spread, err)*count(*)/(var_pop(spread)*count(*) + 1) AS hw,
  quantile_cont(pred, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM rf_calib GROUP BY rep""", "rf_calib")
cte("rf_test", """SELECT *, len(list_filter(e, lambda v: v <= pred)) AS band_10 FROM (SELECT t.*, rep, e, (mass - mx)*w + my AS pred,
  round(abs((mass - mx)*w + my - truth), 4) AS err, (spread - hx)*hw + hy AS learned_error FROM x_test t, rf_main JOIN rf_head USING (rep))""",
    "x_test", "rf_main", "rf_head")
_RG = ["learned_error", "pred_magnitude"]


def _rf_long(stratum, view):
    keep = f"'{view}' AS view, rep, {stratum} AS stratum, id, cluster, err"
    return " UNION ALL ".join([f"SELECT {keep}, '{g}' AS gate, {_XSCORE[g]} AS score FROM rf_test" for g in _RG]
                              + [f"SELECT {keep}, 'perfect', err FROM rf_test"])


cte("rf_rows", _rf_long("band_10", "sized") + " UNION ALL " + _rf_long("0", "plain"), "rf_test")
boot_ctes("rfb", "rf_rows", "x_test", ["view", "rep"], B, [0.9])
cte("rf_eff", f"""SELECT c.view || '_' || c.gate AS effect, c.rep, c.b, {gap_sql('c.risk', 'r.risk')} AS d FROM rfb_curve c JOIN rfb_curve r
  ON r.gate = 'random' AND r.view = c.view AND r.rep = c.rep AND r.b = c.b WHERE c.gate <> 'random'""", "rfb_curve")


@query("refit_spread", with_ctes(f"""WITH p AS (SELECT effect, max(d) FILTER (WHERE rep = 0) AS official,
      count(*) FILTER (WHERE d < o) + 1 AS official_rank, stddev_samp(d) AS sd, min(d) AS lowest, max(d) AS highest FROM
      (SELECT *, max(d) FILTER (WHERE rep = 0) OVER (PARTITION BY effect) AS o FROM rf_eff WHERE b = 0) GROUP BY effect),
    a AS (SELECT effect, {diff_sql()} FROM (SELECT effect, b, avg(d) AS d FROM rf_eff GROUP BY effect, b) GROUP BY effect)
  SELECT effect, round(official, 3) AS official, official_rank, round(sd, 3) AS sd, round(lowest, 3) AS lowest, round(highest, 3) AS highest,
    round(diff, 3) AS averaged, round(lo, 3) AS lo, round(hi, 3) AS hi, round(p, 6) AS p FROM p JOIN a USING (effect)""", "rf_eff"))
def refit_spread(spark, sf):
    """How much an effect depends on the calibration carve; intervals are for the carve-averaged effect."""
    from pyspark.sql import Window
    rows = x_rows(spark, sf)
    pool, test = rows.filter("role <> 'test'"), rows.filter("role = 'test'")
    roles = stage(seeded_roles(cluster_sizes(pool), SEEDS), "roles")
    heads = fit_heads(pool, roles, ["rep"], "mass", "truth", "spread")
    held = test.withColumn("rep", F.explode(F.array(*[F.lit(i) for i in range(len(SEEDS))])))
    scored = stage(score_held(held, heads, ["rep"], "mass", "truth", "spread").withColumn("err", F.round("err", 4)), "refits")
    drawn = draws(test, B, with_point=True)
    cells = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(c).alias("score"))
                      for g, c in (("learned_error", "learned_error"), ("pred_magnitude", "pred"), ("perfect", "err"))])
    long = drawn.number(scored).select("rep", "id", "ord", "err", F.col("band_10").alias("code"), F.inline(cells))
    views = {"sized": list(range(10)), "plain": [0] * 10}
    curves = drawn_curves(long, drawn, ["rep"], [0.9], views, "code", like="learned_error")
    eff = against(curves, "random", ["view", "rep"], noise=NOISE).filter("gate <> 'random'").withColumn("effect", F.concat_ws("_", "view", "gate"))
    eff = stage(eff.select("effect", "rep", "b", "diff"), "effects")
    first = F.max(F.when(F.col("rep") == 0, F.col("diff"))).over(Window.partitionBy("effect"))
    point = eff.filter("b = 0").withColumn("_o", first).groupBy("effect").agg(
        F.round(F.max("_o"), 3).alias("official"), (F.count(F.when(F.col("diff") < F.col("_o"), 1)) + 1).alias("official_rank"),
        F.round(F.stddev_samp("diff"), 3).alias("sd"), F.round(F.min("diff"), 3).alias("lowest"), F.round(F.max("diff"), 3).alias("highest"))
    mean = eff.groupBy("effect", "b").agg(F.avg("diff").alias("diff"))
    averaged = round_diff(summarise_difference(mean, ["effect"]), 3).withColumnRenamed("diff", "averaged")
    return point.join(averaged, "effect")


# ---- error heads: bagged, out of fold, one feature
cte("fit_rows", "SELECT * FROM x_all WHERE role = 'fit'", "x_all")


@query("ridge_1d", with_ctes("""WITH p AS (SELECT avg(mass) AS mx, avg(truth) AS my, covar_pop(mass, truth)*count(*)/(var_pop(mass)*count(*) + 10.0) AS w
    FROM fit_rows) SELECT id, round((mass - mx)*w + my, 3) AS pred FROM x_test, p""", "fit_rows", "x_test"))
def ridge_1d(spark, sf):
    rows = x_rows(spark, sf)
    head = fit_line(rows.filter("role = 'fit'"), "mass", "truth", 10.0)
    return rows.filter("role = 'test'").select("id", F.round(head.predict(F.col("mass")), 3).alias("pred"))


@query("learned_error", with_ctes("SELECT id, condition, learned_error FROM fact WHERE role = 'test'", "fact"))
def learned_error(spark, sf):
    """Error head trained on calibration errors the main head never saw, on rows of every condition."""
    clean = fact(spark, sf).filter("condition = 'clean' AND role = 'calib'")
    unit = F.col("pred") / F.greatest(F.col("n_lines"), F.lit(1))
    head = fit_line(clean.withColumn("x_unit", unit), "x_unit", "err", 1.0)
    return fact(spark, sf).filter("role = 'test'").select("id", "condition", F.round(head.predict(unit), 4).alias("learned_error"))


BAG_SEEDS = [760 + 1000 * c for c in range(10)]
_bag_sql = "[" + ", ".join(f"{{rep: {i}, seed: {s}}}" for i, s in enumerate(BAG_SEEDS)) + "]"
cte("bag_roles", f"""SELECT rep, cluster, sum(size) OVER (PARTITION BY rep ORDER BY {u("'carve'", 'seed', 'cluster')}, cluster ROWS UNBOUNDED PRECEDING) - size
    < 0.3*sum(size) OVER (PARTITION BY rep) AS calib FROM (SELECT cluster, count(*) AS size FROM x_pool GROUP BY cluster),
    (SELECT unnest({_bag_sql}, recursive := true))""", "x_pool")
cte("bag_main", """SELECT rep, avg(mass) AS mx, avg(truth) AS my, covar_pop(mass, truth)*count(*)/(var_pop(mass)*count(*) + 1) AS w
  FROM x_pool JOIN bag_roles USING (cluster) WHERE NOT calib GROUP BY rep""", "bag_roles", "x_pool")
cte("bag_head", """SELECT rep, avg(spread) AS hx, avg(err) AS hy, covar_pop(spread, err)*count(*)/(var_pop(spread)*count(*) + 1) AS hw FROM
  (SELECT rep, spread, abs((mass - mx)*w + my - truth) AS err FROM x_pool JOIN bag_roles USING (cluster) JOIN bag_main USING (rep) WHERE calib)
  GROUP BY rep""", "bag_main", "bag_roles", "x_pool")


@query("learned_error_bag", with_ctes("""SELECT id, round(avg((spread - hx)*hw + hy), 3) AS learned_error_bag FROM x_test, bag_head GROUP BY id""",
                                      "x_test", "bag_head"))
def learned_error_bag(spark, sf):
    rows = x_rows(spark, sf)
    pool = rows.filter("role <> 'test'")
    roles = seeded_roles(cluster_sizes(pool), BAG_SEEDS)
    w, c = bagged_head(fit_heads(pool, roles, ["rep"], "mass", "truth", "spread", bands=[]))
    return rows.filter("role = 'test'").select("id", F.round(line(F.col("spread"), w, c), 3).alias("learned_error_bag"))


def oof_ctes(name, src):
    cte(f"{name}_f", f"""SELECT cluster, (row_number() OVER (ORDER BY {u("'robin'", '760', 'cluster')}, cluster) - 1) % 5 AS fold
      FROM (SELECT DISTINCT cluster FROM {src})""", src)
    cte(name, f"""SELECT s.*, f.fold, (mass - mx)*w + my AS oof FROM {src} s JOIN {name}_f f USING (cluster) JOIN
      (SELECT k.k, avg(mass) AS mx, avg(truth) AS my, covar_pop(mass, truth)*count(*)/(var_pop(mass)*count(*) + 1) AS w
       FROM {src} JOIN {name}_f USING (cluster), range(5) k(k) WHERE fold <> k.k GROUP BY k.k) h ON h.k = f.fold""", src, f"{name}_f")


oof_ctes("oof_fit", "fit_rows")
oof_ctes("oof_pool", "x_pool")


@query("oof_predictions", with_ctes("SELECT id, fold, round(oof, 3) AS oof FROM oof_fit", "oof_fit"))
def oof_predictions(spark, sf):
    rows = x_rows(spark, sf).filter("role = 'fit'")
    folds = deal_round_robin(cluster_sizes(rows), 5)
    return out_of_fold(rows, folds, "mass", "truth").select("id", "fold", F.round("oof", 3).alias("oof"))


@query("learned_error_oof", with_ctes("""WITH h AS (SELECT avg(spread) AS hx, avg(e) AS hy, covar_pop(spread, e)*count(*)/(var_pop(spread)*count(*) + 1) AS hw
    FROM (SELECT spread, abs(oof - truth) AS e FROM oof_pool))
  SELECT id, round((spread - hx)*hw + hy, 3) AS learned_error_oof FROM x_test, h""", "oof_pool", "x_test"))
def learned_error_oof(spark, sf):
    """Error head on out-of-fold errors of the whole pool."""
    rows = x_rows(spark, sf)
    pool = rows.filter("role <> 'test'")
    oof = out_of_fold(pool, deal_round_robin(cluster_sizes(pool), 5), "mass", "truth")
    head = fit_line(oof.withColumn("e", F.abs(F.col("oof") - F.col("truth"))), "spread", "e", 1.0)
    return rows.filter("role = 'test'").select("id", F.round(head.predict(F.col("spread")), 3).alias("learned_error_oof"))
