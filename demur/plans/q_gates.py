"""Queries: wide features (statistics, heads, gates) and image metrics, on the embedding vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from demur.functions.draws import uniform
from demur.operators.gates import BLENDED, fit_gates
from demur.operators.neighbours import knn_distance
from demur.operators.quality import METRICS, measure, response
from demur.operators.stats import ALPHA_GRID, EPSILON, gram, on_each, pick_alpha, standardise
from demur.sources.staging import stage_once

from .registry import cte, query, u, with_ctes
from .views import table

DIM = 64
_ROLE = f"CASE WHEN {u(chr(39) + 'vec-role' + chr(39), 'vec_id')} < 0.5 THEN 'fit' WHEN {u(chr(39) + 'vec-role' + chr(39), 'vec_id')} < 0.75 THEN 'calib' ELSE 'test' END"
cte("vecs", f"SELECT vec_id AS id, embedding::DOUBLE[] AS x, label::DOUBLE AS y, {_ROLE} AS role FROM embeddings")
cte("dims", "SELECT id, role, unnest(x) AS v, unnest(range(64)) AS dim FROM vecs", "vecs")
cte("moments", "SELECT dim, avg(v) AS m, stddev_pop(v) + 1e-8 AS s FROM dims WHERE role = 'fit' GROUP BY dim", "dims")


def vectors(spark, sf):
    draw = uniform("vec-role", F.col("vec_id"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"),
        (F.col("label") * F.col("label")).cast("double").alias("y2"),
        F.when(draw < 0.5, "fit").when(draw < 0.75, "calib").otherwise("test").alias("role"),
        F.floor(uniform("vec-fold", F.col("vec_id")) * 5).cast("int").alias("fold"))


def fit_side(spark, sf):
    return vectors(spark, sf).filter("role = 'fit'")


STEPS = 800


def solve_sql(name: str, source: str, *needs: str) -> None:
    """CTE ``name`` (k, alpha, w): per system k and alpha the solution of (sum of centred x x' + alpha I) w = sum of centred x y.

    ``source`` gives rows (k, alpha, id, x, y). Richardson steps with the inverse of the Frobenius norm converge, as the matrix is positive.
    """
    cte(f"{name}_src", source, *needs)
    cte(f"{name}_cent", f"""SELECT k, id, y, dim, v - avg(v) OVER (PARTITION BY k, dim) AS c FROM
      (SELECT k, id, y, unnest(x) AS v, unnest(range({DIM})) AS dim FROM (SELECT DISTINCT k, id, x, y FROM {name}_src))""", f"{name}_src")
    cte(f"{name}_mat", f"""SELECT k, i, list(s ORDER BY j) AS r, sum(s*s) AS q FROM (SELECT a.k, a.dim AS i, b.dim AS j, sum(a.c*b.c) AS s
      FROM {name}_cent a JOIN {name}_cent b ON a.k = b.k AND a.id = b.id GROUP BY 1, 2, 3) GROUP BY 1, 2""", f"{name}_cent")
    cte(f"{name}_sys", f"""SELECT m.k, al.alpha, m.m, m.fro + al.alpha AS top, r.b FROM
      (SELECT k, list(r ORDER BY i) AS m, sqrt(sum(q)) AS fro FROM {name}_mat GROUP BY k) m JOIN
      (SELECT k, list(b ORDER BY dim) AS b FROM (SELECT k, dim, sum(c*y) AS b FROM {name}_cent GROUP BY k, dim) GROUP BY k) r USING (k) JOIN
      (SELECT DISTINCT k, alpha FROM {name}_src) al USING (k)""", f"{name}_mat", f"{name}_cent", f"{name}_src")
    cte(name, richardson(f"{name}_sys"), f"{name}_sys")


def richardson(system: str) -> str:
    """Rows (k, alpha, w) of the last step for a table of systems (k, alpha, m, top, b)."""
    return f"""SELECT k, alpha, w FROM (WITH RECURSIVE step(n, k, alpha, w) AS (
      SELECT 0, k, alpha, list_transform(range({DIM}), lambda i: 0.0::DOUBLE) FROM {system} UNION ALL
      SELECT n + 1, s.k, s.alpha, list_transform(range({DIM}), lambda i: w[i + 1] + (b[i + 1] - list_dot_product(m[i + 1], w) - s.alpha*w[i + 1])/top)
      FROM step s JOIN {system} y ON y.k = s.k AND y.alpha = s.alpha WHERE n < {STEPS}) SELECT * FROM step) WHERE n = {STEPS}"""


solve_sql("ridge1", "SELECT t AS k, 1.0::DOUBLE AS alpha, id, x, CASE t WHEN 0 THEN y ELSE y*y END AS y FROM vecs, range(2) r(t) WHERE role = 'fit'", "vecs")
_GRID = ", ".join(f"({10 ** (i / 4)!r}::DOUBLE)" for i in range(25))
solve_sql("ridge_grid", f"SELECT 0 AS k, alpha, id, x, y FROM vecs, (VALUES {_GRID}) g(alpha) WHERE role = 'fit'", "vecs")
cte("vec_folds", f"SELECT *, floor({u(chr(39) + 'vec-fold' + chr(39), 'id')} * 5)::INT AS fold FROM vecs", "vecs")
solve_sql("ridge_fold", "SELECT k::INT AS k, 1.0::DOUBLE AS alpha, id, x, y FROM vec_folds, range(5) r(k) WHERE fold <> k", "vec_folds")
cte("fold_means", f"SELECT k, list(m ORDER BY dim) AS mx, any_value(my) AS my FROM (SELECT k, dim, avg(v) AS m, avg(y) AS my FROM (SELECT k, y, unnest(x) AS v, "
    f"unnest(range({DIM})) AS dim FROM ridge_fold_src) GROUP BY k, dim) GROUP BY k", "ridge_fold_src")
cte("vec_z", "SELECT id, role, list((v - m)/s ORDER BY dim) AS z FROM dims JOIN moments USING (dim) GROUP BY id, role", "dims", "moments")
cte("z_mat", """SELECT i, list(s ORDER BY j) AS r, sum(s*s) AS q FROM (SELECT a.dim AS i, b.dim AS j, sum(a.c*b.c)/(count(*) - 1) AS s FROM
    (SELECT id, dim, (v - m)/s AS c FROM dims JOIN moments USING (dim) WHERE role = 'fit') a JOIN
    (SELECT id, dim, (v - m)/s AS c FROM dims JOIN moments USING (dim) WHERE role = 'fit') b USING (id) GROUP BY 1, 2) GROUP BY i""", "dims", "moments")
cte("z_sys", f"""SELECT k, 0.0::DOUBLE AS alpha, m, sqrt(fro) AS top, list_transform(range({DIM}), lambda i: (i = k)::INT::DOUBLE) AS b
  FROM (SELECT list(r ORDER BY i) AS m, sum(q) AS fro FROM z_mat), range({DIM}) t(k)""", "z_mat")
cte("z_inverse", f"SELECT list(w ORDER BY k) AS inv FROM ({richardson('z_sys')})", "z_sys")


@query("gram_stats", with_ctes("""SELECT a.dim::INT AS i, b.dim::INT AS j, round(sum(a.v*b.v), 6) AS v FROM dims a JOIN dims b USING (id)
  WHERE a.role = 'fit' GROUP BY 1, 2""", "dims"))
def gram_stats(spark, sf):
    """Second moments of the features: one partial matrix per task, added up on the row index."""
    st = gram(fit_side(spark, sf), "x", ["y"])[None]
    raw = st.sxx + st.n * (st.mx[:, None] * st.mx[None, :])
    rows = [(i, [float(v) for v in raw[i]]) for i in range(len(raw))]
    long = spark.createDataFrame(rows, "i int, r array<double>").select("i", F.posexplode("r").alias("j", "v"))
    return long.select("i", "j", F.round("v", 6).alias("v"))


def scaled_vectors(spark, sf):
    st = gram(fit_side(spark, sf), "x", ["y"])[None]
    return vectors(spark, sf).withColumn("z", standardise(F.col("x"), st.mx, st.sd + EPSILON))


@query("standardise", with_ctes("SELECT id, dim::INT AS dim, round((v - m)/s, 6) AS z FROM dims JOIN moments USING (dim)", "dims", "moments"))
def standardised(spark, sf):
    return scaled_vectors(spark, sf).select("id", F.posexplode("z").alias("dim", "z")).withColumn("z", F.round("z", 6))


@query("zdist_diag", with_ctes("SELECT id, round(sqrt(sum(((v - m)/s)*((v - m)/s))), 6) AS dist FROM dims JOIN moments USING (dim) GROUP BY id",
                               "dims", "moments"))
def zdist_diag(spark, sf):
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v)
    return scaled_vectors(spark, sf).select("id", F.round(F.sqrt(total), 6).alias("dist"))


@query("knn_dist", with_ctes("""SELECT id, round(avg(d), 6) AS knn_dist FROM (SELECT q.id, list_distance(q.x, f.x) AS d,
    row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, f.x)) AS r FROM vecs q, vecs f WHERE f.role = 'fit') WHERE r <= 10 GROUP BY id""",
    "vecs"))
def knn_dist(spark, sf):
    return knn_distance(vectors(spark, sf), fit_side(spark, sf), "x", "id").withColumn("knn_dist", F.round("knn_dist", 6))


@query("ridge_fit", with_ctes(f"SELECT unnest(range({DIM}))::INT AS dim, round(unnest(w), 6) AS w FROM ridge1 WHERE k = 0", "ridge1"))
def ridge_fit(spark, sf):
    """Weights of the closed-form ridge."""
    w = gram(fit_side(spark, sf), "x", ["y"])[None].ridge(1.0)[:, 0]
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(w)], "dim int, w double")


@query("ridge_multi", with_ctes(f"SELECT unnest(range({DIM}))::INT AS dim, k::INT AS target, round(unnest(w), 5) AS w FROM ridge1", "ridge1"))
def ridge_multi(spark, sf):
    w = gram(fit_side(spark, sf), "x", ["y", "y2"])[None].ridge(1.0)
    return spark.createDataFrame([(i, t, round(float(w[i, t]), 5)) for i in range(len(w)) for t in range(2)], "dim int, target int, w double")


@query("alpha_grid", with_ctes(f"""WITH mu AS (SELECT list(m ORDER BY dim) AS mx, any_value(my) AS my FROM (SELECT dim, avg(v) AS m, avg(y) AS my FROM
      (SELECT y, unnest(x) AS v, unnest(range({DIM})) AS dim FROM vecs WHERE role = 'fit') GROUP BY dim)),
    e AS (SELECT alpha, avg(abs(my + list_dot_product(x, w) - list_dot_product(mx, w) - y)) AS mae FROM ridge_grid, mu, vecs WHERE role = 'calib' GROUP BY alpha)
  SELECT alpha, round(mae, 6) AS mae, row_number() OVER (ORDER BY mae, alpha) = 1 AS best FROM e""", "ridge_grid", "vecs"))
def alpha_grid(spark, sf):
    """Calibration error of every penalty; one Gram and one scoring pass for all of them."""
    fit = gram(fit_side(spark, sf), "x", ["y"])[None]
    best, mae = pick_alpha(fit, vectors(spark, sf).filter("role = 'calib'"), "x", "y")
    return spark.createDataFrame([(float(a), round(float(m), 6), a == best) for a, m in zip(ALPHA_GRID, mae)],
                                 "alpha double, mae double, best boolean")


def scored(spark, sf):
    def build():
        v = vectors(spark, sf)
        g = fit_gates(v.filter("role = 'fit'"), v.filter("role = 'calib'"), "x", ["y", "y2"], "id")
        return g.score(v).drop("x").withColumn("err", F.abs(F.col("pred0") - F.col("y")))
    return stage_once(spark, f"{sf}:gates", build, sf)


@query("gate_scores")
def gate_scores(spark, sf):
    """All model gates of every row, in one projection with the fitted parameters."""
    return scored(spark, sf)


@query("mahalanobis", with_ctes("""SELECT id, round(sqrt(list_sum(list_transform(range(64), lambda i: z[i + 1]*list_dot_product(inv[i + 1], z)))), 6) AS mahalanobis
  FROM vec_z, z_inverse""", "vec_z", "z_inverse"))
def mahalanobis(spark, sf):
    return scored(spark, sf).select("id", F.round("mahalanobis", 6).alias("mahalanobis"))


@query("ensemble_spread")
def ensemble_spread(spark, sf):
    return scored(spark, sf).select("id", F.round("ensemble_spread", 6).alias("ensemble_spread"))


@query("blend")
def blend(spark, sf):
    return scored(spark, sf).select("id", *BLENDED, "blend")


@query("crossfit_wide", with_ctes("""SELECT id, fold, y, round(pred, 6) AS pred, round(abs(pred - y), 6) AS err FROM (SELECT id, fold, y,
    my + list_dot_product(x, w) - list_dot_product(mx, w) AS pred FROM vec_folds v JOIN ridge_fold r ON r.k = v.fold JOIN fold_means f ON f.k = v.fold)""",
    "vec_folds", "ridge_fold", "fold_means"))
def crossfit_wide(spark, sf):
    """Cross-fitted ridge on all features: one scan for the matrices of all folds, pools solved on the executors, one scan to score."""
    v = vectors(spark, sf)
    heads = on_each(v, "x", ["y"], lambda s: {"w": s.ridge(1.0)[:, 0], "mx": s.mx, "my": s.my[0]}, "w array<double>, mx array<double>, my double",
                    key="fold", leave_out=True)
    found = {int(r["key"]): (np.array(r["w"]), np.array(r["mx"]), r["my"]) for r in heads.collect()}  # a row per fold

    @F.pandas_udf("double")
    def predict(x: pd.Series, fold: pd.Series) -> pd.Series:
        out, rows, of = np.zeros(len(x)), np.vstack(x.to_numpy()) if len(x) else None, fold.to_numpy()
        for k in np.unique(of):
            w, mx, my = found[int(k)]
            out[of == k] = (rows[of == k] - mx) @ w + my
        return pd.Series(out)

    out = v.select("id", "fold", "y", predict("x", "fold").alias("pred"))
    return out.withColumn("err", F.round(F.abs(F.col("pred") - F.col("y")), 6)).withColumn("pred", F.round("pred", 6))


# ---- image metrics on 4 x 16 images cut from the vectors
H, W = 4, 16
_PIX = "least(255, greatest(0, floor(128.5 + 300*x[{i}])))::INT"
cte("pix", f"""SELECT id, y, (i // {W}) AS py, (i % {W}) AS px, {_PIX.format(i='i + 1')} AS r, {_PIX.format(i='64 - i')} AS g,
  {_PIX.format(i='((i + 16) % 64) + 1')} AS b FROM vecs, range(64) t(i)""", "vecs")
cte("gray", "SELECT *, (r*19595 + g*38470 + b*7471 + 32768)//65536 AS v FROM pix", "pix")
cte("img", """WITH p AS (SELECT id, avg(v) AS brightness, stddev_pop(v) AS rms_contrast, avg(r)/nullif(avg(b), 0) AS colour_rb,
      avg((greatest(r, g, b) - least(r, g, b))/greatest(greatest(r, g, b), 1.0)) AS saturation FROM gray GROUP BY id),
    n AS (SELECT c.id, l.v AS l, r.v AS r, t.v AS t, d.v AS d, c.v AS c FROM gray c JOIN gray l ON l.id = c.id AND l.py = c.py AND l.px = c.px - 1
      JOIN gray r ON r.id = c.id AND r.py = c.py AND r.px = c.px + 1 JOIN gray t ON t.id = c.id AND t.px = c.px AND t.py = c.py - 1
      JOIN gray d ON d.id = c.id AND d.px = c.px AND d.py = c.py + 1),
    s AS (SELECT id, var_pop(l + r + t + d - 4*c) AS lap_var, avg((r - l)*(r - l) + (d - t)*(d - t)) AS tenengrad FROM n GROUP BY id),
    k AS (SELECT a.id, avg(abs(b.v - a.v)) FILTER (WHERE a.px % 8 = 7)/avg(abs(b.v - a.v)) FILTER (WHERE a.px % 8 <> 7) - 1 AS blockiness
      FROM gray a JOIN gray b ON b.id = a.id AND b.py = a.py AND b.px = a.px + 1 GROUP BY a.id),
    f AS (SELECT id, fu, fv, pow(sum((v - brightness)*cos(2*pi()*(fu*py/4.0 + fv*px/16.0))), 2)
        + pow(sum((v - brightness)*sin(2*pi()*(fu*py/4.0 + fv*px/16.0))), 2) AS pw
      FROM gray JOIN p USING (id), range(-2, 2) a(fu), range(-8, 8) c(fv) GROUP BY id, fu, fv),
    h AS (SELECT id, sum(pw) FILTER (WHERE sqrt(pow(fu/2.0, 2) + pow(fv/8.0, 2)) > 0.25)/sum(pw) AS hf_ratio FROM f GROUP BY id)
  SELECT * FROM p JOIN s USING (id) JOIN k USING (id) JOIN h USING (id)""", "gray")


def images(spark, sf):
    """Rows in the shape of the image source: 8-bit blue-green-red pixels."""
    level = lambda i: f"cast(least(255, greatest(0, floor(128.5 + 300 * x[{i}]))) as int)"
    byte = lambda i: f"lpad(hex({level(i)}), 2, '0')"
    pixel = f"concat({byte('(i + 16) % 64')}, {byte('63 - i')}, {byte('i')})"
    data = F.expr(f"unhex(array_join(transform(sequence(0, 63), i -> {pixel}), ''))")
    return vectors(spark, sf).select("id", "y", F.lit(H).alias("height"), F.lit(W).alias("width"), data.alias("data"))


_METRIC_SQL = ", ".join(f"round({m}, 5) AS {m}" for m in METRICS)


@query("img_metrics", with_ctes(f"SELECT id, {_METRIC_SQL} FROM img", "img"))
def img_metrics(spark, sf):
    return measure(images(spark, sf)).select("id", *[F.round(m, 5).alias(m) for m in METRICS])


@query("metric_response", with_ctes("SELECT y AS label, count(*) AS n, " + ", ".join(f"round(avg({m}), 5) AS {m}" for m in METRICS)
                                    + " FROM img JOIN vecs USING (id) GROUP BY y", "img", "vecs"))
def metric_response(spark, sf):
    """Mean response of every metric per group of images."""
    got = response(measure(images(spark, sf)).withColumnRenamed("y", "label"), ["label"])
    return got.select("label", "n", *[F.round(m, 5).alias(m) for m in METRICS])


@query("image_scan", with_ctes("""SELECT id, round(avg(r), 6) AS red, round(avg(g), 6) AS green, round(avg(b), 6) AS blue FROM pix GROUP BY id""", "pix"))
def image_scan(spark, sf):
    """Channel means of image rows, as metrics given by the caller; the byte order is blue, green, red."""
    channel = lambda c: lambda gray, rgb: rgb[..., c].mean()
    got = measure(images(spark, sf), {"red": channel(0), "green": channel(1), "blue": channel(2)})
    return got.select("id", *[F.round(c, 6).alias(c) for c in ("red", "green", "blue")])


# ---- the 64 values of a vector as an 8 x 8 gray grid
def grid(spark, sf):
    return vectors(spark, sf).select("id", F.col("x").alias("g"))


def _mean(col, n=DIM):
    return F.aggregate(col, F.lit(0.0), lambda a, v: a + v) / n


@query("grid_brightness", with_ctes("SELECT id, round(list_avg(x), 8) AS brightness FROM vecs", "vecs"))
def grid_brightness(spark, sf):
    return grid(spark, sf).select("id", F.round(_mean("g"), 8).alias("brightness"))


@query("grid_contrast", with_ctes("SELECT id, round(stddev_pop(v), 8) AS contrast FROM dims GROUP BY id", "dims"))
def grid_contrast(spark, sf):
    m = grid(spark, sf).withColumn("m", _mean("g"))
    return m.select("id", F.round(F.sqrt(_mean(F.transform("g", lambda v: (v - F.col("m")) * (v - F.col("m"))))), 8).alias("contrast"))


@query("grid_lapvar", with_ctes("""SELECT id, round(var_pop(x[i - 8] + x[i + 8] + x[i - 1] + x[i + 1] - 4*x[i]), 8) AS lapvar
  FROM vecs, range(1, 65) t(i) WHERE (i - 1)//8 BETWEEN 1 AND 6 AND (i - 1)%8 BETWEEN 1 AND 6 GROUP BY id""", "vecs"))
def grid_lapvar(spark, sf):
    inner = F.array(*[F.lit(r * 8 + c + 1) for r in range(1, 7) for c in range(1, 7)])
    at = lambda i: F.element_at("g", i)
    lap = grid(spark, sf).withColumn("l", F.transform(inner, lambda i: at(i - 8) + at(i + 8) + at(i - 1) + at(i + 1) - 4 * at(i)))
    lap = lap.withColumn("m", _mean("l", 36))
    return lap.select("id", F.round(_mean(F.transform("l", lambda v: (v - F.col("m")) * (v - F.col("m"))), 36), 8).alias("lapvar"))
