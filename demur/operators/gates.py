"""Model-aware gates over a feature table: fit once on the fit and calibration rows, score any rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .neighbours import K, RowFiles, broadcast_fit, knn_distance, nearest_squares
from .ranking import running
from .stats import EPSILON, Stats, _matrix, gram, on_each, pick_alpha

# Heads of the ensemble and the gates the blend reads.
ENSEMBLE = 32
BLENDED = ["mahalanobis", "knn_dist", "ensemble_spread", "learned_error"]


#: Rows of a leaf of the splitting tree, and rows that are scored in one walk over the fit set.
LEAF, WALK_ROWS = 1024, 16_384


def leaf_draws(leaf: int, n: int, replicates: int, seed: int) -> np.ndarray:
    """How often each row of a leaf is drawn in every replicate, of n draws from n rows: an exact multinomial split down a binary tree.

    A node gives its draws to its halves by a binomial with the share of rows on the left; draws are keyed by (seed, replicate, node), so every task that asks for
    a leaf finds the same, and all leaves of a replicate add up to n.
    """
    leaves = -(-n // LEAF)
    out = np.empty((replicates, min(LEAF, n - leaf * LEAF)), np.int64)
    for r in range(replicates):
        lo, hi, draws, node = 0, leaves, n, 1
        while hi - lo > 1:
            middle, end = (lo + hi) // 2, min(hi * LEAF, n)
            left = np.random.default_rng([seed, r, node]).binomial(draws, (middle - lo) * LEAF / (end - lo * LEAF))
            lo, hi, draws, node = (lo, middle, left, 2 * node) if leaf < middle else (middle, hi, draws - left, 2 * node + 1)
        out[r] = np.random.default_rng([seed, r, node, 1]).multinomial(draws, np.full(out.shape[1], 1 / out.shape[1]))
    return out


def row_multiplicities(rows: DataFrame, ident: str, replicates: int = ENSEMBLE, seed: int = 760,
                       name: str = "mult") -> DataFrame:
    """Row bootstrap: an array of draws per replicate for every row, zeros included.

    Only ids are ranked and travel; the draws of a row are derived where it lies, and those of a replicate add up to the number of rows.
    """
    n = rows.count()
    numbered = running(rows.select(ident), [ident], rank="_ord")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(1).to_numpy() - 1
            out = np.empty((len(at), replicates))
            for leaf in np.unique(at // LEAF).tolist():
                if leaf not in held:
                    if len(held) > 64:
                        held.clear()
                    held[leaf] = leaf_draws(leaf, n, replicates, seed)
                mine = at // LEAF == leaf
                out[mine] = held[leaf][:, at[mine] % LEAF].T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * replicates, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "draws"])

    kind = rows.schema[ident].dataType.simpleString()
    made = numbered.select(F.col(ident).alias("id"), F.col("_ord").cast("long")).mapInArrow(drawn, f"id {kind}, draws array<double>")
    return rows.join(made.toDF(ident, name), ident)


@dataclass
class FittedGates:
    """Parameters (d-sized arrays) and the fit set; scoring is a projection over any feature table."""
    mean: np.ndarray
    scale: np.ndarray
    alphas: list[float]
    heads: np.ndarray
    intercepts: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    ensemble: np.ndarray
    ensemble_centre: np.ndarray
    ensemble_intercepts: np.ndarray
    error_head: np.ndarray
    error_centre: np.ndarray
    error_intercept: float
    fit_set: DataFrame
    x: str
    ident: str
    blend: tuple | None = None
    _held: tuple | None = None

    def model_scores(self, x: Column) -> Column:
        """Struct of predictions and linear gates, computed in one pass over the features."""
        mean, scale, directions, variances = self.mean, self.scale, self.directions, self.variances
        heads, icpt, ens, ec, ei = self.heads, self.intercepts, self.ensemble, self.ensemble_centre, self.ensemble_intercepts
        eh, ecen, eint = self.error_head, self.error_centre, self.error_intercept
        names = [f"pred{i}" for i in range(heads.shape[1])]
        held = self.held_fit_set()
        made = names + ["mahalanobis", "ensemble_spread", "learned_error"] + ["knn_dist"] * (held is not None)

        def of(z: np.ndarray) -> pd.DataFrame:
            out = dict(zip(names, (z @ heads + icpt).T))
            out["mahalanobis"] = np.sqrt((((z @ directions) ** 2) / variances).sum(1))
            each = np.column_stack([(z - ec[b]) @ ens[:, b] + ei[b] for b in range(ens.shape[1])])
            out["ensemble_spread"] = each.std(1)
            out["learned_error"] = (z - ecen) @ eh + eint
            if held is not None:
                out["knn_dist"] = np.sqrt(nearest_squares(z, held.parts(), K)).mean(1)
            return pd.DataFrame(out)

        @F.pandas_udf(", ".join(f"{n} double" for n in made))
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            # Several batches share one walk over the fit set.
            waiting, n = [], 0
            for v in batches:
                waiting.append((_matrix(v) - mean) / scale if len(v) else np.empty((0, len(mean))))
                n += len(v)
                if n >= WALK_ROWS:
                    yield of(np.concatenate(waiting))
                    waiting, n = [], 0
            if waiting:
                yield of(np.concatenate(waiting))

        return score(x)

    def held_fit_set(self) -> RowFiles | None:
        """The fit set as files where its size is under the limit, else None; made once."""
        if self._held is None:
            self._held = (broadcast_fit(self.fit_set, "z"),)
        return self._held[0]

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``pred<i>`` and all model gates, one row per row of ``rows``: an id may have several conditions."""
        scored = rows.select("*", self.model_scores(F.col(self.x)).alias("_g")).select("*", "_g.*").drop("_g")
        if self.held_fit_set() is None:
            # Rows of one id differ in their features, and the pair is the key of a distance.
            keyed = scored.withColumn("_key", F.struct(F.col(self.ident), F.xxhash64(self.x)))
            queries = _scaled(keyed.dropDuplicates(["_key"]), self.x, "_key", self.mean, self.scale)
            scored = keyed.join(knn_distance(queries, self.fit_set, "z", "_key"), "_key").drop("_key")
        out = scored.withColumn("pred_magnitude", F.col("pred0"))
        if self.blend is None:
            return out
        centre, w, c = self.blend
        blend = F.lit(float(c))
        for name, m, b in zip(BLENDED, centre, w):
            blend = blend + (F.col(name) - F.lit(float(m))) * F.lit(float(b))
        return out.withColumn("blend", blend)


def _scaled(rows: DataFrame, x: str, ident: str, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    @F.pandas_udf("array<double>")
    def z(v: pd.Series) -> pd.Series:
        return pd.Series(list((_matrix(v) - mean) / scale)) if len(v) else pd.Series([], dtype=object)
    return rows.select(ident, z(F.col(x)).alias("z"))


def fit_gates(fit: DataFrame, calib: DataFrame, x: str, ys: list[str], ident: str, replicates: int = ENSEMBLE,
              components: int = 64, seed: int = 760) -> FittedGates:
    """Standardiser, heads, distances, ensemble and error head.

    Heads see fit rows; their errors are measured on calibration rows; the error head and the blend are fit on
    those errors. Penalties are picked on calibration.
    """
    weighted = row_multiplicities(fit.select(ident, x, *ys), ident, replicates, seed, "_mult")
    plain = gram(fit, x, ys)[None]
    scale = plain.sd + EPSILON
    st = plain.scaled(scale)
    zcal = _scaled(calib, x, ident, plain.mx, scale).join(calib.select(ident, *ys), ident)
    alphas = [pick_alpha(st, zcal, "z", y, i)[0] for i, y in enumerate(ys)]
    heads = np.column_stack([Stats(st.n, st.mx, st.my[i:i + 1], st.sxx, st.sxy[:, i:i + 1]).ridge(a)[:, 0]
                             for i, a in enumerate(alphas)])
    directions, variances = st.components(components)
    centre, alpha = plain.mx, alphas[0]
    boots = on_each(weighted, x, ys[:1], lambda s: {"w": s.scaled(scale).ridge(alpha)[:, 0], "centre": (s.mx - centre) / scale, "intercept": s.my[0]},
                    "w array<double>, centre array<double>, intercept double", weights="_mult").collect()
    boots = sorted(boots, key=lambda r: int(r["key"]))
    ens, centres, icpts = ([np.array(r[c]) for r in boots] for c in ("w", "centre", "intercept"))
    head, icpt = heads[:, 0], st.my[0]

    @F.pandas_udf("double")
    def abs_error(z: pd.Series, y: pd.Series) -> pd.Series:
        return (pd.Series(_matrix(z) @ head + icpt) - y.to_numpy()).abs() if len(z) else pd.Series([], dtype=float)

    cal = zcal.withColumn("_err", abs_error(F.col("z"), F.col(ys[0]).cast("double")))
    es = gram(cal, "z", ["_err"])[None]
    out = FittedGates(plain.mx, scale, alphas, heads, st.my, directions, variances, np.column_stack(ens), np.array(centres),
                      np.array(icpts), es.ridge(alphas[0])[:, 0], es.mx, float(es.my[0]),
                      _scaled(fit, x, ident, plain.mx, scale), x, ident)
    scored = out.score(calib).withColumn("_err", F.abs(F.col("pred0") - F.col(ys[0])))
    bs = gram(scored.withColumn("_b", F.array(*BLENDED)), "_b", ["_err"])[None]
    out.blend = (bs.mx, bs.ridge(1.0)[:, 0], float(bs.my[0]))
    return out
