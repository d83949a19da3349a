"""The lookup ladder: how far a density table gets, given more or less of the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from demur.functions.draws import uniform
from demur.sources.staging import deal

from .ranking import medians, running

RUNGS = ["O0", "O1", "O2", "O3", "O4"]
#: Names that a broadcast may hold, three numbers each.
BROADCAST_NAMES = 1_000_000


def priors(parts: DataFrame, name: str = "name", grams: str = "grams", amount: str = "amount",
           decimals: int | None = None, rows: int | None = None) -> DataFrame:
    """Per name: median amount per gram (``density``, rows with grams only) and median grams (``typical``).

    Both medians come from one pass over the parts, with the measure as a key. ``decimals`` rounds the densities half up,
    which puts every sum of grams x density on a decimal grid; they stay as they are by default. ``rows`` is
    about how many parts there are, where that is known: they then travel once, by name, before they are doubled and counted.
    """
    g = F.col(grams).cast("double")
    measures = lambda df: df.select(name, F.inline(F.array(
        F.struct(F.lit("density").alias("measure"), F.when(g > 0, F.col(amount) / g).alias("v")),
        F.struct(F.lit("typical").alias("measure"), g.alias("v")))))
    dealt = None if rows is None else measures(deal(parts.select(name, grams, amount), rows, name))
    got = medians(measures(parts), [name, "measure"], "v", "v", dealt)
    v = F.col("v") if decimals is None else F.floor(F.col("v") * 10 ** decimals + 0.5) / 10 ** decimals
    density = F.max(F.when(F.col("measure") == "density", v))
    return got.groupBy(name).agg(
        density.alias("density"), F.max(F.when(F.col("measure") == "typical", F.col("v"))).alias("typical"))


def global_priors(items: DataFrame, truth: str = "truth", mass: str = "mass") -> tuple[float, float]:
    """Median truth per unit mass and mean truth over training items."""
    density = medians(items.select((F.col(truth) / F.col(mass)).alias("d")), [], "d", "d").first()["d"]
    return density, items.agg(F.avg(truth)).first()[0]


def ladder(parts: DataFrame, items: DataFrame, names: DataFrame, global_density: float, global_mean: float,
           ident: str = "id") -> DataFrame:
    """Five estimates per item: nothing, mass, names, names with mass, names with exact grams.

    An unknown name counts 0. Columns: the items' columns and one column per rung.
    """
    known = parts.join(names, "name", "left").select(
        ident, "grams", F.coalesce("density", F.lit(0.0)).alias("d"), F.coalesce("typical", F.lit(0.0)).alias("t"))
    sums = known.groupBy(ident).agg(
        F.sum("t").alias("_t"), F.sum(F.col("t") * F.col("d")).alias("_td"), F.sum(F.col("grams") * F.col("d")).alias("_gd"))
    joined = items.join(sums, ident, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    shared = F.when(zero("_t") > 0, F.col("_td") / F.col("_t") * F.col("mass")).otherwise(F.lit(global_mean))
    return joined.select(
        *items.columns, F.lit(float(global_mean)).alias("O0"), (F.col("mass") * F.lit(global_density)).alias("O1"),
        zero("_td").alias("O2"), shared.alias("O3"), zero("_gd").alias("O4"))


def rung_errors(estimates: DataFrame, by: list[str] = (), truth: str = "truth") -> DataFrame:
    """Mean absolute and mean absolute percentage error (truth above 1 only) per rung."""
    err = F.abs(F.col("estimate") - F.col(truth))
    long = estimates.select(*by, truth, F.inline(F.array(
        *[F.struct(F.lit(r).alias("rung"), F.col(r).alias("estimate")) for r in RUNGS])))
    return long.groupBy(*by, "rung").agg(
        F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"),
        (100 * F.avg(F.when(F.col(truth) > 1, err / F.col(truth)))).alias("mape"))


def perturbed_errors(parts: DataFrame, items: DataFrame, names: DataFrame, global_mean: float,
                     scenarios: list[tuple[float, float]], replicates: int, position: str, ident: str = "id",
                     seed: int = 760, count: int = 0) -> DataFrame:
    """Mean error of the names-with-mass rung when the mass and the names are wrong by stated amounts.

    The relative mass error is uniform on +-2 ``mass_err``, so its mean absolute value is ``mass_err``; each
    name is replaced by a uniform draw from the vocabulary with probability ``name_err``. A part has one draw per
    replicate, and it is swapped in every scenario whose threshold lies above the draw. Only draws that swap in some scenario
    look a name up and travel, as what they change; the part itself travels once, for all replicates (numbered 0). The vocabulary is
    broadcast up to ``BROADCAST_NAMES`` names, as counted; beyond that the join shuffles. ``count`` is about how many parts there are.
    """
    pool = running(names, ["name"], rank="_ord").select(
        F.col("_ord").alias("_pick"), F.coalesce("density", F.lit(0.0)).alias("_pd"), F.coalesce("typical", F.lit(0.0)).alias("_pt"))
    size = names.count()
    thresholds = sorted({float(p) for _, p in scenarios})
    known = parts.join(names, "name", "left").select(
        ident, position, F.coalesce("density", F.lit(0.0)).alias("_d"), F.coalesce("typical", F.lit(0.0)).alias("_t"))
    itself = F.col("rep") == 0
    rows = known.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn(
        "_swap", F.when(itself, F.lit(-1.0)).otherwise(uniform("swap", seed, F.col("rep"), F.col(ident), F.col(position)))).where(
        F.col("_swap") < thresholds[-1]).withColumn(
        "_pick", F.floor(uniform("pick", seed, F.col("rep"), F.col(ident), F.col(position)) * size) + 1)
    drawn = int(count * (1 + replicates * thresholds[-1]))
    rows = rows.join(F.broadcast(pool), "_pick") if size <= BROADCAST_NAMES else deal(rows, drawn, "_pick").join(pool, "_pick")
    other = lambda new, old: F.when(itself, old).otherwise(new - old)
    used = lambda c: (F.col(c) != 0).cast("int")
    rows = rows.select(ident, "rep", "_swap", other(F.col("_pt"), F.col("_t")).alias("_t"), other(used("_pt"), used("_t")).alias("_used"),
                       other(F.col("_pt") * F.col("_pd"), F.col("_t") * F.col("_d")).alias("_td"))
    dealt = deal(rows, drawn, ident)
    measures = [f"{c}{i}" for i in range(len(thresholds)) for c in ("_t", "_used", "_td")]
    sums = dealt.groupBy(ident, "rep").agg(*[
        F.sum(F.when(F.col("_swap") < p, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i, p in enumerate(thresholds) for c in ("_t", "_used", "_td")])
    every = F.when(itself, F.sequence(F.lit(1), F.lit(replicates))).otherwise(F.array("rep"))
    got = sums.withColumn("rep", F.explode(every)).groupBy(ident, "rep").agg(*[F.sum(c).alias(c) for c in measures])
    got = got.join(items.select(ident, "truth", "mass"), ident).withColumn(
        "_u", 4 * uniform("mass", seed, F.col("rep"), F.col(ident)) - 2)

    def error(m: float, p: float) -> Column:
        i = thresholds.index(float(p))
        # Parts that use nothing are counted, as their amounts may not cancel to the last digit.
        estimate = F.when((F.col(f"_used{i}") > 0) & (F.col(f"_t{i}") > 0),
                          F.col(f"_td{i}") / F.col(f"_t{i}") * F.col("mass") * (1 + F.col("_u") * float(m)))
        return F.abs(estimate.otherwise(F.lit(global_mean)) - F.col("truth"))

    each = got.groupBy("rep").agg(*[F.avg(error(m, p)).alias(f"_e{j}") for j, (m, p) in enumerate(scenarios)])
    cells = F.array(*[F.struct(F.lit(float(m)).alias("mass_err"), F.lit(float(p)).alias("name_err"), F.col(f"_e{j}").alias("mae"))
                      for j, (m, p) in enumerate(scenarios)])
    return each.select(F.inline(cells)).groupBy("mass_err", "name_err").agg(F.avg("mae").alias("mae"))
