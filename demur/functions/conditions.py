"""Condition specs such as ``blur:3+jpeg:40``: parsing, tags and enumeration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Severity ladder of every condition family (index 0 is the clean baseline) and the two
# compound conditions.
LADDER = {
    "blur": [0.0, 1.0, 2.0, 3.0, 4.0, 6.0],
    "motion": [0.0, 3.0, 5.0, 9.0, 13.0, 17.0],
    "jpeg": [95.0, 75.0, 50.0, 30.0, 20.0, 10.0],
    "downscale": [1.0, 2.0, 3.0, 4.0, 6.0, 8.0],
    "temp": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5],
    "dark": [1.0, 0.8, 0.6, 0.45, 0.3, 0.2],
    "crop": [1.0, 0.85, 0.7, 0.6, 0.5, 0.4],
    "noise": [0.0, 0.02, 0.04, 0.08, 0.12, 0.16],
}
COMPOUNDS = {
    "screenshot": [("downscale", 2.0), ("jpeg", 40.0), ("crop", 0.8)],
    "phone": [("blur", 1.0), ("jpeg", 75.0), ("temp", 0.1), ("crop", 0.85)],
}

STEPS = "array<struct<family:string,severity:double>>"


def _steps(pairs) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("family"), F.lit(float(s)).alias("severity")) for f, s in pairs])


def parse_spec(spec: Column, ladder: dict[str, list[float]] = LADDER,
               compounds: dict[str, list[tuple[str, float]]] = COMPOUNDS) -> Column:
    """Steps of a spec: empty for clean, the parts of a compound, else one per ``+`` part.

    A part without severity takes the first real step of its family. An unknown family fails the query.
    """
    text = F.trim(spec)
    default = F.create_map(*[x for f, s in ladder.items() for x in (F.lit(f), F.lit(float(s[1])))])

    def step(part: Column) -> Column:
        family = F.trim(F.split_part(part, F.lit(":"), F.lit(1)))
        given = F.split_part(part, F.lit(":"), F.lit(2))
        known = F.when(F.try_element_at(default, family).isNull(), F.raise_error(
            F.concat(F.lit("unknown condition family "), family)).cast("string")).otherwise(family)
        severity = F.when(given == "", F.try_element_at(default, family)).otherwise(given.cast("double"))
        return F.struct(known.alias("family"), severity.alias("severity"))

    out = F.when((text == "") | (text == "clean"), F.array().cast(STEPS))
    for name, pairs in compounds.items():
        out = out.when(text == name, _steps(pairs))
    return out.otherwise(F.transform(F.split(text, "\\+"), step))


def tag(spec: Column) -> Column:
    """File-safe name of a spec: no colon, ``p`` for the decimal point."""
    return F.replace(F.replace(spec, F.lit(":"), F.lit("")), F.lit("."), F.lit("p"))


def enumerate_conditions(ladders: DataFrame, compounds: list[str] = tuple(COMPOUNDS)) -> DataFrame:
    """Every condition worth running: clean once, each family's non-baseline steps, the compounds.

    ``ladders`` has columns ``family`` and ``severities`` (array, baseline first).
    """
    spark = ladders.sparkSession
    steps = ladders.select("family", F.posexplode("severities").alias("step", "severity")).filter("step >= 1")
    single = steps.select(F.concat_ws(":", "family", F.col("severity").cast("string")).alias("spec"))
    extra = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in ["clean", *compounds]])).alias("spec"))
    return extra.unionByName(single)


def ladder_table(spark) -> DataFrame:
    """The fixed ladder as a table ``(family, severities)``."""
    return spark.createDataFrame(list(LADDER.items()), "family string, severities array<double>")
