"""Readers for entity files: ragged records, lookup tables and id lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Markers of the ragged record format and the limits of a plausible record.
RECORD_PREFIX = "dish_"
PART_PREFIX = "ingr_"
MEASURES = ["cal", "mass", "fat", "carb", "protein"]
MAX_MASS, MAX_TRUTH = 5000.0, 5000.0

_QUOTED_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def fields(line: Column) -> Column:
    """Comma-separated fields of a line; quoted fields may hold commas."""
    plain = F.split(line, ",")
    unquote = lambda f: F.when(F.length(f) >= 2, F.regexp_replace(
        F.regexp_replace(f, '^"(.*)"$', "$1"), '""', '"')).otherwise(f)
    return F.when(F.contains(line, F.lit('"')), F.transform(F.split(line, _QUOTED_COMMA), unquote)).otherwise(plain)


#: A decimal number as the record format writes it; a cast alone would also take suffixes such as ``5d``.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A double where the text is a plain number, else null."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


#: Order of the lines of text files, with ``_metadata`` of the source: file, place of the block in it, then position in the block.
def file_order(file: int = 0) -> Column:
    return F.struct(F.lit(file).alias("file"), F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def parse_records(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Ragged header-less records: id, five measures, then parts of any length. ``keep`` columns of the lines follow.

    A part starts at a token with the part prefix; its last five tokens are numbers and the tokens between
    are its name, which may hold commas. A bad part is skipped, a bad measure drops the record.
    """
    toks = lines.select(*keep, fields(F.col(line)).alias("t"))
    toks = toks.filter((F.size("t") >= 6) & F.startswith(F.col("t")[0], F.lit(RECORD_PREFIX)))
    starts = F.filter(F.sequence(F.lit(1), F.size("t")),
                      lambda i: F.startswith(F.element_at("t", i), F.lit(PART_PREFIX)))
    rows = toks.select(
        F.col("t")[0].alias("id"), *[number(F.col("t")[i + 1]).alias(m) for i, m in enumerate(MEASURES)],
        *keep, "t", starts.alias("a")).dropna(subset=MEASURES)
    ends = F.concat(F.expr("slice(a, 2, greatest(size(a) - 1, 0))"), F.array(F.size("t") + 1))
    segments = F.zip_with("a", ends, lambda s, e: F.slice(F.col("t"), s, e - s))
    at = lambda seg, i: number(F.element_at(seg, i))
    parts = F.transform(F.filter(segments, lambda s: F.size(s) >= 7), lambda s: F.struct(
        F.trim(F.array_join(F.slice(s, F.lit(2), F.size(s) - 6), " ")).alias("name"),
        at(s, -5).alias("grams"), at(s, -4).alias("amount")))
    good = F.filter(parts, lambda p: p["grams"].isNotNull() & p["amount"].isNotNull())
    return rows.select("id", *MEASURES, good.alias("parts"), *keep)


def last_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of tables where the later table wins on a repeated key; aggregated, so no sort per key."""
    tagged = [p.select(F.col(key), F.struct(*[c for c in p.columns if c != key]).alias("_row"), F.lit(i).alias("_at"))
              for i, p in enumerate(parts)]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy(key).agg(F.max_by("_row", "_at").alias("_row")).select(key, "_row.*")


def plausible(mass: Column, truth: Column, max_mass: float = MAX_MASS, max_truth: float = MAX_TRUTH) -> Column:
    return (mass > 0) & (mass < max_mass) & (truth >= 0) & (truth < max_truth)


def read_records(spark: SparkSession, paths: list[str], drop_implausible: bool = True) -> DataFrame:
    """Records of several files; on a repeated id the last file wins, and the last line inside a file."""
    parts = [parse_records(spark.read.text(p).select("value", file_order(i).alias("_order")), keep=("_order",)) for i, p in enumerate(paths)]
    union = reduce(DataFrame.unionByName, parts)
    fields_ = [c for c in union.columns if c not in ("id", "_order")]
    out = union.groupBy("id").agg(F.max_by(F.struct(*fields_), "_order").alias("_row")).select("id", "_row.*")
    return out.filter(plausible(F.col("mass"), F.col("cal"))) if drop_implausible else out


def clean_lookup(raw: DataFrame, name: str, numbers: list[str], order: str) -> DataFrame:
    """Lookup table from text columns: trimmed names, rows with a bad number skipped, last duplicate wins."""
    typed = raw.select(F.trim(F.col(name)).alias(name), order, *[number(F.col(n)).alias(n) for n in numbers])
    typed = typed.dropna(subset=numbers)
    return typed.groupBy(name).agg(*[F.max_by(n, order).alias(n) for n in numbers])


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """The part lookup file. Columns: name, cal_g, fat_g, carb_g, protein_g."""
    schema = "ingr string, id string, cal_g string, fat_g string, carb_g string, protein_g string"
    raw = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    raw = raw.select("*", file_order().alias("_at"))
    return clean_lookup(raw, "ingr", ["cal_g", "fat_g", "carb_g", "protein_g"], "_at").withColumnRenamed("ingr", "name")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Id list, one per line; blanks dropped, file order kept in ``position``."""
    lines = spark.read.text(path).select(F.trim("value").alias("id"), file_order().alias("position"))
    return lines.filter("id <> ''")


def id_seconds(ident: Column) -> Column:
    """Unix seconds inside an id such as ``dish_1551235699``."""
    return F.split_part(ident, F.lit("_"), F.lit(2)).cast("bigint")


def usable(ids: DataFrame, items: DataFrame, available: DataFrame, key: str = "id") -> DataFrame:
    """Ids of a split that are plausible and available."""
    return ids.join(items.select(key), key, "left_semi").join(available.select(key), key, "left_semi")
