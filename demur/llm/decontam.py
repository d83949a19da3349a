r"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item. Words become 64-bit hashes, and neighbouring hashes are hashed to k-gram hashes (k = ``GRAM``). Of the
k-grams in every window the one with the least hash is kept, once per run of windows that share it: its hash and position are a fingerprint, on the side of
the documents and of the benchmark alike. What is least depends on the words of a window alone, so a document and an item that share a window share its fingerprint,
wherever the window lies. Fingerprints are joined on the hash alone; every meeting is then extended left and right word by word, up to a window's length
around the k-gram, and counts where the words that agree make up a window. Longer shared spans meet in several fingerprints, whose extensions overlap.

Items shorter than a window are one window of their own length; those few lengths (below ``window``) are looked up by hashes of all their words.

The benchmark side is broadcast only where its fingerprints, a row per item and place, are counted to be at most ``BROADCAST_WINDOWS``; beyond it Spark joins by
shuffling, where adaptive execution splits keys that many documents share.

Rows: null and empty texts, or texts without words, have no words and no hits; an item without words is no item; repeated
items count each; repeated document ids are merged into one row with the hits of all their texts and the most words; every row without an id is a document of its own
and gives a row; an empty
benchmark leaves all documents clean; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from demur.sources.staging import stage

from .common import ascii_lower, told_apart

WINDOW, GRAM = 10, 6
#: Benchmark fingerprints that may be broadcast, about 200 bytes each with the words around them.
BROADCAST_WINDOWS = 400_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words by cutting at runs of everything else; only the first and last piece can be empty."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _hashes(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the array ``w`` of word hashes, empty for a null text."""
    return df.select(*keep, F.transform(words(F.coalesce(F.col("text"), F.lit(""))), lambda w: F.xxhash64(w)).alias("w"))


def _tagged(window: int, gram: int) -> Column:
    """The k-gram hashes of ``w`` without their lowest bits, which have room for a place in a window."""
    free = (window - gram).bit_length()
    h = lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(gram)])
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - gram), lambda i: F.shiftleft(F.shiftright(h(i), free), free))
    return F.when(F.size("w") >= gram, grams)


def _print(at: Column, window: int, gram: int) -> tuple[Column, Column]:
    """The least hash of ``g`` in the window at ``at``, and the place of its k-gram; of equal ones the last."""
    last = window - gram
    free = last.bit_length()
    tagged = [F.get("g", at + j) + F.lit(last - j).cast("long") for j in range(last + 1)]
    least = F.least(*tagged) if last else tagged[0]
    return F.shiftright(least, free), at + (last - least.bitwiseAND(F.lit((1 << free) - 1).cast("long"))).cast("int")


def fingerprints(df: DataFrame, *keep: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``keep``, print, at (place of the k-gram) and ``w`` of every fingerprint; and a row with at -1 per row of df.

    Positions are exploded beside the array, which later projections read and drop, so that no array is copied. A window is left out where the one before it
    has the same k-gram.
    """
    return _prints(_hashes(df, *keep), window, gram, *keep)


def _prints(hashed: DataFrame, window: int, gram: int, *keep: str) -> DataFrame:
    start = F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - window, F.lit(-1))))
    # Hashes of k-grams are made once per text: as expressions of every position they would be too long to compile.
    rows = hashed.withColumn("g", _tagged(window, gram)).select(*keep, "w", "g", start.alias("start"))
    least, at = _print(F.col("start"), window, gram)
    before = _print(F.col("start") - 1, window, gram)[1]
    named = rows.select(*keep, "w", "start", least.alias("print"), at.alias("place"), before.alias("place before"))
    named = named.where((F.col("start") <= 0) | (F.col("place") != F.col("place before")))
    real = F.col("start") >= 0
    return named.select(*keep, F.when(real, F.col("print")).otherwise(F.xxhash64("start", *keep)).alias("print"), F.when(real, F.col("place")).otherwise(F.lit(-1)).alias("at"), "w")


def _around(at: Column, window: int, gram: int) -> list[Column]:
    """Words up to a window's length around the k-gram at ``at``, null beyond the ends: those before it from the nearest on, then those from its first word on."""
    reach = window - gram
    word = lambda i: F.when(i >= 0, F.get("w", i))
    return [word(at - 1 - i) for i in range(reach)] + [word(at + i) for i in range(window)]


def _alike(mine: list[Column], theirs: list[Column]) -> Column:
    """How many words agree from the first on."""
    out = F.lit(0)
    for a, b in reversed(list(zip(mine, theirs))):
        out = F.when(a == b, out + 1).otherwise(0)
    return out


def _whole(at: Column, width: int) -> tuple[Column, Column]:
    """Two hashes of all words of the window of ``width`` words at ``at``."""
    word = [F.get("w", at + j) for j in range(width)]
    return F.xxhash64(*word), F.xxhash64(F.lit(width), *word)


#: What tells documents apart: the id and, where it is null, the number of the row.
DOCUMENT = ["doc_id", "lone_row"]


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join on DOCUMENT where null ids are equal."""
    right = right.withColumnsRenamed({"doc_id": "other_id", "lone_row": "other_row"})
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("lone_row") == F.col("other_row"))
    return left.join(right, same, "left").drop("other_id", "other_row")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_prints: int | None = None) -> DataFrame:
    """Per document: n_words, n_hit (words inside any window of an item), the sorted items with windows in it, and whether any."""
    broadcast_prints = BROADCAST_WINDOWS if broadcast_prints is None else broadcast_prints
    sized = stage(_hashes(items, "item_id").where(F.size("w") > 0), "items")
    lengths = sorted(r["n"] for r in sized.where(F.size("w") < window).select(F.size("w").alias("n")).distinct().collect())  # fewer than ``window`` numbers
    reach = window - gram
    known = stage(_prints(sized.where(F.size("w") >= window), window, gram, "item_id").where("at >= 0").select("item_id", "print", F.array(*_around(F.col("at"), window, gram)).alias("words")), "benchmark")
    docs = told_apart(docs.select("doc_id", "text"))
    small = lambda df: F.broadcast(df) if df.limit(broadcast_prints + 1).count() <= broadcast_prints else df
    few = known.limit(broadcast_prints + 1).count() <= broadcast_prints
    # Only the words around a k-gram go on; whole texts would be copied with every row.
    rows = fingerprints(docs, *DOCUMENT, window=window, gram=gram).select(
        *DOCUMENT, "print", "at", F.size("w").alias("n_words"), F.array(*_around(F.col("at"), window, gram)).alias("mine"))
    met = rows.join(F.broadcast(known) if few else known, "print", "left").where((F.col("at") < 0) | F.col("item_id").isNotNull())
    met = stage(met.select(*DOCUMENT, "at", "n_words", "mine", "words", "item_id"), "met")
    left = _alike([F.get("mine", F.lit(i)) for i in range(reach)], [F.get("words", F.lit(i)) for i in range(reach)])
    right = _alike([F.get("mine", F.lit(reach + i)) for i in range(window)], [F.get("words", F.lit(reach + i)) for i in range(window)])
    grown = met.select(*DOCUMENT, "at", "n_words", "item_id", left.alias("left"), right.alias("right"))
    grown = grown.where((F.col("at") < 0) | (F.col("right") >= gram) & (F.col("left") + F.col("right") >= window))
    found = grown.select(*DOCUMENT, F.when(F.col("at") < 0, F.lit(-1)).otherwise(F.col("at") - F.col("left")).alias("pos"),
                         F.when(F.col("at") < 0, F.col("n_words")).otherwise(F.col("left") + F.col("right")).alias("width"), "item_id")
    for n in lengths:
        whole = [h.alias(c) for h, c in zip(_whole(F.lit(0), n), ("print", "check"))]
        keys = stage(sized.where(F.size("w") == n).select("item_id", *whole), "short")
        at = F.explode(F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)))
        places = _hashes(docs, *DOCUMENT).select(*DOCUMENT, "w", at.alias("pos")).select(*DOCUMENT, "pos", *[h.alias(c) for h, c in zip(_whole(F.col("pos"), n), ("print", "check"))])
        found = found.unionByName(places.join(small(keys), ["print", "check"]).select(*DOCUMENT, "pos", F.lit(n).alias("width"), "item_id"))
    found = stage(found, "hits")
    spans = found.where(F.col("pos") >= 0)
    before = "max(pos + width) OVER (PARTITION BY doc_id, lone_row ORDER BY pos, width ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    new = (spans.select(*DOCUMENT, "pos", "width").distinct().withColumn("covered", F.expr(before))
           .withColumn("new", F.greatest(F.lit(0), F.col("pos") + F.col("width") - F.greatest("pos", F.coalesce("covered", F.lit(0))))))
    hit_words = new.groupBy(*DOCUMENT).agg(F.sum("new").alias("n_hit"))
    pairs = spans.select(*DOCUMENT, "item_id").distinct()
    lists = pairs.groupBy(*DOCUMENT).agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    counts = found.where(F.col("pos") < 0).groupBy(*DOCUMENT).agg(F.max("width").cast("long").alias("n_words"))
    out = _beside(_beside(counts, hit_words), lists)
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
