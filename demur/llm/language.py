"""Language by compression: the language whose dictionary shortens a text most.

Every language gets one zstandard raw-content dictionary: the distinct words of a bounded sample of its documents, the most
widespread last, cut at ``DICTIONARY_BYTES``. A text is reduced to its distinct lower-case words in order (a
repeated word compresses to nothing whatever the language), and the words are compressed in blocks with every dictionary; block sizes
add up, so the whole text counts. The smallest total wins. A block is compressed behind ``LEAD``, which holds no letter: a compressor stores
a block as it is where a match does not pay for the frame, and then a few words would show no gap in any language.

The gap to the next language is set against its spread, which grows with the root of the bytes compressed: a prediction is rejected
where the gap is under ``NARROW`` of the spread expected at that length. One rule holds at every length, and a tie is always rejected.
A tie's prediction is the language with more documents.

Learned from: ``SAMPLE_PER_LANGUAGE`` documents of every language outside the held-out fold, those of the smallest id hashes; the spread,
from beginnings of ``BEGINNINGS`` bytes of one in ``SPREAD_SHARE`` of these.

Rows: a null text, and one without a letter, is ``und`` with score 0 and rejected; documents with a null language are predicted but
never learned from; repeated rows give repeated rows; with
no learnable document every text is ``und``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held, held_out, map_text, sample_per_class

SAMPLE_PER_LANGUAGE = 1500
DICTIONARY_BYTES = 160_000
BLOCK_BYTES = 4096
LEVEL = 6
MIN_MATCH = 4
LEAD = b"0" * 64
NARROW = 0.4
BEGINNINGS, SPREAD_SHARE = (32, 128, 512), 4
#: Spread of the gap per root of a byte, where nothing can be learned.
SPREAD = 0.75
UNKNOWN = "und"
_not_letters = re.compile(r"[\W\d_]+").sub


def distinct_words(text: str | None) -> list[str]:
    return list(dict.fromkeys(_not_letters(" ", (text or "").lower()).split()))


class Dictionaries(dict):
    """language -> dictionary, and the spread of the gap in bytes per root of the bytes compressed."""
    spread = SPREAD


def learn_dictionaries(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, size: int = DICTIONARY_BYTES) -> Dictionaries:
    """language -> dictionary, languages with most documents first. Words are counted per language on the executors; the driver gets those that fit a dictionary."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen = sample_per_class(known.select("doc_id", "lang"), "lang", "doc_id", per_language)
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((lang, w) for w in distinct_words(text))
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())},
                                         schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    counted = (sample.select("lang", "text").mapInArrow(words, "lang string, word string, n long")
               .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    room = "sum(octet_length(word) + 1) OVER (PARTITION BY lang ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING)"
    kept = counted.selectExpr("lang", "word", f"{room} AS upto").where(F.col("upto") <= size).orderBy("lang", "upto").collect()
    out: dict[str, list[str]] = {}
    for row in kept:
        out.setdefault(row["lang"], []).append(row["word"])
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("lang").isin(*out)).collect()} if out else {}
    found = Dictionaries({lang: " ".join(reversed(out[lang])).encode() for lang in sorted(out, key=lambda x: (-rows[x], x))})
    found.spread = learn_spread(sample, found)
    return found


def learn_spread(sample: DataFrame, dictionaries: Dictionaries) -> float:
    """Standard deviation, per root of a byte, of the gap between a text's language and the best other, over beginnings of a few lengths.

    Gaps are whole bytes and are summed as such, so that the spread does not depend on how rows are dealt.
    """
    if len(dictionaries) < 2:
        return SPREAD
    shared, key = sample.sparkSession.sparkContext.broadcast(dictionaries), uuid.uuid4().hex

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: [0, 0, 0] for n in BEGINNINGS}
        for batch in batches:
            model = held(key, lambda: Classifier(shared.value))
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in model.langs:
                    continue
                own, data = model.langs.index(lang), " ".join(distinct_words(text)).encode()
                for n in BEGINNINGS:
                    if len(data) >= n:
                        sizes = model.sizes(data[:n])
                        gap = min(sizes[:own] + sizes[own + 1:]) - sizes[own]
                        sums[n] = [a + b for a, b in zip(sums[n], (1, gap, gap * gap))]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64())] + [pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(3)],
                                         names=["bytes", "n", "gap", "square"])

    some = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SPREAD_SHARE)) == 0).select("lang", "text")
    seen = (some.mapInArrow(gaps, "bytes long, n long, gap long, square long").groupBy("bytes")
            .agg(F.sum("n").alias("n"), F.sum("gap").alias("gap"), F.sum("square").alias("square")).where("n > 1").orderBy("bytes").collect())
    freedom = sum(r["n"] - 1 for r in seen)
    square = sum((r["square"] - r["gap"] ** 2 / r["n"]) / r["bytes"] for r in seen)
    return float(np.sqrt(square / freedom)) if square > 0 else SPREAD


class Classifier:
    """One compressor per language; built once in every worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard
        self.langs, self.compress = list(dictionaries), []
        self.spread = getattr(dictionaries, "spread", SPREAD)
        for data in dictionaries.values():
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(data), min_match=MIN_MATCH, strategy=zstandard.STRATEGY_BTOPT,
                                                                 write_content_size=False, write_dict_id=False)
            known.precompute_compress(compression_params=how)
            self.compress.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress)

    def sizes(self, data: bytes) -> list[int]:
        blocks = [LEAD + data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (share of the winner when a byte of difference counts as a factor e), rejected."""
        words = distinct_words(text)
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0, True
        data = " ".join(words).encode()
        sizes = self.sizes(data)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        narrow = len(order) > 1 and sizes[order[1]] - best < NARROW * self.spread * len(data) ** 0.5
        return self.langs[order[0]], float(1 / np.exp(best - np.array(sizes, float)).sum()), bool(narrow)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score and rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    key = uuid.uuid4().hex

    def run(texts: pa.Array) -> list[pa.Array]:
        model = held(key, lambda: Classifier(shared.value))
        found = [model.predict(t.as_py()) for t in texts]
        return [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

    return map_text(docs, list(keep), run, "lang_pred string, score double, rejected boolean")
