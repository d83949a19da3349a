"""Token-ID files: flat unsigned integers with 64-bit document offsets, written by range of the document id.

``write_tokens`` deals documents into ranges of ascending id, encodes every range in one task and writes two
files for it: ``part-N.ids`` (little-endian uint16, or uint32 for larger vocabularies) and ``part-N.idx`` (int64: the
document ids, then one more offset than there are documents, counted inside the part). The position of a part among all
ids is the prefix sum of the parts before it, kept in a small table. ``read_tokens`` maps the files into
memory and returns what they hold.

Rows: a null text counts as empty and still gets its end id; a null id sorts first and is kept as the smallest
long; equal ids keep both rows, ordered by text; an empty table gives no rows. Extra columns are ignored.

A task writes under a name of its own and renames, so a repeated or speculative attempt leaves the same files.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from demur.sources.staging import shared_folder

from .common import held, small_batches

NULL_ID = -(1 << 63)
#: Chunks, and words, that one worker remembers; beyond it the memory starts anew, results do not depend on it.
REMEMBERED_WORDS = 600_000
#: Texts whose characters, and the lower-case forms of these, all lie below this code point need no composing.
SIMPLE_BELOW = 0x300
#: Bytes of text that one part holds at the most wanted, so that a reader without a mounted folder can hold the ids of a part.
PART_BYTES = 256 << 20
#: Characters of a text by which rows of one id are dealt over ranges.
DEALT_BY = 64


def _letters(prefix: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SIMPLE_BELOW) if unicodedata.category(chr(c)).startswith(prefix))


def _byte_names() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary names each byte."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    hidden = [c for c in range(256) if c not in set(shown)]
    return {c: chr(c) for c in shown} | {c: chr(256 + i) for i, c in enumerate(hidden)}


class WordEncoder:
    """The library's encoding, with repeated words looked up instead of encoded again.

    The tokenizer cuts a text at white space and into words before it merges, so chunks between white space and the
    words inside them are encoded once and remembered. Texts with characters outside the simple range, or with special
    token strings, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        letters, digits = _letters("L"), _letters("N")
        space = r"\s\x85\xa0"
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+").findall
        simple = [c for c in map(chr, range(SIMPLE_BELOW)) if not "\x1c" <= c <= "\x1f" and all(ord(x) < SIMPLE_BELOW for x in c.lower())]
        self.plain = re.compile(f"[{''.join(map(re.escape, simple))}]*").fullmatch
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}
        self.byte_names = _byte_names()

    def _word(self, word: str) -> bytes:
        """A word after cutting and lower-casing, through the merges alone."""
        ids = self.known_words.get(word)
        if ids is None:
            if len(self.known_words) >= REMEMBERED_WORDS:
                self.known_words.clear()
            shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.byte_names)
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], self.dtype).tobytes()
            self.known_words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids = self.known.get(chunk)
        if ids is None:
            if len(self.known) >= REMEMBERED_WORDS:
                self.known.clear()
            ids = self.known[chunk] = b"".join(map(self._word, self.words(chunk)))
        return ids

    def encode(self, text: str) -> bytes:
        if not self.plain(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        chunks = text.lower().split()
        try:
            return b"".join(map(self.known.__getitem__, chunks))
        except KeyError:
            return b"".join(map(self._chunk, chunks))


def encoder(path: str) -> WordEncoder:
    return held(f"encoder {path}", lambda: WordEncoder(path))


def _store(folder: str):
    from pyarrow import fs
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, parts: int | None = None) -> DataFrame:
    """Write the files of ``docs`` (doc_id, text); returns one row per part with its base among all ids."""
    spark = docs.sparkSession
    small_batches(spark)
    if parts is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # The beginnings of texts spread the rows of one id, null ones above all; they sort as whole texts do.
    ordered = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, DEALT_BY)).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, size = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        store, root = _store(folder)
        ids, counts, stream = [], [], None
        mine = f"{root}/try-{part}-{uuid.uuid4().hex}"
        for batch in batches:
            if stream is None:
                stream = store.open_output_stream(mine + ".ids")
            ids.append(batch.column(0).to_numpy())
            for text in batch.column(1):
                data = enc.encode(text.as_py()) + end
                counts.append(len(data) // size)
                stream.write(data)
        if stream is None:
            return
        stream.close()
        offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        with store.open_output_stream(mine + ".idx") as out:
            out.write(np.concatenate([*ids, offsets]).astype("<i8").tobytes())
        for kind in ("ids", "idx"):
            store.move(f"{mine}.{kind}", f"{root}/part-{part}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(counts)], "n_ids": [int(offsets[-1])],
                                          "width": [size]}, schema=PART_SCHEMA)

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    ordered.mapInArrow(write, PART_COLUMNS).write.mode("overwrite").parquet(f"{folder}/parts")
    return with_bases(spark.read.parquet(f"{folder}/parts"))


PART_COLUMNS = "part int, n_docs long, n_ids long, width int"
PART_SCHEMA = pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())])


def with_bases(parts: DataFrame) -> DataFrame:
    """Prefix sums over one row per part; the rows are as many as the writing tasks."""
    return parts.selectExpr("*", "coalesce(sum(n_ids) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")


def open_part(folder: str, part: int, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, offsets (one more) and the ids of one part, mapped where the folder is a mounted one."""
    from pyarrow import fs
    store, root = _store(folder)
    names = [f"{root}/part-{part}.{kind}" for kind in ("idx", "ids")]
    if isinstance(store, fs.LocalFileSystem):
        index, ids = (np.memmap(n, d, "r") for n, d in zip(names, ("<i8", f"<u{width}")))
    else:
        index, ids = (np.frombuffer(store.open_input_file(n).read_buffer(), d) for n, d in zip(names, ("<i8", f"<u{width}")))
    return index[:n_docs], index[n_docs:], ids


def read_tokens(parts: DataFrame, folder: str) -> DataFrame:
    """One row per document read back from the files: position of its first id, number of ids, checksum."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, offsets, ids = open_part(folder, row["part"], row["n_docs"], row["width"])
                crcs = [zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.asarray(docs), pa.int64()), pa.array(np.asarray(offsets[:-1]) + row["base"], pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the token files of the documents and return per document what the files hold."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, tokenizer, end_id, folder), folder)


def decoder(folder: str, part: int, n_docs: int, width: int) -> Callable[[int], np.ndarray]:
    """Ids of the i-th document of a part, without reading the rest."""
    _, offsets, ids = open_part(folder, part, n_docs, width)
    return lambda i: np.asarray(ids[offsets[i]:offsets[i + 1]])

