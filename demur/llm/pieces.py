"""SentencePiece encoding and decoding over a relational lattice.

1. Texts are cut into words where no piece can reach across: at line ends, before spaces, and between letters and other signs when the
   model has no piece with both. They are first cut before spaces into chunks, and only the distinct chunks of a batch into words. Tasks
   collect their distinct words, and one aggregate makes them distinct over the corpus.
2. Lattice: every word explodes into its substrings of at most the longest piece; they are joined with the piece table by equality. Characters that are
   no piece become byte pieces. Edges are grouped by word again (the rows never left their partition).
3. Viterbi: the grouped edges are folded in order of their ends, those of a batch of words together, and each position keeps the path
   of fewest pieces, and of these the one of the least sum of ranks by score.
4. The encoded words go to sorted files in the shared folder, which tasks map into memory to look up the words of their texts; whole texts never move.
   Where the encoded words are beyond ``MAPPED_WORDS``, words of texts are joined with them by shuffling instead.

Ids are those of the model file. The path differs from the library's own, which merges pairs by rank: about nine words in ten of running text get
the same pieces. Decoding joins the bytes of the pieces and gives back the text exactly, also spaces, line ends and unknown signs.

Rows: a null or empty text has no pieces and decodes to the empty text; a word of more than ``LONGEST`` characters is cut into stretches of that
length; repeated rows and ids give repeated rows; an empty table gives no rows; extra columns are kept beside the result where asked for.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from demur.sources.staging import shared_folder, stage

from .common import held, small_batches
from .tokens import _store

LONGEST = 256
#: Encoded words that are mapped from files, about 25 bytes each.
MAPPED_WORDS = 200_000_000
#: Bytes of texts that a task cuts at once, of words that it holds before it sends them, and words that travel at once.
TEXT_BYTES, COLLECTED_BYTES, SENT_WORDS = 6 << 20, 24 << 20, 100_000
#: Cost of a piece, against which its rank by score only settles ties; above the size of a vocabulary.
PIECE_COST = 1_000_000
#: Words whose edges one task groups by hashing before it goes over to sorting, and Spark's setting for that.
WORDS_AT_ONCE, HASHED_GROUPS = 150_000, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
#: First signs of a piece by which its lengths are looked up.
HEAD = 3
ANY_LETTERS = r"\n| *[^\W\d_]+| *(?:[^\w \n]+|[\d_]+)+| +"
SPACES_ONLY = r"\n| *[^ \n]+| +"


@dataclass
class Model:
    """What the operator needs of a model file."""

    pieces: list[tuple[str, int, float]]  # spaces written as spaces
    byte_ids: list[int]
    shown: list[bytes]  # bytes by id
    pattern: str
    longest: int


def load(path: str) -> Model:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, shown = [], [0] * 256, []
    for i in range(model.vocab_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[1:-1], 16)] = i
            shown.append(bytes([int(name[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            shown.append(b"")
        else:
            text = name.replace("\u2581", " ")
            pieces.append((text, i, model.get_score(i)))
            shown.append(text.encode())
    letter = [[c.isalpha() for c in text.lstrip(" ")] for text, _, _ in pieces]
    apart = all(all(found) or not any(found) for found in letter)
    return Model(pieces, byte_ids, shown, ANY_LETTERS if apart else SPACES_ONLY, max(len(t) for t, _, _ in pieces))


def words_of(text: str | None, pattern: str) -> list[str]:
    """Words of a text with the leading space that a model puts before it; joined they are that text."""
    return stretches(uncut(text, pattern))


def uncut(text: str | None, pattern: str) -> list[str]:
    return re.compile(pattern).findall(" " + text) if text else []


def stretches(words: Iterable[str]) -> list[str]:
    """The words, those of more than LONGEST signs in stretches of that length."""
    return [w[i:i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray | None]:
    """Every run of spaces with the signs up to the next, without its first space; how many each text has; the place of each text if they are out of order.

    A text has a space put before it, so that each chunk begins with one. Words have spaces at their beginning only: the words of a text are those of its chunks.
    """
    texts = pc.fill_null(texts, "")
    rare = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.equal(texts, ""))
    plain = pc.split_pattern(texts.filter(pc.invert(rare)), " ")
    cut, places = plain, None
    if len(plain) < len(texts):
        runs = [[run[1:] for run in re.findall(" +[^ ]*", " " + t)] if t else [] for t in texts.filter(rare).to_pylist()]
        cut = pa.concat_arrays([plain, pa.array(runs, plain.type)])
        places = np.argsort(np.argsort(rare.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    return cut.flatten(), pc.list_value_length(cut).to_numpy().astype(np.int64), places


def cut_chunks(found: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """The words of chunks, and how many each has."""
    # A line end after each chunk, which is a word of its own, keeps a chunk of spaces from running into the next.
    words = re.findall(pattern, "".join([f" {c}\n" for c in found.to_numpy(zero_copy_only=False).tolist()]))
    begins = np.flatnonzero(np.fromiter([w[0] == " " for w in words], bool, len(words)))
    own = np.ones(len(words), bool)
    own[begins[1:] - 1] = own[-1:] = False
    sizes = np.diff(np.append(begins, len(words))) - 1
    words = list(itertools.compress(words, own.tolist()))
    if max(map(len, words), default=0) > LONGEST:
        sizes = np.add.reduceat([-(-len(w) // LONGEST) for w in words], np.cumsum(sizes) - sizes)
        words = stretches(words)
    return pa.array(words, pa.string()), sizes


def gathered(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of about ``TEXT_BYTES`` of a column's texts, a row at least."""
    waiting, total = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        part = (total + np.cumsum(sizes) - sizes) // TEXT_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if waiting and total >= TEXT_BYTES or a:
                yield pa.concat_batches(waiting)
                waiting, total = [], 0
            waiting.append(batch.slice(a, b - a))
            total += int(sizes[a:b].sum())
    if waiting:
        yield pa.concat_batches(waiting)


def joined(entries: pa.Array, rows: pa.Array, counts: np.ndarray) -> pa.Array:
    """Binary entries by their rows, so many at a time put together."""
    taken = entries.take(rows)
    _, offsets, data = taken.buffers()
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    ends = np.frombuffer(offsets, np.int64)[bounds] if len(taken) else bounds
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """The distinct words of all texts, dealt by word; tasks send each of their words once, unless they have very many."""
    small_batches(docs.sparkSession)

    def sent(words: pa.Array) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words), SENT_WORDS):
            yield pa.RecordBatch.from_arrays([words.slice(at, SENT_WORDS)], names=["word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = [pa.array([], pa.string())]
        for batch in gathered(batches, 0):
            met.append(cut_chunks(chunks(batch.column(0))[0].unique(), pattern)[0].unique())
            if sum(a.nbytes for a in met) > COLLECTED_BYTES:
                met = [pa.concat_arrays(met).unique()]
                if met[0].nbytes > COLLECTED_BYTES // 2:
                    yield from sent(met.pop())
                    met = [pa.array([], pa.string())]
        yield from sent(pa.concat_arrays(met).unique())
        pa.default_memory_pool().release_unused()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("text").mapInArrow(run, "word string").repartition(parts, "word").distinct()


def best_paths(edges: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the cheapest path of each word and their offsets; ``edges`` are sorted in each word, which has one to every position at least."""
    end, start = edges >> 41, (edges >> 32) & 511
    code = (edges & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64)
    own = np.where(code >= 0, code + PIECE_COST, 1000 * PIECE_COST)
    n = np.diff(offsets)
    word = np.repeat(np.arange(len(n)), n)
    sizes = np.zeros(len(n), np.int64)
    sizes[n > 0] = end[offsets[1:][n > 0] - 1]
    base = np.cumsum(sizes + 1) - sizes - 1
    source, target = base[word] + start, base[word] + end
    cost, chosen = np.zeros(int((sizes + 1).sum()), np.int64), np.zeros(int((sizes + 1).sum()), np.int64)
    order = np.argsort(end, kind="stable")
    steps = np.searchsorted(end[order], np.arange(1, int(sizes.max(initial=0)) + 2))
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
        now = order[a:b]
        reached, total = target[now], cost[source[now]] + own[now]
        first = np.flatnonzero(np.concatenate([[True], reached[1:] != reached[:-1]]))
        least = np.minimum.reduceat(total, first)
        # Of equal paths the one whose last piece begins first.
        winner = np.minimum.reduceat(np.where(total == np.repeat(least, np.diff(np.append(first, b - a))), np.arange(b - a), b - a), first)
        cost[reached[first]], chosen[reached[first]] = least, now[winner]
    taken, at = np.zeros(len(edges), bool), (base + sizes)[sizes > 0]
    begins = np.zeros(len(cost), bool)
    begins[base] = True
    while len(at):
        taken[chosen[at]] = True
        at = source[chosen[at]]
        at = at[~begins[at]]
    return code[taken], np.concatenate([[0], np.cumsum(np.bincount(word[taken], minlength=len(n)))])


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """word, ids of every word of ``words`` (word), which are distinct.

    An edge is one number: end (from bit 41), start (from bit 32), and below them the rank of the piece, or minus one minus the
    code of a sign that is no piece. Numbers sort by end, then start.
    """
    spark = words.sparkSession
    ranked = sorted(model.pieces, key=lambda p: (-p[2], p[1]))
    # As many rows as the model has pieces.
    table = F.broadcast(spark.createDataFrame([(p[0], rank) for rank, p in enumerate(ranked)], "piece string, rank long"))
    if int(spark.conf.get(HASHED_GROUPS, "128")) < WORDS_AT_ONCE:
        spark.conf.set(HASHED_GROUPS, str(WORDS_AT_ONCE))
    # Only lengths that some piece has which begins alike are spelled out; single signs always are, as they may become bytes.
    lengths: dict[str, set[int]] = {}
    for text, _, _ in model.pieces:
        if len(text) >= HEAD:
            lengths.setdefault(text[:HEAD], set()).add(len(text))
    heads = F.broadcast(spark.createDataFrame([(h, [*range(1, HEAD), *sorted(n)]) for h, n in lengths.items()], "head string, lengths array<int>"))
    starts = words.select("word", F.length("word").alias("size"), F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    starts = starts.withColumn("head", F.substr("word", F.col("start") + 1, F.lit(HEAD))).join(heads, "head", "left")
    n = F.explode(F.coalesce("lengths", F.array(*[F.lit(n) for n in range(1, HEAD)]))).alias("n")
    spans = starts.select("word", "size", "start", n).where(F.col("start") + F.col("n") <= F.col("size"))
    spans = spans.select("word", "start", "n", F.substr("word", F.col("start") + 1, F.col("n")).alias("piece"))
    edges = spans.join(table, "piece", "left").where(F.col("rank").isNotNull() | (F.col("n") == 1))
    low = F.coalesce(F.col("rank"), F.lit((1 << 32) - 1).cast("long") - F.ascii("piece"))
    edge = F.shiftleft((F.col("start") + F.col("n")).cast("long"), 41) + F.shiftleft(F.col("start").cast("long"), 32) + low
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    ids = np.array([p[1] for p in ranked], np.int32)
    byte_ids = model.byte_ids

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            codes, offsets = best_paths(lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py())
            out = ids[np.maximum(codes, 0)] if len(ids) else np.zeros(len(codes), np.int32)
            odd = np.flatnonzero(codes < 0)
            if len(odd):
                spelled = [[byte_ids[b] for b in chr(-1 - c).encode()] for c in codes[odd].tolist()]
                grown = np.ones(len(codes), np.int64)
                grown[odd] = [len(x) for x in spelled]
                ends = np.concatenate([[0], np.cumsum(grown)])
                wide = np.repeat(out, grown)
                for at, x in zip(ends[odd].tolist(), spelled):
                    wide[at:at + len(x)] = x
                out, offsets = wide, ends[offsets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, pa.int32()))], names=["word", "ids"])

    return grouped.mapInArrow(named, "word string, ids array<int>")


def write_words(encoded: DataFrame, folder: str) -> list[tuple[int, int, int]]:
    """Encoded words in files sorted by hash: (part, least hash, rows) of each, as many as there are tasks."""
    spark = encoded.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = encoded.select(F.xxhash64("word").alias("h"), F.crc32(F.col("word").cast("binary")).alias("check"), "ids")
    ordered = rows.repartitionByRange(parts, "h", "check").sortWithinPartitions("h", "check")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        store, root = _store(folder)
        part, hashes, checks, sizes, ids = TaskContext.get().partitionId(), [], [], [], []
        for batch in batches:
            hashes.append(batch.column(0).to_numpy())
            checks.append(batch.column(1).to_numpy())
            lists = batch.column(2)
            sizes.append(np.diff(lists.offsets.to_numpy()))
            ids.append(lists.flatten().to_numpy().astype("<i4"))
        if not hashes or not sum(map(len, hashes)):
            return
        h = np.concatenate(hashes)
        mine = f"{root}/try-{part}-{uuid.uuid4().hex}"
        with store.open_output_stream(mine) as out:
            for a in (h.astype("<i8"), np.concatenate(checks).astype("<i8"), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8"), np.concatenate(ids)):
                out.write(a.tobytes())
        store.move(mine, f"{root}/words-{part}")
        yield pa.RecordBatch.from_pydict({"part": [part], "least": [int(h[0])], "n": [len(h)]}, schema=pa.schema([("part", pa.int32()), ("least", pa.int64()), ("n", pa.int64())]))

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    ordered.mapInArrow(write, "part int, least long, n long").write.mode("overwrite").parquet(f"{folder}/parts")
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/parts").collect())


class Words:
    """Ids of words out of the sorted files, each opened when first needed."""

    def __init__(self, folder: str, parts: list[tuple[int, int, int]]):
        self.folder, self.parts = folder, parts
        self.least = np.array([p[1] for p in parts], np.int64)
        self.open: dict[int, tuple] = {}

    def _part(self, i: int) -> tuple:
        if i not in self.open:
            from pyarrow import fs
            part, _, n = self.parts[i]
            store, root = _store(self.folder)
            name = f"{root}/words-{part}"
            data = np.memmap(name, np.uint8, "r") if isinstance(store, fs.LocalFileSystem) else np.frombuffer(store.open_input_file(name).read_buffer(), np.uint8)
            data = data.view(np.ndarray)  # slices of a map object are slow to make
            self.open[i] = (data[:8 * n].view("<i8"), data[8 * n:16 * n].view("<i8"), data[16 * n:24 * n + 8].view("<i8") * 4, memoryview(data[24 * n + 8:]))
        return self.open[i]

    def ids_of(self, words: list[str]) -> list[bytes]:
        import xxhash
        raw = [w.encode() for w in words]
        h = np.array([xxhash.xxh64_intdigest(b, 42) for b in raw], np.uint64).view(np.int64)
        check = np.array(list(map(zlib.crc32, raw)), np.int64)
        found, order = [b""] * len(words), np.argsort(h)
        where = np.searchsorted(self.least, h[order], "right") - 1
        bounds = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(words)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            mine = order[a:b]
            hashes, checks, offsets, ids = self._part(int(where[a]))
            at = np.searchsorted(hashes, h[mine])
            while (wrong := np.flatnonzero(checks[at] != check[mine])).size:  # words of one hash lie together
                at[wrong] += 1
            for j, begin, end in zip(mine.tolist(), offsets[at].tolist(), offsets[at + 1].tolist()):
                found[j] = bytes(ids[begin:end])
        return found

    def encode(self, texts: pa.Array, pattern: str) -> pa.Array:
        """The ids of each text, as lists."""
        every, counts, places = chunks(texts)
        every = every.dictionary_encode()
        words, sizes = cut_chunks(every.dictionary, pattern)
        words = words.dictionary_encode()
        ids = pa.array(self.ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        made = joined(joined(ids, words.indices, sizes), every.indices, counts)
        ends = np.frombuffer(made.buffers()[1], np.int64) // 4
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, made.buffers()[2]]))
        return lists if places is None else lists.take(pa.array(places))


def _by_files(docs: DataFrame, encoded: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    folder = f"{shared_folder(docs.sparkSession)}/words-{uuid.uuid4().hex}"
    parts, pattern = write_words(encoded, folder), model.pattern
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(folder, lambda: Words(folder, parts))
        for part in gathered(batches, len(keep)):
            lists = words.encode(part.column(len(keep)), pattern)
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], lists], names=[*keep, "pieces"])
        pa.default_memory_pool().release_unused()

    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema) + "pieces array<int>"
    return docs.select(*keep, F.col("text").alias("text to encode")).mapInArrow(run, out)


def _by_join(docs: DataFrame, encoded: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Every distinct text's words meet the encoded words by shuffling and come back in order."""
    pattern = model.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                ws = words_of(text.as_py(), pattern)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(ws), pa.string()), pa.array(range(len(ws)), pa.int32()), pa.array(ws, pa.string())],
                                                 names=["text_key", "at", "word"])

    keyed = docs.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    texts = keyed.groupBy("text_key").agg(F.first("text").alias("text"))
    placed = texts.mapInArrow(run, "text_key string, at int, word string").join(encoded, "word")
    lists = placed.groupBy("text_key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("pieces"))
    return keyed.join(lists, "text_key", "left").select(*keep, F.coalesce("pieces", F.array().cast("array<int>")).alias("pieces"))


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), mapped_words: int = MAPPED_WORDS) -> DataFrame:
    """``keep`` columns of ``docs`` (text, ...) and ``pieces``, the ids of each text."""
    model = load(path)
    encoded = stage(encode_words(distinct_words(docs, model.pattern), model), "encoded")
    few = encoded.count() <= mapped_words
    return (_by_files if few else _by_join)(docs, encoded, model, list(keep))


class Spelling:
    """The bytes of all ids in one table, and again without the first byte of each, to spell many ids by taking rows of it."""

    def __init__(self, shown: list[bytes]):
        self.table = pa.array(shown + [b[1:] for b in shown], pa.large_binary())
        self.seen = np.array([len(b) > 0 for b in shown], bool)

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """One text per count of ids, each without its first byte."""
        bounds, seen = np.concatenate([[0], np.cumsum(counts)]), self.seen[ids]
        if not seen.all():
            ids, bounds = ids[seen], np.concatenate([[0], np.cumsum(seen)])[bounds]
        rows = ids.astype(np.int64)
        rows[bounds[:-1][bounds[1:] > bounds[:-1]]] += len(self.seen)
        texts = joined(self.table, pa.array(rows), np.diff(bounds))
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no text
            return pa.array([t.decode(errors="replace") for t in texts.to_pylist()], pa.string())


def decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``rows`` (pieces, ...), ``decoded``, the text of the ids, and ``ids_sha256``, the digest of the ids as little-endian 32-bit integers."""
    shared = rows.sparkSession.sparkContext.broadcast(load(path).shown)
    inside = [f"kept {i}" for i in range(len(keep))]
    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = held("spelling", lambda: Spelling(shared.value))
        for batch in batches:
            lists = batch.column(len(inside))
            counts, ids = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64), lists.flatten().to_numpy().astype("<i4", copy=False)
            ends = np.cumsum(counts).tolist()
            digests = [hashlib.sha256(ids[b - n:b].tobytes()).hexdigest() for n, b in zip(counts.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(inside))], spelling.texts(ids, counts), pa.array(digests, pa.string())],
                                             names=[*inside, "made text", "made digest"])

    out = "".join(f"`{i}` {f.dataType.simpleString()}, " for i, f in zip(inside, schema)) + "`made text` string, `made digest` string"
    passed = rows.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inside)], F.col("pieces").alias("pieces to read"))
    made = passed.mapInArrow(run, out)
    return made.select(*[F.col(f"`{i}`").alias(c) for c, i in zip(keep, inside)], F.col("`made text`").alias("decoded"), F.col("`made digest`").alias("ids_sha256"))
