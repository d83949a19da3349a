"""What the piece encoder moves and folds: each word of a task is sent once, and words cut by chunks, paths and spellings equal plain ones."""

import random

import numpy as np
import pyarrow as pa
import pytest

from demur.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
PLAIN_LETTERS = r"\n| *[^\W\d_]+| *(?:(?![^\W\d_])[^ \n])+| +"
SIGNS = ["a", "b", "the", " ", "  ", "   ", "\n", "\t", "\r\n", ".", ",", "1", "23", "_", "é", "世", "\U0001f44d", "▁", "\x00", " ", "²", "Ⅷ", "&&", "x" * 300, " " * 300]


def odd_texts(n):
    draw = random.Random(3)
    texts = ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(0, 30))) for _ in range(n)]
    return texts + [None, "", " ", "  ", "\n", " \n ", " a", "a ", "a  b", "a\n b", "a \nb", "a" * 256, "a" * 257, " " * 600, "plain words"]


def test_a_task_sends_each_word_once(spark):
    n, size = 2200, 100
    letters = [chr(ord("a") + i) for i in range(26)]
    words = ["".join(letters[i // 26 ** p % 26] for p in range(4)) for i in range(n * size)]
    texts = [" ".join(words[i:i + size]) for i in range(0, len(words), size)]
    docs = spark.createDataFrame([(t,) for t in texts + texts], "text string").coalesce(1)
    context = spark.sparkContext
    context.setJobGroup("sent words", "sent words")
    try:
        assert pieces.distinct_words(docs, pieces.ANY_LETTERS).count() == n * size
        tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup("sent words") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    moved = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert n * size <= moved < 1.1 * n * size


@pytest.mark.parametrize("pattern", [pieces.ANY_LETTERS, pieces.SPACES_ONLY])
def test_words_cut_by_chunks(pattern):
    texts = odd_texts(500)
    every, counts, places = pieces.chunks(pa.array(texts, pa.string()))
    words, sizes = pieces.cut_chunks(every, pattern)
    words, ends = words.to_pylist(), np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    plain = PLAIN_LETTERS if pattern == pieces.ANY_LETTERS else pattern
    assert len(places) == len(texts) and [words[ends[p]:ends[p + 1]] for p in places] == [pieces.words_of(t, plain) for t in texts]


def test_gathered_rows_stay_whole_and_in_order(monkeypatch):
    monkeypatch.setattr(pieces, "TEXT_BYTES", 50)
    texts = [None, "a" * 30, "b" * 30, "", "c" * 200, "d", "e" * 49, "f"] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i:i + n], pa.string())], names=["t"]) for i, n in ((0, 3), (3, 0), (3, 9), (12, 1), (13, 11))]
    got = [b.column(0).to_pylist() for b in pieces.gathered(batches, 0)]
    assert sum(got, []) == texts and all(sum(len(t or "") for t in b[:-1]) < 100 for b in got) and len(got) > 5


def test_paths_of_many_words_against_a_fold():
    draw = random.Random(4)
    edges, offsets, want = [], [0], []
    for _ in range(300):
        size, best, mine = draw.randrange(0, 12), [(0, [])], []
        for end in range(1, size + 1):
            top = None
            for start in range(end):
                if end - start > 1 and draw.random() < 0.5:
                    continue
                code = -1 - draw.randrange(0x10FFFF) if end - start == 1 and draw.random() < 0.3 else draw.randrange(3)
                mine.append((end << 41) + (start << 32) + (code & 0xFFFFFFFF))
                cost = best[start][0] + (code + pieces.PIECE_COST if code >= 0 else 1000 * pieces.PIECE_COST)
                if top is None or cost < top[0]:
                    top = (cost, best[start][1] + [code])
            best.append(top)
        edges += mine
        offsets.append(len(edges))
        want.append(best[-1][1])
    codes, ends = pieces.best_paths(np.array(edges, np.int64), np.array(offsets, np.int64))
    assert [codes[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    assert [len(x) for x in pieces.best_paths(np.array([], np.int64), np.array([0], np.int64))] == [0, 1]


def test_spelling_against_joined_bytes():
    shown = [b"", b" ", b"a", b" the", "é".encode(), b"\xc3", b"\xa9", "世界".encode(), b"\xff", b"  "]
    spelling, draw = pieces.Spelling(shown), np.random.default_rng(5)
    for known in (5, len(shown)):
        for _ in range(200):
            counts = draw.integers(0, 6, draw.integers(0, 8))
            ids, ends = draw.integers(0, known, counts.sum()).astype("<i4"), np.cumsum(counts)
            want = [b"".join(shown[i] for i in ids[b - n:b])[1:].decode(errors="replace") for n, b in zip(counts, ends)]
            assert spelling.texts(ids, counts).to_pylist() == want


def test_odd_texts_come_back(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = list(enumerate(odd_texts(300)))
    encoded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, ("doc_id", "text"))
    back = pieces.decode(encoded, path, ("doc_id", "text")).collect()
    assert len(back) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in back)
