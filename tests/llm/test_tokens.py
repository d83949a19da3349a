"""Token ids of every simple character, and rows of one id over many parts."""

import numpy as np
import pytest

from demur.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_ids_of_every_simple_character_are_the_library_s():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, tok = tokens.WordEncoder(path), Tokenizer.from_file(path)
    wrong = []
    for c in map(chr, range(tokens.SIMPLE_BELOW + 16)):
        for text in (c, c + c, f"a{c}b", f"a{c}{c}b c{c}", f"{c}l {c}Y", f"don{c}'t 1{c}2", f" {c} ", f"word{c}"):
            ids = np.frombuffer(enc.encode(text), enc.dtype).tolist()
            if ids != tok.encode(text, add_special_tokens=False).ids:
                wrong.append(text)
    assert wrong == []


def test_rows_of_one_id_lie_in_many_parts(spark, tmp_path):
    rows = [(None, f"text {i:03}") for i in range(200)] + [(1, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = tokens.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2, str(tmp_path / "t"), parts=5)
    assert parts.count() > 2
    got = sorted(tokens.read_tokens(parts, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    enc = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    counts = [len(enc.encode(t)) // enc.dtype.itemsize + 1 for t in sorted(t for i, t in rows if i is None)] + [len(enc.encode("one")) // enc.dtype.itemsize + 1]
    assert [r["n_tokens"] for r in got] == counts and [r["start"] for r in got] == [0, *np.cumsum(counts)[:-1].tolist()]
